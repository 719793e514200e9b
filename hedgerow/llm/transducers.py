"""Weighted finite-state transducers over word classes, and their composition into one."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``arcs[state, symbol] = (output, weight, next state)``; other symbols pass through unchanged.

    State 0 is the start. Weights multiply along a path.
    """

    arcs: dict[tuple[int, str], tuple[str, float, int]]
    states: int

    def step(self, state: int, symbol: str) -> tuple[str, float, int]:
        return self.arcs.get((state, symbol), (symbol, 1.0, state))


def compose(first: Transducer, second: Transducer, symbols: Iterable[str]) -> Transducer:
    """One transducer that does what ``second`` does to the output of ``first``."""
    arcs = {}
    for a in range(first.states):
        for b in range(second.states):
            for symbol in symbols:
                middle, w1, a2 = first.step(a, symbol)
                out, w2, b2 = second.step(b, middle)
                arcs[a * second.states + b, symbol] = (out, w1 * w2, a2 * second.states + b2)
    return Transducer(arcs, first.states * second.states)


# Symbols: I insult, T threat, U person addressed, N negation, R verb of reporting, w any other word.
# Outputs for an insult or threat: I or T plain, D aimed at someone, M negated, Q reported.
SYMBOLS = "ITUNRw"


def addressed() -> Transducer:
    """An insult or threat after a word for the person addressed, anywhere before it in the clause, is aimed."""
    return Transducer({(0, "U"): ("w", 1.0, 1), (1, "U"): ("w", 1.0, 1), (1, "I"): ("D", 1.5, 1), (1, "T"): ("D", 2.0, 1)}, 2)


def negated(scope: int = 3) -> Transducer:
    """An insult or threat up to ``scope`` words after a negation is weaker."""
    arcs: dict = {}
    for left in range(scope + 1):
        arcs[left, "N"] = ("w", 1.0, scope)
        arcs[left, "w"] = ("w", 1.0, max(0, left - 1))
        for symbol in "ITD":
            if left:
                arcs[left, symbol] = ("M", 0.5, left - 1)
    return Transducer(arcs, scope + 1)


def reported() -> Transducer:
    """After a verb of reporting, what follows in the clause is someone else's speech."""
    arcs: dict = {(0, "R"): ("w", 1.0, 1), (1, "R"): ("w", 1.0, 1)}
    arcs |= {(1, symbol): ("Q", 0.6, 1) for symbol in "ITDM"}
    return Transducer(arcs, 2)


def grammar() -> Transducer:
    """Aim, then negation, then reported speech, as one transducer over a clause."""
    aimed = compose(addressed(), negated(), SYMBOLS)
    return compose(aimed, reported(), SYMBOLS)
