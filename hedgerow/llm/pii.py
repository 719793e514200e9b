"""Personal data: fixed patterns, and a skip-chain conditional random field that extends them through each document."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgerow.llm.shared import discard, small_batches, written

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
NAME = -1  # marks rows of local parts among the counts

# The base patterns. A look-behind that changes no match keeps long runs of digits linear.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[A-Za-z0-9._%+-]+")
_LOOSE = re.compile(r"\(?[0-9](?:[\x20().0-9-]*[0-9])?")


@dataclass(frozen=True)
class Pii:
    """Fitted on all documents, labelled by the patterns.

    A span is added if its kind's belief reaches ``sure``. Shape and two neighbours give log odds of at most ``shape`` / 2
    + 4 ``PULL`` = 2.1, a belief of 0.89, so only what agrees with a base span of the document is added. ``tail``: shared last digits that
    make two numbers similar. ``rounds`` of message passing. ``near``: characters between neighbours of the chain.
    """

    sure: float = 0.9
    shape: float = 1.0
    tail: int = 7
    rounds: int = 6
    near: int = 80


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and then kind; code points, end exclusive."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() and 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def _candidates(text: str, base: list[tuple[int, int, int]], how: Pii) -> list[tuple[int, int, int]]:
    """(start, kind or OTHER, end): base spans, other number-like runs, other mentions of an address's local part; in order."""
    names, mentions = {text[s:e].partition("@")[0] for s, kind, e in base if kind == 0}, []
    if names:
        mentions = _free(((m.start(), OTHER, m.start() + len(w)) for m in _WORD.finditer(text) if (w := _word(m[0], names)) in names), base)
    loose = _free(((m.start(), OTHER, m.end()) for m in _LOOSE.finditer(text) if m.end() - m.start() >= how.tail), base)
    # a number in a longer run of digits is part of that run; digits in a name are part of the name
    mentions = _free(mentions, [n for n in loose if text[n[0]:n[2]] not in names], inside=True)
    return sorted([*base, *mentions, *_free(loose, mentions)])


def _word(run: str, names: set[str]) -> str:
    """A run of letters of local parts without the dots that end a sentence."""
    return run if run in names else run.rstrip(".")


def _free(nodes, held: list[tuple[int, int, int]], inside: bool = False) -> list[tuple[int, int, int]]:
    """``nodes``, in order, that overlap with none of ``held``; with ``inside`` that do not lie in one of them."""
    held, k, edge, out = sorted(held), 0, 0, []
    for node in nodes:
        while k < len(held) and held[k][0] < (node[0] + 1 if inside else node[2]):
            edge = max(edge, held[k][2])
            k += 1
        if (node[2] > edge) if inside else (node[0] >= edge):
            out.append(node)
    return out


SHAPES = 16
PULL = 0.4


def _shape(text: str, start: int, end: int) -> list[int]:
    """Numbers of the features a candidate has; none tells whether a check digit or a part's range is right."""
    own = text[start:end]
    n = len(_digits(own))
    found = [0, 1 if n < 7 else 2 if n < 9 else 3 if n < 12 else 4 if n < 16 else 5 if n == 16 else 6]
    found += [k for k, c in ((7, "."), (8, "-"), (9, " "), (10, "("), (11, "@")) if c in own]
    found.append(12 if start and text[start - 1] == "+" or own[:1] == "+" else 13)
    found.append(14 if any(c.isalpha() for c in own) else 15)
    return found


def _links(text: str, nodes: list[tuple[int, int, int]], how: Pii) -> list[tuple[int, int]]:
    """Skip edges: nodes with the same last digits or the same local part, each tied to the first base one.

    Without a base one there is none: a value says no more about its kind by being repeated.
    """
    names = {text[s:e].partition("@")[0] for s, kind, e in nodes if kind == 0}
    groups: dict[str, list[int]] = defaultdict(list)
    for k, (s, kind, e) in enumerate(nodes):
        own = text[s:e]
        if kind == 0 or own in names:
            groups["a" + own.partition("@")[0]].append(k)
        else:
            digits = _digits(own)
            if len(digits) >= how.tail:
                groups["d" + digits[-how.tail:]].append(k)
    edges = []
    for members in groups.values():
        hub = next((k for k in members if nodes[k][1] != OTHER), None)
        edges += [(hub, k) for k in members if k != hub and hub is not None]
    return edges


@dataclass(frozen=True)
class Model:
    """Log potentials: of shapes (features, labels), of neighbours (labels, labels), of linked mentions that agree.

    ``words``: in how many texts a local part of some address stands as a word, without an address that has it.
    """

    shapes: np.ndarray
    chain: np.ndarray
    agree: float
    words: dict[str, float] = field(default_factory=dict)

    def agreement(self, word: str) -> float:
        """What an address says about a mention of its local part: less, the more texts have that word without it."""
        return max(0.0, self.agree - math.log1p(self.words.get(word, 0.0)))


def fit(docs: DataFrame, how: Pii = Pii(), text: str = "text") -> Model:
    """Learn the potentials from every row's whole text; the patterns give the labels."""
    small_batches(docs.sparkSession)
    labels = len(KINDS) + 1

    def encode(batches):
        for batch in batches:
            words, addressed = Counter(), set()
            shapes, kinds, chains, agree = np.zeros((SHAPES, labels)), np.zeros(labels), np.zeros((labels, labels)), np.zeros(2)
            for value in batch.column(0).to_pylist():
                base = base_spans(value)
                nodes = _candidates(value, base, how)
                names = {value[s:e].partition("@")[0] for s, kind, e in base if kind == 0}
                addressed |= names
                words.update({w for x in _WORD.findall(value) if len(x) <= 64 and (w := _word(x, names)) not in names})
                for s, kind, e in nodes:
                    kinds[kind] += 1
                    for f in _shape(value, s, e):
                        shapes[f, kind] += 1
                for (s, a, e), (s2, b, _) in zip(nodes[:-1], nodes[1:]):
                    if s2 - e <= how.near:
                        chains[a, b] += 1
                for a, b in _links(value, nodes, how):
                    if OTHER not in (nodes[a][1], nodes[b][1]):
                        agree[int(nodes[a][1] == nodes[b][1])] += 1
            row = np.concatenate([shapes.ravel(), kinds, chains.ravel(), agree])
            numbers = [*range(len(row)), *[None] * len(words), *[NAME] * len(addressed)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int32()), pa.array([*[None] * len(row), *words, *addressed], pa.string()),
                 pa.array([*row, *words.values(), *[1.0] * len(addressed)], pa.float64())], ["k", "word", "n"])

    texts = docs.select(F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    size = SHAPES * labels + labels + labels * labels + 2
    counts = np.zeros(size)
    words = {}
    summed = written(texts.mapInArrow(encode, "k int, word string, n double").groupBy("k", "word").agg(F.sum("n").alias("n")), "pii-counts")
    # ``size`` rows, and of the words of at least four texts (rarer ones cannot change what is added) those that some address has
    kept = summed.where("k IS NULL AND n >= 4").join(summed.where(F.col("k") == NAME).select("word"), "word", "left_semi")
    for r in summed.where("k >= 0").unionByName(kept).collect():
        if r.k is None:
            words[r.word] = r.n
        else:
            counts[r.k] = r.n
    discard(summed)
    shapes, kinds, chain, agree = np.split(counts, np.cumsum([SHAPES * labels, labels, labels * labels]))
    shapes, chain = shapes.reshape(SHAPES, labels), chain.reshape(labels, labels)
    given = (shapes + 0.5) / (kinds + 1.0)
    spread = np.log(given / given.mean(axis=1, keepdims=True))
    rows, columns = chain.sum(axis=1, keepdims=True) + labels, chain.sum(axis=0, keepdims=True) + labels
    pull = np.log((chain + 1) * (chain.sum() + labels * labels) / (rows * columns))
    return Model(spread, np.clip(pull, -PULL, PULL), float(np.log((agree[1] + 400) / (agree[0] + 1))), words)


def _beliefs(text: str, nodes: list[tuple[int, int, int]], model: Model, how: Pii) -> np.ndarray:
    """Label probabilities of the nodes by loopy sum-product; base spans are observed."""
    labels = len(KINDS) + 1
    own = np.zeros((len(nodes), labels))
    for k, (s, kind, e) in enumerate(nodes):
        if kind != OTHER:
            own[k] = -1e6  # outweighs any number of messages
            own[k, kind] = 0.0
        else:
            score = model.shapes[_shape(text, s, e)].sum(axis=0)
            own[k] = np.clip(score - score[OTHER], -how.shape, how.shape)
            own[k, OTHER] = how.shape / 2
    edges, tables = [], []
    for k in range(len(nodes) - 1):
        if nodes[k + 1][0] - nodes[k][2] <= how.near:
            edges.append((k, k + 1))
            tables.append(model.chain)
    same = np.eye(labels)
    for hub, k in _links(text, nodes, how):
        s, kind, e = nodes[k]
        edges.append((hub, k))
        tables.append(same * (model.agreement(text[s:e]) if nodes[hub][1] == 0 and kind == OTHER else model.agree))
    if not edges:
        p = np.exp(own - own.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)
    a, b = np.array(edges).T
    table = np.exp(np.stack(tables))
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    table = np.concatenate([table, table.transpose(0, 2, 1)])
    half, messages = len(a), np.zeros((2 * len(a), labels))
    for _ in range(how.rounds):
        total = own.copy()
        np.add.at(total, target, messages)
        back = np.concatenate([messages[half:], messages[:half]])
        out = total[source] - back
        out = np.exp(out - out.max(axis=1, keepdims=True))
        sent = np.einsum("ei,eij->ej", out, table)
        fresh = np.log(sent / sent.sum(axis=1, keepdims=True) + 1e-12)
        messages = 0.5 * messages + 0.5 * fresh
    total = own.copy()
    np.add.at(total, target, messages)
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def spans(text: str, model: Model, how: Pii) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each (start, kind, end) by start and then kind."""
    base = base_spans(text)
    nodes = _candidates(text, base, how)
    if len(nodes) == len(base):
        return base, base
    beliefs = _beliefs(text, nodes, model, how)
    best = beliefs[:, :OTHER].argmax(axis=1)
    more = [(s, int(best[k]), e) for k, (s, kind, e) in enumerate(nodes)
            if kind == OTHER and beliefs[k, best[k]] >= how.sure]
    return base, sorted(base + more)


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{s}:{e}" for s, kind, e in found)


def find_pii(docs: DataFrame, model: Model, how: Pii = Pii(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row; null texts count as empty.

    The counts and the digest are those of the fixed patterns, ``spans`` lists those and what the field adds. Each text
    is handled whole in one task; repeated rows give repeated rows, extra columns are ignored.
    """
    def run(batches):
        for batch in batches:
            counts, digests, lists = np.zeros((4, batch.num_rows), np.int64), [], []
            for k, value in enumerate(batch.column(1).to_pylist()):
                base, all_ = spans(value or "", model, how)
                for _, kind, _ in base:
                    counts[kind, k] += 1
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                lists.append(listed(all_))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(lists, pa.string())],
                ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    ).withColumnRenamed("id", id)


def redact(docs: DataFrame, model: Model, how: Pii = Pii(), text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans become one. Nulls stay null."""
    def cut(value):
        if not isinstance(value, str):
            return None
        out, at = [], 0
        for s, kind, e in spans(value, model, how)[1]:
            if s >= at:
                out += [value[at:s], f"[{KINDS[kind].upper()}]"]
            at = max(at, e)
        return "".join([*out, value[at:]])

    @F.pandas_udf("string")
    def replaced(texts: pd.Series) -> pd.Series:
        return texts.map(cut)

    small_batches(docs.sparkSession)
    return docs.withColumn(text, replaced(F.col(text).cast("string")))
