"""Toxicity by a weighted finite-state grammar: clauses with insults and threats, aimed, negated or reported."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgerow.llm.learning import labelled_hashes, logistic_rows, shifted, sigmoid
from hedgerow.llm.shared import discard, small_batches, written
from hedgerow.llm.transducers import grammar

# Closed word classes in the languages at hand (en, fr, de, es).
ADDRESSED = "you your youre yourself toi vous votre dich dir euch dein deine tú usted ustedes".split()
NEGATIONS = "not never nobody hardly jamais nicht kein keine nie niemals nunca jamás".split()
REPORTING = "said says told wrote quoted called dit disait écrit sagte sagt schrieb dijo dice escribió".split()
THREATS = "kill hurt destroy shoot stab tuer töten umbringen matar".split()


@dataclass(frozen=True)
class Toxicity:
    """Lexicon and weights are fitted on all labelled documents.

    A stem is a whole word or a longer word's first 4 to 7 letters; it enters the lexicon if at least ``least`` toxic
    texts hold it and its log odds reach ``odds``; ``stems`` bounds the lexicon.
    """

    least: int = 8
    odds: float = 2.0
    stems: int = 5000
    threat: float = 4.0


_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.;:!?\n]+")


_ROWS = 128  # texts whose stems are sent on at a time


def _words(text: str) -> str:
    """The distinct words of a text in lower case, a space between two."""
    return " ".join(dict.fromkeys(_WORD.findall(text.lower())))


def _stems(words: str) -> set[str]:
    """Whole words as ``=word``, starts of longer words as they are."""
    found = set()
    for word in words.split():
        found.add("=" + word)
        found.update(word[:n] for n in range(4, min(8, len(word))))
    return found


def learn_stems(texts: DataFrame, marks: DataFrame, how: Toxicity) -> dict[str, float]:
    """Log odds of the stems that mark toxic texts, counted by Spark over all of ``texts`` (h, text) that ``marks`` (h, y) names.

    Only the distinct words of a text go to its label, not the text.
    """
    def split(batches):
        for batch in batches:
            found = [_words(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["h", "words"])

    def spell(batches):
        for batch in (whole.slice(at, _ROWS) for whole in batches for at in range(0, whole.num_rows, _ROWS)):
            stems, labels = [], []
            for words, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = _stems(words)
                stems += found
                labels += [y] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array(labels, pa.int32())], ["stem", "y"])

    size = {r.y: r.n for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    ones, zeros = size.get(1, 0), size.get(0, 0)
    words = texts.mapInArrow(split, "h long, words string").dropDuplicates(["h"])
    counts = words.join(marks, "h").select("words", "y").mapInArrow(spell, "stem string, y int").groupBy("stem").agg(
        F.sum("y").alias("ones"), F.sum(1 - F.col("y")).alias("zeros"))
    odds = F.log((F.col("ones") + 0.5) / (ones + 1.0)) - F.log((F.col("zeros") + 0.5) / (zeros + 1.0))
    best = counts.where(F.col("ones") >= how.least).select("stem", odds.alias("odds")).where(F.col("odds") >= how.odds)
    return {r.stem: r.odds for r in best.orderBy(F.desc("odds"), "stem").limit(how.stems).collect()}


class Scanner:
    """Finds the clauses of a text that hold an insult or threat and runs the grammar over each of them."""

    OUTPUTS = "IDMQT"

    def __init__(self, lexicon: dict[str, float], threat: float):
        import ahocorasick

        self.words = dict.fromkeys(NEGATIONS, "N") | dict.fromkeys(REPORTING, "R") | dict.fromkeys(ADDRESSED, "U")
        self.threats = {w: lexicon.get("=" + w, threat) for w in THREATS}
        self.lexicon, self.arcs = lexicon, grammar().arcs
        self.finder = ahocorasick.Automaton()
        for stem in {s.lstrip("=") for s in lexicon} | set(THREATS):
            self.finder.add_word(stem, len(stem))
        self.finder.make_automaton()

    def symbol(self, word: str) -> tuple[str, float]:
        if word in self.threats:
            return "T", self.threats[word]
        weight = self.lexicon.get("=" + word)
        for n in range(min(7, len(word) - 1), 3, -1):
            if weight is not None:
                break
            weight = self.lexicon.get(word[:n])
        if weight is not None:
            return "I", weight
        return self.words.get(word, "w"), 0.0

    def clauses(self, text: str):
        """(start, end) of the clauses with a hit, in order."""
        hits = []
        for end, size in self.finder.iter(text):
            start = end + 1 - size
            if not (start and text[start - 1].isalpha()):
                hits.append(start)
        if not hits:
            return
        done = -1
        ends = [m.start() for m in _CLAUSE.finditer(text)] + [len(text)]
        starts = [0] + [m.end() for m in _CLAUSE.finditer(text)]
        at = 0
        for hit in sorted(hits):
            while ends[at] < hit:
                at += 1
            if at != done:
                done = at
                yield starts[at], ends[at]

    def features(self, text: str) -> list[float]:
        """Log sums of the matched clauses' weights, by what the grammar makes of each hit, and their number."""
        sums, matched = dict.fromkeys(self.OUTPUTS, 0.0), 0
        text = text.lower()
        for lo, hi in self.clauses(text):
            state, any_ = 0, False
            for m in _WORD.finditer(text, lo, hi):
                symbol, lexical = self.symbol(m[0])
                out, weight, state = self.arcs[state, symbol]
                if out in sums:
                    sums[out] += weight * lexical
                    any_ = True
            matched += any_
        return [math.log1p(sum(sums.values())), math.log1p(matched), *(math.log1p(x) for x in sums.values())]


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    weights: list[float]
    threat: float


def fit(docs: DataFrame, labels: DataFrame, usable, how: Toxicity = Toxicity(), id: str = "doc_id", text: str = "text",
        label: str = "toxic") -> Model:
    """Learn lexicon and weights from every document whose label's id meets ``usable``."""
    small_batches(docs.sparkSession)
    marks, share = labelled_hashes(docs, labels, id, text, label, usable)
    marks = written(marks, "toxic-marks")
    string = F.col(text).cast("string")
    texts = docs.select(F.xxhash64(string).alias("h"), string.alias("text"))
    lexicon = learn_stems(texts, marks, how)
    width = 2 + len(Scanner.OUTPUTS)

    def encode(batches):
        scanner = Scanner(lexicon, how.threat)
        for batch in batches:
            found = [scanner.features(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["h", "x"])

    features = texts.mapInArrow(encode, "h long, x array<double>").dropDuplicates(["h"])
    rows = written(features.join(marks, "h").select("x", "y"), "toxic-features")
    discard(marks)
    ones, all_ = rows.agg(F.sum("y"), F.count("*")).first()
    if not ones or ones == all_:
        weights = np.array([0.0] * width + [shifted(0.0, 0.5, share)])
    else:
        weights = logistic_rows(rows, width)
        weights[-1] = shifted(weights[-1], ones / all_, share)
    discard(rows)
    return Model(lexicon, weights.tolist(), how.threat)


def toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``toxicity``, a probability for each whole text (null: empty).

    An Aho-Corasick pass finds stems; each clause with one is run through the composed grammar, and the summed clause
    weights go into a logistic score. Rows, repeated or not, keep all their columns; one of that name is replaced.
    """
    small_batches(docs.sparkSession)
    lexicon, weights, threat = model.lexicon, np.array(model.weights), model.threat

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(lexicon, threat)
        for texts in batches:
            found = np.array([scanner.features(t or "") for t in texts]).reshape(len(texts), len(weights) - 1)
            yield pd.Series(sigmoid(found @ weights[:-1] + weights[-1]))

    return docs.withColumn("toxicity", score(F.col(text).cast("string")))
