"""Phrase collocations by stripes: each prefix keys a counter of next words, stripes of all tasks are merged elementwise."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hedgerow.llm.shared import mix, salted_join, written


@dataclass(frozen=True)
class Collocations:
    """Phrases of 2 to ``longest`` words with at least ``least`` occurrences; ``first`` of each language are returned.

    ``covered``: percent of a phrase's occurrences inside one longer phrase that drop it. ``held``: words counted in a
    task before its stripes are passed on. ``part_bytes``: bytes of text whose stripes are merged in one task.
    ``segments``: a stripe is cut into as many by its next words.
    """

    longest: int = 3
    least: int = 10
    covered: int = 50
    first: int = 2000
    held: int = 2_000_000
    part_bytes: int = 12_000_000
    segments: int = 64


TOKEN = re.compile(rb"[.,;:!?\n\x0b\x0c\r]|[^ \t.,;:!?\n\x0b\x0c\r]+")
BREAKS = frozenset(b".,;:!?\n\x0b\x0c\r")
OTHER = "und"
_PIECE = 1 << 20


class _Numbers(dict):
    """Words to numbers from 1 on; what ends a piece is 0."""

    def __init__(self):
        super().__init__()
        self.words = [b""]

    def __missing__(self, word: bytes) -> int:
        if len(word) == 1 and word[0] in BREAKS:
            number = 0
        else:
            number = len(self.words)
            self.words.append(word)
        self[word] = number
        return number


def _tokens(raw: bytes) -> Iterator[list[bytes]]:
    """Words and breaks of a text, a bounded number at a time; only white space or a break ends a part."""
    lo = 0
    while lo < len(raw):
        hi = min(len(raw), lo + _PIECE)
        while hi < len(raw) and raw[hi] not in b" \t.,;:!?\n\x0b\x0c\r":
            hi += 1
        yield TOKEN.findall(raw[lo:hi].lower())
        lo = hi


class Counter:
    """Words of one language in a task: numbers in order, 0 between pieces."""

    def __init__(self):
        self.numbers, self.runs, self.before = _Numbers(), [], 0

    def add(self, tokens: list[bytes]) -> None:
        run = np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens))
        self.runs.append(run)

    def stop(self) -> None:
        self.runs.append(np.zeros(1, np.int64))

    def counts(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1 on: (phrases, a sorted row of word numbers each; counts). The first ``before`` words,
        kept from the last call, only begin phrases."""
        a = np.concatenate(self.runs) if self.runs else np.zeros(0, np.int64)
        base = len(self.numbers.words)
        codes, alive, phrases = a, a > 0, None
        for n in range(1, min(longest, len(a)) + 1):
            if n > 1:
                codes, alive = codes[:-1] * base + a[n - 1:], alive[:-1] & (a[n - 1:] > 0)
            ends = alive.copy()
            ends[: max(0, self.before - n + 1)] = False
            found, inverse = np.unique(codes[alive], return_inverse=True)
            counts = np.bincount(inverse[ends[alive]], minlength=len(found))
            last = (found % base).astype(np.int32)
            phrases = last[:, None] if phrases is None else np.column_stack([phrases[found // base], last])
            yield phrases[counts > 0], counts[counts > 0]
            codes = np.zeros(len(a) - n + 1, np.int64)
            codes[alive] = inverse  # short numbers of the phrases seen

    def rest(self, longest: int) -> "Counter":
        """A counter that goes on after this one, with the words that still begin phrases."""
        a = np.concatenate(self.runs) if self.runs else np.zeros(0, np.int64)
        tail = a[max(0, len(a) - longest + 1):]
        after = Counter()
        after.add([self.numbers.words[k] if k else b"." for k in tail.tolist()])
        after.before = len(tail)
        return after


STRIPES = "lang string, part int, n int, words string, prefix binary, width binary, next binary, count binary"


_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * 4]


def stripes(lang: str, counter: Counter, parts: int, how: Collocations) -> Iterator[pa.RecordBatch]:
    """A row for each part and length n: the stripes of the prefixes of n - 1 words that belong to the part.

    ``words`` is the row's vocabulary, joined by blanks; ``prefix`` holds n - 1 of its places for each stripe, ``width``
    its number of next words, ``next`` their places, all as 32-bit numbers. The part is a hash of the prefix and the
    next word's segment; of the empty prefix, of the next word.
    """
    names = counter.numbers.words
    hashes = mix(np.array([xxhash.xxh64_intdigest(w) for w in names], np.uint64))
    for n, (phrases, counts) in enumerate(counter.counts(how.longest), 1):
        if not len(phrases):
            continue
        key = np.full(len(phrases), n, np.uint64)
        for k in range(n - 1):
            key = mix(key + hashes[phrases[:, k]])
        last = hashes[phrases[:, -1]]
        key = mix(key + (last if n == 1 else last % np.uint64(how.segments)))
        part = (key % np.uint64(parts)).astype(np.int64)
        del key, last
        order = np.argsort(part, kind="stable")  # phrases stay sorted within a part
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(part[order]) != 0)), len(part))
        rows = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            p = phrases[order[lo:hi]]
            known, places = np.unique(p, return_inverse=True)
            places = places.reshape(p.shape).astype("<i4")
            fresh = np.append(True, (p[1:, :-1] != p[:-1, :-1]).any(axis=1))
            starts = np.flatnonzero(fresh)
            rows.append((lang, int(part[order[lo]]), n, b" ".join([names[k] for k in known.tolist()]).decode(),
                         places[starts, :-1].tobytes(), np.diff(np.append(starts, len(p))).astype("<i4").tobytes(),
                         places[:, -1].tobytes(), counts[order[lo:hi]].astype("<i4").tobytes()))
            if len(rows) == 16 or hi == len(part):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)],
                    ["lang", "part", "n", "words", "prefix", "width", "next", "count"])
                rows = []


def _counted(parts: int, how: Collocations):
    def count(batches):
        open_: dict[str, Counter] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang = lang.as_py()
                counter = open_.setdefault(lang, Counter())
                for tokens in _tokens(text.as_buffer().to_pybytes() if text.is_valid else b""):
                    counter.add(tokens)
                    size += len(tokens)
                    if size >= how.held:
                        for key, full in open_.items():
                            yield from stripes(key, full, parts, how)
                        counter, size = counter.rest(how.longest), 0
                        open_ = {lang: counter}
                counter.stop()
        for key, full in open_.items():
            yield from stripes(key, full, parts, how)

    return count


def _merge(least: int):
    """Stripes of one part and length, merged elementwise: next words with ``least`` occurrences, and all occurrences."""
    def merge(table: pa.Table) -> pa.Table:
        lang, n = table.column("lang")[0].as_py(), table.column("n")[0].as_py()
        words = [w.split(" ") for w in table.column("words").to_pylist()]
        held = {k: [np.frombuffer(x.as_buffer(), "<i4") for x in table.column(k)] for k in ("prefix", "width", "next", "count")}
        numbers, names = pd.factorize(np.array([w for row in words for w in row], object))
        base = np.cumsum([0, *map(len, words)])  # where a row's vocabulary begins
        flat = {k: np.concatenate(held[k]).astype(np.int64) for k in ("width", "count")}
        heads, nexts = (numbers[np.concatenate([x + b for x, b in zip(held[k], base)])] for k in ("prefix", "next"))
        del words, held
        prefixes = heads.reshape(len(flat["width"]), n - 1)
        stripe = np.zeros(len(prefixes), np.int64)
        for k in range(n - 1):  # equal prefixes of different rows are one stripe
            _, stripe = np.unique(stripe * (len(names) + 1) + prefixes[:, k], return_inverse=True)
        of = np.repeat(stripe, flat["width"])
        code, inverse = np.unique(of * (len(names) + 1) + nexts, return_inverse=True)
        total = np.zeros(len(code), np.int64)
        np.add.at(total, inverse, flat["count"])
        keep = total >= least
        code, counts = code[keep], total[keep]
        owner, last = code // (len(names) + 1), code % (len(names) + 1)
        _, example = np.unique(stripe, return_index=True)
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        bounds = np.append(starts, len(owner))
        heads = names[prefixes[example[owner[starts]]].ravel()]
        offsets = pa.array(np.arange(len(starts) + 1) * (n - 1), pa.int32())
        return pa.table({
            "lang": pa.array([lang] * len(starts) + [lang], pa.string()),
            "prefix": pa.concat_arrays([pa.ListArray.from_arrays(offsets, pa.array(heads, pa.string())),
                                        pa.array([None], pa.list_(pa.string()))]),
            "next": pa.concat_arrays([pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(names[last], pa.string())),
                                      pa.array([None], pa.list_(pa.string()))]),
            "count": pa.concat_arrays([pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(counts, pa.int64())), pa.array([None], pa.list_(pa.int64()))]),
            "total": pa.array([None] * len(starts) + [int(total.sum()) if n == 1 else 0], pa.int64())})

    return merge


def merged_stripes(docs: DataFrame, text: str, lang: str, how: Collocations) -> DataFrame:
    """(lang, prefix, next, count, total): for each prefix its next words with at least ``how.least`` occurrences.

    Rows with a null prefix have, in ``total``, words of the language; their sum is all its words.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(OTHER)).alias("lang"),
                       F.col(text).cast("string").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    parts = max(1, math.ceil((size or 0) / how.part_bytes))
    held = rows.mapInArrow(_counted(parts, how), STRIPES)
    return held.groupBy("lang", "n", "part").applyInArrow(
        _merge(how.least), "lang string, prefix array<string>, next array<string>, count array<long>, total long")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", how: Collocations = Collocations()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``how.first`` phrases by score.

    Texts are cut into pieces at punctuation and line ends and those into words at blanks and tabs, A-Z lower-cased.
    A task counts the words after each prefix of 0, 1, ... words (a stripe); stripes of all tasks are cut into segments
    by their next words, dealt by prefix and segment, and merged elementwise. A merged stripe gives its prefix's
    extensions, the stripe before it the prefix's own total, and the greatest counts of longer phrases that hold a
    phrase decide whether it is dropped.

    ``a`` counts a phrase, ``l`` and ``r`` the two sides of the cut with the lowest ``score`` = floor(1000000 a a / (l r)),
    ties to the first cut; ``n`` is the number of words of the language. Ties in rank go to the larger ``a``, then
    to the smaller phrase by bytes. Sums are decimals of 38 digits. A null text is empty, a null language is "und".
    A text of any length is counted part by part. Repeated rows count as often as they are there. No rows, or no
    phrase that is frequent enough, give no rows; extra columns are ignored.
    """
    merged = written(merged_stripes(docs, text, lang, how), "stripes")
    sizes = merged.groupBy("lang").agg(F.sum("total").alias("n"))
    entries = merged.where("prefix IS NOT NULL").select(
        "lang", "prefix", F.explode(F.arrays_zip("next", "count")).alias("e")).select(
        "lang", F.concat("prefix", F.array("e.next")).alias("words"), F.col("e.count").alias("a"))
    entries = written(entries, "phrases")
    candidates = entries.where(F.size("words") > 1)
    # the most frequent longer candidate around each phrase
    longer = candidates.where(F.size("words") > 2)
    spans = [(i, n) for n in range(2, how.longest) for i in range(how.longest - n + 1)]
    if spans:
        inside = F.filter(F.array(*[F.when(F.size("words") >= F.lit(i + n + (1 if i == 0 else 0)), F.slice("words", i + 1, n))
                                    for i, n in spans]), lambda w: w.isNotNull())
        around = longer.select("lang", F.explode(inside).alias("words"), "a").groupBy("lang", "words").agg(F.max("a").alias("most"))
        candidates = candidates.join(around, ["lang", "words"], "left").where(
            F.col("most").isNull() | (100 * F.col("most") < how.covered * F.col("a"))).drop("most")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.withColumn("left", F.slice("words", F.lit(1), F.col("k"))).withColumn(
        "right", F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")))
    for side, name in (("left", "l"), ("right", "r")):
        totals = entries.select("lang", F.col("words").alias(side), F.col("a").alias(name))
        cuts = salted_join(cuts, totals, ["lang", side])
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    over = (wide["a"] * wide["a"]).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    cuts = cuts.withColumn("over", over).withColumn("under", (wide["l"] * wide["r"]).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("over div under").cast("long"))
    scored = cuts.groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s")).select(
        "lang", F.array_join("words", " ").alias("phrase"), "a", "s.l", "s.r", "s.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the first of each share of a language, then the first of those
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = scored.withColumn("share", share).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= how.first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= how.first)
    return ranked.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
