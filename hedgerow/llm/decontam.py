"""Benchmark decontamination by spaced seeds: masks that no passing overlap can miss, then checks around the hits.

Only DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgerow.llm.shared import written


@dataclass(frozen=True)
class Decontamination:
    """An overlap counts if, of ``window`` tokens in a row (all tokens of a shorter item), ``percent`` % are equal.

    ``rows``: benchmark hashes up to which they are broadcast (16 bytes each); beyond it they are shuffled.
    """

    window: int = 20
    percent: int = 80
    rows: int = 1_000_000

    def mask(self, width: int) -> str:
        """The tokens that are hashed (1) and ignored (0) for overlaps of ``width`` tokens.

        If ``differ`` tokens of an overlap that counts may be changed, they cannot lie in all of the ``differ + 1`` sets
        of every (differ + 1)-th token. One of these sets is whole, and the mask fits it: 1000010000100001 for 4 of 20
        tokens, 100010001 for 3 of 15, 1001001001 for 2 of 12, 10101 for 1 of 7; where none may differ, up to 4 in a row.
        """
        differ = width - (width * self.percent + 99) // 100
        return ("1" + "0" * differ) * (min(4, width // (differ + 1)) - 1) + "1" if width > differ else "1"

    @property
    def masks(self) -> tuple[str, ...]:
        """The masks of all widths, widest first."""
        return tuple(dict.fromkeys(self.mask(n) for n in range(self.window, 0, -1)))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def _hashed(text: str) -> Column:
    return F.transform(tokens(F.col(text).cast("string")), lambda x: F.xxhash64(x))


def _placed(rows: DataFrame, key: str, masks: list[str]) -> DataFrame:
    """(key, position of its first token, hash) of each mask laid on every position; fewer tokens than it spans: none.

    All masks are laid in one pass, so that a text is cut into tokens once.
    """
    def laid(mask):
        kept = [k for k, c in enumerate(mask) if c == "1"]
        starts = F.when(F.size("h") >= len(mask), F.sequence(F.lit(0), F.size("h") - len(mask))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(mask), *[F.get("h", i + k) for k in kept]).alias("hash")))

    return rows.select(key, F.explode(F.concat(*map(laid, masks))).alias("seed")).select(key, "seed.at", "seed.hash")


def overlaps(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id",
             item_text: str = "text", how: Decontamination = Decontamination()) -> DataFrame:
    """(id, item, matched, compared, doc_at) for each document and benchmark item that overlap, at their best alignment.

    A mask for the item's compared width (``how.mask``) is laid on every position of benchmark and documents, over whole
    texts, and the tokens it keeps are hashed; every overlap that counts has an equal hash whatever tokens were
    substituted. Equal hashes propose an alignment; there the tokens are compared one by one, and the best
    ``how.window`` in a row decide, so chance hits are dropped. ``doc_at``: first token of the best window in the document; ties go to the earlier one.

    Null and empty texts overlap with nothing. Rows with a null id cannot be named and are left out. Rows with equal
    ids are looked at one by one and reported once. No rows give no rows; extra columns are ignored.
    """
    items = written(benchmark.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), _hashed(item_text).alias("h")).where(
        F.size("h") > 0).distinct(), "items")
    rows = docs.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), _hashed(text).alias("h"))
    least = F.least(F.lit(how.window), F.size("h"))
    # at most ``how.window`` widths, and fewer masks
    widths = {r.n for r in items.select(least.alias("n")).distinct().collect()} or {1}  # no items, no rows
    masks = sorted({how.mask(n) for n in widths})

    # an item is hashed by the mask of its own width, a document by all of them
    known = written(reduce(DataFrame.unionByName, [
        _placed(items.where(least.isin([n for n in widths if how.mask(n) == mask])), "item", [mask]) for mask in masks]).distinct(), "seeds")
    # the width is known by then: hashes, items and positions of the benchmark alone
    few = known.count() <= how.rows
    sized = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    seen = sized(known.select("hash").distinct())
    hits = written(_placed(rows, "id", masks).join(seen, "hash"), "hits")
    starts = hits.join(sized(known.select("hash", "item", F.col("at").alias("b"))), "hash").select(
        "id", "item", (F.col("at") - F.col("b")).alias("shift")).distinct()
    wanted = written(starts, "alignments")
    texts = rows.join(wanted.select("id").distinct(), "id", "left_semi")
    sided = wanted.join(texts, "id").join(items.select("item", F.col("h").alias("g")), "item")
    width = F.least(F.lit(how.window), F.size("g"))
    first = F.greatest(F.lit(0), -F.col("shift"))  # first token of the item that lies on the document
    # another row with the same id may be too short to reach the alignment
    count = F.greatest(F.lit(0), F.least(F.size("g"), F.size("h") - F.col("shift")) - first)
    equal = F.zip_with(F.slice("h", F.col("shift") + first + 1, count), F.slice("g", first + 1, count), lambda x, y: (x == y).cast("int"))
    sided = sided.select("id", "item", "shift", width.alias("width"), first.alias("first"), equal.alias("e")).where(F.size("e") >= F.col("width"))
    sums = F.transform(F.sequence(F.lit(0), F.size("e") - F.col("width")), lambda i: F.struct(
        F.aggregate(F.slice("e", i + 1, F.col("width")), F.lit(0), lambda s, x: s + x).alias("matched"), (-i).alias("back")))
    best = sided.withColumn("best", F.array_max(sums)).select(
        "id", "item", F.col("best.matched").alias("matched"), F.col("width").alias("compared"),
        (F.col("shift") + F.col("first") - F.col("best.back")).alias("at"))
    good = best.where(F.col("matched") * 100 >= F.col("compared") * how.percent)
    ranked = good.groupBy("id", "item").agg(F.max(F.struct("matched", (-F.col("at")).alias("back"), "compared")).alias("s"))
    return ranked.select(F.col("id").alias(id), F.col("item").alias(item), "s.matched", "s.compared", (-F.col("s.back")).alias("doc_at"))


def clean(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", how: Decontamination = Decontamination(), **columns) -> DataFrame:
    """``docs`` without the documents that overlap with the benchmark; rows with a null id stay."""
    bad = overlaps(docs, benchmark, id, how=how, **columns).select(id).distinct()
    return docs.join(bad, id, "left_anti")
