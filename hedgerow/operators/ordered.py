"""Ordered scans (neighbour, running total, carry forward) that survive a hot key.

A plain window over one key sorts all its rows in one task.  Here the sequence of a long key (more
than ``BLOCK_ROWS`` rows) is cut into blocks (a coarse, monotone function of the order), the window
runs per (key, block), one summary row per block is scanned per key, and the carried value is joined
back on (key, block).  All other keys are one block: their rows are shuffled once, or not at all if
they already are dealt by key, and nothing is summarised or joined back.

Which keys are long is counted first (``long_keys``), or passed on as ``long`` where it is known.
Rows with a null key are scanned block by block, without a carry.  ``block`` must not decrease along ``order``.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hedgerow.operators.lineage import written

BLOCK_ROWS = 16_384
COUNTED = object()


def long_keys(df: DataFrame, keys) -> DataFrame | None:
    """Keys with more than ``BLOCK_ROWS`` rows, as a small table; None if there are none."""
    found = df.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > BLOCK_ROWS).select(*keys)
    found = written(found, "long-keys")
    return None if found.isEmpty() else found


def known(df: DataFrame):
    """What ``noted`` says about the long keys of ``df``; if nothing, they are to be counted."""
    return getattr(df, "_long", COUNTED)


def noted(df: DataFrame, long: DataFrame | None) -> DataFrame:
    """Note the long keys of ``df`` for the scans that follow."""
    df._long = long
    return df


def _blocked(df: DataFrame, keys, block: Column, long) -> tuple[DataFrame, bool]:
    """``df`` with ``_block``, null where a key is one block, and ``_long``; and whether any key is long."""
    long = long_keys(df, keys) if long is COUNTED else long
    unkeyed = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    if long is None:
        return df.withColumn("_long", F.lit(False)).withColumn("_block", F.when(unkeyed, block)), False
    marks = F.broadcast(long.dropna(subset=list(keys)).withColumn("_long", F.lit(True)))
    marked = df.join(marks, list(keys), "left").select(*df.columns, F.coalesce("_long", F.lit(False)).alias("_long"))
    return marked.withColumn("_block", F.when(F.col("_long") | unkeyed, block)), True


def seq_block(seq: str, rows: int = BLOCK_ROWS) -> Column:
    """Block of an integer position: at most ``rows`` rows each."""
    return F.floor(F.col(seq) / rows)


def time_block(ts: str, seconds: int = 3600) -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))


def _windows(keys, order):
    inner = Window.partitionBy(*keys, "_block").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy("_block")
    return inner, outer


def _stitch(local: DataFrame, carried: DataFrame, keys) -> DataFrame:
    return local.join(carried, [*keys, "_block"], "left")


def with_neighbours(df: DataFrame, keys, order, cols, block: Column, long=COUNTED) -> DataFrame:
    """Add ``prev`` and ``next``: structs of ``cols`` of the rows before and after, null at the ends."""
    inner, outer = _windows(keys, order)
    row = F.struct(*cols)
    blocked, any_long = _blocked(df, keys, block, long)
    local = blocked.withColumn("prev", F.lag(row).over(inner)).withColumn("next", F.lead(row).over(inner))
    if not any_long:
        return local.drop("_block", "_long")
    at = F.struct(*order)
    edges = (
        local.filter(F.col("_long") & (F.col("prev").isNull() | F.col("next").isNull()))
        .groupBy(*keys, "_block")
        .agg(F.min_by(row, at).alias("_first"), F.max_by(row, at).alias("_last"))
    )
    carried = (
        edges.withColumn("_before", F.lag("_last").over(outer))
        .withColumn("_after", F.lead("_first").over(outer))
        .filter(F.col("_before").isNotNull() | F.col("_after").isNotNull())
        .select(*keys, "_block", "_before", "_after")
    )
    return (
        _stitch(local, carried, keys)
        .withColumn("prev", F.coalesce("prev", "_before"))
        .withColumn("next", F.coalesce("next", "_after"))
        .drop("_block", "_long", "_before", "_after")
    )


def running_total(df: DataFrame, keys, order, value: Column, out: str, block: Column, long=COUNTED) -> DataFrame:
    """Add ``out``: sum of ``value`` up to and including the row."""
    inner, outer = _windows(keys, order)
    blocked, any_long = _blocked(df, keys, block, long)
    local = blocked.withColumn("_value", value).withColumn(
        out, F.sum("_value").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    if not any_long:
        return local.drop("_block", "_long", "_value")
    sums = local.filter("_long").groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    carried = (
        sums.withColumn("_carry", F.sum("_sum").over(outer.rowsBetween(Window.unboundedPreceding, -1)))
        .filter(F.col("_carry").isNotNull())
        .select(*keys, "_block", "_carry")
    )
    return (
        _stitch(local, carried, keys)
        .withColumn(out, F.when(F.col("_carry").isNull(), F.col(out)).otherwise(F.col(out) + F.col("_carry")))
        .drop("_block", "_long", "_value", "_carry")
    )


def carry_forward(df: DataFrame, keys, order, value: Column, out: str, block: Column, long=COUNTED) -> DataFrame:
    """Add ``out``: last non-null ``value`` at or above the row."""
    inner, outer = _windows(keys, order)
    blocked, any_long = _blocked(df, keys, block, long)
    local = blocked.withColumn("_value", value).withColumn(
        out, F.last("_value", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    if not any_long:
        return local.drop("_block", "_long", "_value")
    # a block without a value still has to receive one from above
    at = F.when(F.col("_value").isNotNull(), F.struct(*order))
    blocks = local.filter("_long").groupBy(*keys, "_block").agg(F.max_by("_value", at).alias("_last"))
    carried = (
        blocks.withColumn("_carry", F.last("_last", ignorenulls=True)
                          .over(outer.rowsBetween(Window.unboundedPreceding, -1)))
        .filter(F.col("_carry").isNotNull())
        .select(*keys, "_block", "_carry")
    )
    return (
        _stitch(local, carried, keys)
        .withColumn(out, F.coalesce(out, "_carry"))
        .drop("_block", "_long", "_value", "_carry")
    )


def islands(df: DataFrame, keys, order, cols, starts_new, out: str, block: Column, long=COUNTED) -> DataFrame:
    """Add ``out``: 1-based number of the stretch a row belongs to.

    ``starts_new(before, row)`` says whether a row opens a new stretch, given structs of ``cols``.
    Stretches are counted within each block; where blocks meet, the last row of one is compared
    with the first row of the next.
    """
    inner, outer = _windows(keys, order)

    def opened(before, row):
        return F.when(before.isNull(), 0).when(starts_new(before, row), 1).otherwise(0)

    blocked, any_long = _blocked(df, keys, block, long)
    local = (
        blocked.withColumn("_row", F.struct(*cols))
        .withColumn("_prev", F.lag("_row").over(inner))
        .withColumn("_new", opened(F.col("_prev"), F.col("_row")))
        .withColumn(out, F.sum("_new").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    )
    if not any_long:
        return local.withColumn(out, F.col(out) + 1).drop("_block", "_long", "_row", "_prev", "_new")
    at = F.struct(*order)
    blocks = local.filter("_long").groupBy(*keys, "_block").agg(
        F.min_by("_row", at).alias("_first"), F.max_by("_row", at).alias("_last"), F.sum("_new").alias("_sum"))
    carried = (
        blocks.withColumn("_before", F.lag("_last").over(outer))
        .withColumn("_open", opened(F.col("_before"), F.col("_first")))
        .withColumn("_carry", F.sum("_sum").over(outer.rowsBetween(Window.unboundedPreceding, -1))
                    + F.sum("_open").over(outer.rowsBetween(Window.unboundedPreceding, 0)))
        .filter(F.col("_carry").isNotNull())
        .select(*keys, "_block", "_carry")
    )
    return (
        _stitch(local, carried, keys)
        .withColumn(out, F.col(out) + F.coalesce("_carry", F.lit(0)) + 1)
        .drop("_block", "_long", "_row", "_prev", "_new", "_carry")
    )


def position(df: DataFrame, keys, order, out: str, block: Column, long=COUNTED) -> DataFrame:
    """Add ``out``: 1-based position of the row within its key."""
    return running_total(df, keys, order, F.lit(1).cast("long"), out, block, long)
