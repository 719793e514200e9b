"""Which intervals hold a point: both sides meet in nodes of a tree, so no interval is cut along its length.

A node of level k and index i stands for the 16^k whole numbers from i * 16^k on.  An interval is the disjoint union of
at most 30 nodes of each level; a point lies in one node of each level.  Interval and point therefore share exactly one
node if the interval holds the point, and none otherwise: the node is an equi-join key.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = 16
TOP = 3  # the largest nodes: 16^3 spans of 64 days, about 718 years
SPAN_DAYS = 64
OPEN = BASE ** (TOP + 1)  # spans up to the year 13,452; dates end with 9999
DAY_TOP = 5  # the largest nodes over days: 16^5 days
OPEN_DAY = BASE ** (DAY_TOP + 1)


def _node(level: Column, index: Column) -> Column:
    return (index * 8 + level).cast("long")


def _run(level: Column, first: Column, end: Column) -> Column:
    return F.when(first < end, F.transform(F.sequence(first, end - 1), lambda i: _node(level, i)))


def interval_nodes(first: Column, end: Column, top: int = TOP) -> Column:
    """Nodes of the whole numbers from ``first`` to before ``end``; none if there are none."""
    def above(k, column, rounded):  # where the next level takes over; there is none above the top
        return rounded(column / BASE ** (k + 1)) * BASE if k < top else F.floor(end / BASE ** k)

    levels = F.array(*[
        F.struct(F.lit(k).alias("k"), F.ceil(first / BASE ** k).alias("low"), F.floor(end / BASE ** k).alias("high"),
                 above(k, first, F.ceil).alias("left"), above(k, end, F.floor).alias("right"))
        for k in range(top + 1)])

    def at(x):
        left_end = F.least(x["left"], x["high"])
        return F.array(_run(x["k"], x["low"], left_end), _run(x["k"], F.greatest(x["right"], left_end), x["high"]))

    inside = F.filter(levels, lambda x: x["low"] < x["high"])
    return F.flatten(F.array_compact(F.flatten(F.transform(inside, at))))


def point_nodes(point: Column, top: int = TOP) -> Column:
    """The node of each level that holds ``point``."""
    return F.array(*[_node(F.lit(k), F.floor(point / BASE ** k)) for k in range(top + 1)])


def day_candidates(asked: DataFrame, intervals: DataFrame, keys, value: str, largest: bool = True) -> DataFrame:
    """(keys, span, held): for each asked span of 64 days pieces (lo, hi, value) that tell the best value of each day.

    ``asked(keys, span)`` names the spans that are wanted, each once; ``intervals(keys, lo, hi, value)`` holds day
    numbers, both ends inside, an end of null is open.  Spans that an interval covers wholly are met by their nodes,
    each with one best value; the at most two spans where it begins or ends are lowest nodes, with the days held.
    A span gathers one value a level and at most 64 * 65 / 2 different pieces, however many intervals there are, and
    intervals are read once.
    """
    keys, best = list(keys), F.max if largest else F.min
    first, last = F.floor(F.col("lo") / SPAN_DAYS), F.floor(F.col("hi") / SPAN_DAYS)
    whole_from = F.ceil(F.col("lo") / SPAN_DAYS)
    whole_end = F.coalesce(F.floor((F.col("hi") + 1) / SPAN_DAYS), F.lit(OPEN))
    ends = F.array_distinct(F.array_compact(F.array(
        F.when((first < whole_from) | (first >= whole_end), first),
        F.when((last < whole_from) | (last >= whole_end), last))))

    def entry(node, lo, hi):
        return F.struct(node.alias("node"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    entries = F.concat(
        F.transform(interval_nodes(whole_from, whole_end), lambda n: entry(n, F.lit(0), F.lit(SPAN_DAYS - 1))),
        F.transform(ends, lambda s: entry(_node(F.lit(0), s), F.greatest(F.col("lo") - s * SPAN_DAYS, F.lit(0)),
                                          F.least(F.col("hi") - s * SPAN_DAYS, F.lit(SPAN_DAYS - 1)))))
    best_of = (
        intervals.filter(F.col("hi").isNull() | (F.col("lo") <= F.col("hi")))
        .select(*keys, F.explode(entries).alias("_e"), value)
        .groupBy(*keys, "_e.node", "_e.lo", "_e.hi").agg(best(value).alias(value))
    )
    return (
        asked.select(*keys, "span", F.explode(point_nodes(F.col("span"))).alias("node")).join(best_of, [*keys, "node"])
        .groupBy(*keys, "span").agg(F.collect_list(F.struct("lo", "hi", value)).alias("held"))
    )


def span_of(day: Column) -> Column:
    return F.floor(day / SPAN_DAYS)


def best_on(day: Column, value: str, largest: bool = True, held: str = "held") -> Column:
    """The best value among ``held`` on a day, null if nothing holds it."""
    at = F.pmod(day, F.lit(SPAN_DAYS))
    values = F.transform(F.filter(F.col(held), lambda p: (p["lo"] <= at) & (p["hi"] >= at)), lambda p: p[value])
    return F.array_max(values) if largest else F.array_min(values)
