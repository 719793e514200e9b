"""Interval nodes and daily bests against plain loops."""

import random

from pyspark.sql import functions as F

from hedgerow.operators import intervals as I


def test_interval_and_point_share_one_node(spark):
    rng = random.Random(3)
    pairs = [(-40, -40), (-70, 90), (0, 1), (5, 4), (-(1 << 14), 1 << 15), (7, I.OPEN)]
    pairs += [(a, a + rng.randrange(0, 200)) for a in (rng.randrange(-300, 300) for _ in range(150))]
    points = [*range(-80, 80), -(1 << 14) - 1, -(1 << 14), (1 << 15) - 1, 1 << 15, I.OPEN - 1]
    nodes = spark.createDataFrame(pairs, "a long, b long").select(
        "a", "b", I.interval_nodes(F.col("a"), F.col("b")).alias("n")).collect()
    at = {r.p: set(r.n) for r in spark.createDataFrame([(p,) for p in points], "p long").select(
        "p", I.point_nodes(F.col("p")).alias("n")).collect()}
    for r in nodes:
        assert len(set(r.n)) == len(r.n) <= 30 * (I.TOP + 1) or r.b > I.OPEN
        for p in points:
            assert len(at[p] & set(r.n)) == (r.a <= p < r.b)


def test_best_on_each_day_against_a_loop(spark):
    rng = random.Random(5)
    held = []
    for i in range(300):
        lo = rng.randrange(-700, 700)
        held.append((f"k{i % 3}", lo, None if rng.random() < 0.1 else lo + rng.choice([-1, 0, 5, 63, 64, 127, 400, 2_900_000]), i))
    asked = [(f"k{k}", s) for k in range(4) for s in (-12, -3, -1, 0, 1, 2, 9, 45_000)]
    a = spark.createDataFrame(asked, "k string, span long")
    b = spark.createDataFrame(held, "k string, lo int, hi int, v int")
    for largest in (True, False):
        found = I.day_candidates(a, b, ["k"], "v", largest).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(63))))
        found = found.select("k", "span", "d", I.best_on(F.col("span") * 64 + F.col("d"), "v", largest).alias("v"))
        got = {(r.k, r.span, r.d): r.v for r in found.collect()}
        for k, span in asked:
            for d in range(64):
                day = span * 64 + d
                live = [v for key, lo, hi, v in held if key == k and lo <= day and (hi is None or day <= hi)]
                want = (max if largest else min)(live) if live else None
                assert got.get((k, span, d)) == want


def test_far_dates_make_no_more_rows(spark):
    """One open interval and one probe in 9999: a few nodes, not a piece for every 64 days."""
    b = spark.createDataFrame([("k", 0, None, 1)], "k string, lo int, hi int, v int")
    assert b.select(F.size(I.interval_nodes(F.lit(0), F.lit(I.OPEN))).alias("n")).head().n <= 16 * (I.TOP + 1)
    far = spark.createDataFrame([("k", 2_932_896 // 64)], "k string, span long")
    assert [tuple(p) for p in I.day_candidates(far, b, ["k"], "v").head().held] == [(0, 63, 1)]
