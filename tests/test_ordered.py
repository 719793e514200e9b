"""Ordered scans must not depend on where blocks are cut; checked with one hot key and tiny blocks."""

import random

import pytest
from pyspark.sql import functions as F

from hedgerow.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [("hot", i, rng.choice([None, "a", "b"]), rng.randrange(5)) for i in range(0, 400, 1) if i % 17]
    data += [(f"k{k}", i, rng.choice([None, "x"]), 1) for k in range(20) for i in range(rng.randrange(1, 4))]
    return data, spark.createDataFrame(data, "k string, seq int, tag string, v int").repartition(5).cache()


def by_key(data):
    keys = {}
    for row in sorted(data, key=lambda r: (r[0], r[1])):
        keys.setdefault(row[0], []).append(row)
    return keys


@pytest.mark.parametrize("size", [1, 3, 10_000])
def test_neighbours(rows, size):
    data, df = rows
    got = {(r.k, r.seq): (r.prev and r.prev.v, r.next and r.next.v, r.prev is None, r.next is None)
           for r in ordered.with_neighbours(df, ["k"], ["seq"], ["v"], ordered.seq_block("seq", size)).collect()}
    assert len(got) == len(data)
    for items in by_key(data).values():
        for i, r in enumerate(items):
            before = items[i - 1] if i else None
            after = items[i + 1] if i + 1 < len(items) else None
            assert got[r[0], r[1]] == (before and before[3], after and after[3], before is None, after is None)


@pytest.mark.parametrize("size", [1, 3, 10_000])
def test_running_total_carry_position(rows, size):
    data, df = rows
    block = ordered.seq_block("seq", size)
    out = ordered.running_total(df, ["k"], ["seq"], F.col("v"), "total", block)
    out = ordered.carry_forward(out, ["k"], ["seq"], F.col("tag"), "held", block)
    out = ordered.position(out, ["k"], ["seq"], "n", block)
    got = {(r.k, r.seq): (r.total, r.held, r.n) for r in out.collect()}
    for items in by_key(data).values():
        total, held = 0, None
        for i, r in enumerate(items):
            total, held = total + r[3], r[2] or held
            assert got[r[0], r[1]] == (total, held, i + 1)


@pytest.mark.parametrize("size", [1, 3, 10_000])
def test_islands(rows, size):
    data, df = rows
    out = ordered.islands(df, ["k"], ["seq"], ["tag"], lambda a, b: ~b.eqNullSafe(a), "run", ordered.seq_block("seq", size))
    got = {(r.k, r.seq): r.run for r in out.collect()}
    for items in by_key(data).values():
        run = 0
        for i, r in enumerate(items):
            run += i == 0 or items[i - 1][2] != r[2]
            assert got[r[0], r[1]] == run


@pytest.fixture(params=["counted", "long", "none long"])
def long(request, rows, monkeypatch):
    """Long keys counted by the scan, passed on, or none: the results are the same."""
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 50)
    if request.param == "counted":
        return ordered.COUNTED
    return ordered.long_keys(rows[1], ["k"]) if request.param == "long" else None


def test_long_keys_alone_are_cut(rows, monkeypatch):
    assert ordered.long_keys(rows[1], ["k"]) is None
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 50)
    assert [r.k for r in ordered.long_keys(rows[1], ["k"]).collect()] == ["hot"]


def test_scans_with_and_without_long_keys(rows, long):
    data, df = rows
    block = ordered.seq_block("seq", 7)
    out = ordered.with_neighbours(df, ["k"], ["seq"], ["v"], block, long)
    out = ordered.running_total(out, ["k"], ["seq"], F.col("v"), "total", block, long)
    out = ordered.carry_forward(out, ["k"], ["seq"], F.col("tag"), "held", block, long)
    out = ordered.islands(out, ["k"], ["seq"], ["tag"], lambda a, b: ~b.eqNullSafe(a), "run", block, long)
    got = {(r.k, r.seq): (r.prev and r.prev.v, r.next and r.next.v, r.total, r.held, r.run) for r in out.collect()}
    assert len(got) == len(data)
    for items in by_key(data).values():
        total, held, run = 0, None, 0
        for i, r in enumerate(items):
            before, after = items[i - 1] if i else None, items[i + 1] if i + 1 < len(items) else None
            total, held, run = total + r[3], r[2] or held, run + (before is None or before[2] != r[2])
            assert got[r[0], r[1]] == (before and before[3], after and after[3], total, held, run)


def test_short_keys_are_dealt_once(rows, capsys):
    """Two scans over rows that are dealt by key need no further exchange."""
    df = rows[1].repartition("k")
    out = ordered.position(df, ["k"], ["seq"], "n", ordered.seq_block("seq", 1))
    ordered.islands(out, ["k"], ["n"], ["tag"], lambda a, b: ~b.eqNullSafe(a), "run", ordered.seq_block("n")).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1
