"""Hard negatives: intervals hold every score, results equal brute force."""

import math

import numpy as np
import pytest

from hedgerow.llm.hardneg import HardNegatives, Query, codes, hard_negatives, rotation


@pytest.mark.parametrize("dims", [1, 3, 64, 100])
@pytest.mark.parametrize("planes", [1, 4, 8])
def test_intervals_hold_every_score(dims, planes):
    rng = np.random.default_rng(dims)
    turn = rotation(dims, 7)
    assert np.allclose(turn @ turn.T, np.eye(dims))
    rows = rng.integers(-256, 256, (400, dims))
    rows[0] = 0
    rows[1] = rows[2]
    words, along, rest = codes(rows, turn)
    wide = []
    for asked in (rows[2], rows[3], rows[0], -rows[4], rng.integers(-1 << 20, 1 << 20, dims)):
        low, high = Query(asked, turn, planes).interval(words, along, rest)
        scores = rows @ asked
        assert (low <= scores).all() and (scores <= high).all()
        wide.append((high - low).mean() / (1 + np.linalg.norm(asked) * np.linalg.norm(rows, axis=1).mean()))
    if planes == 8:
        assert max(wide) < 1.5  # 2 if nothing were known


def brute(rows, how=HardNegatives()):
    whole = [(i, [math.floor(256 * float(x)) for x in e], y) for i, e, y in rows
             if i is not None and y is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    anchors = {}
    for i, e, y in sorted((r for r in whole if r[0] % 100 == 0), key=lambda r: (r[0], r[2], r[1])):
        anchors.setdefault(i, (e, y))
    for a, (q, y) in anchors.items():
        scored = sorted((-sum(map(lambda p, r: p * r, q, e)), i, other) for i, e, other in whole if i != a and len(e) == len(q))
        for s, p, _ in [x for x in scored if x[2] == y][: how.positives]:
            near = [x for x in scored if x[2] != y and 80 * -s <= 100 * -x[0] <= 100 * -s][: how.negatives]
            out += [(a, p, r + 1, i, -s, -n) for r, (n, i, _) in enumerate(near)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int, id string, dims int, part string"


@pytest.mark.parametrize("how", [HardNegatives(), HardNegatives(rows=60, anchors=2, planes=3)])
def test_against_brute_force(spark, how):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(420):
        e = (rng.standard_normal(12) + 0.6 * (i % 3)).round(1).tolist()
        rows.append((i, e, int(rng.integers(0, 4))))
    for i in range(420, 470):  # ties and repeated rows
        rows.append((i, rows[7][1], i % 2))
    rows += [rows[7], rows[7], rows[100], (100, rows[5][1], 0), (500, [0.0] * 12, 1), (600, [-1.0] * 12, 2)]
    rows += [(700, None, 1), (800, [1.0] * 12, None), (900, [1.0, None], 1), (1000, [float("nan")] * 12, 1),
             (1100, [float("inf")] * 12, 1), (1200, [1.0, 2.0], 1), (1201, [1.0, 2.5], 1), (1202, [1.5, 1.5], 2),
             (1300, [], 1), (1301, [], 1), (1302, [], 2), (None, [1.0] * 12, 1)]
    df = spark.createDataFrame([(*r, "x", 3, "y") for r in rows], SCHEMA)
    found = hard_negatives(df, lambda i: i % 100 == 0, how=how).collect()
    assert sorted(tuple(r) for r in found) == brute(rows, how)
    assert len(found) > 60


def test_empty_table(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA), lambda i: i % 100 == 0).count() == 0


def test_large_components_are_exact(spark):
    rows = [(0, [3.0e4, 1.0], 1), (1, [3.0e4, 2.0], 1), (2, [2.9e4, 0.5], 2), (3, [1e30, 1.0], 2), (4, [2.9e4, 0.25], 2)]
    df = spark.createDataFrame([(*r, "x", 3, "y") for r in rows], SCHEMA)
    found = hard_negatives(df, lambda i: i % 100 == 0).collect()
    assert sorted(tuple(r) for r in found) == brute([r for r in rows if r[0] != 3])
