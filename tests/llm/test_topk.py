import math
import random

from hedgerow.llm.topk import TopK, top_k

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, k, every):
    good = [(i, v) for i, v, _ in rows if i is not None and v is not None and all(
        x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in good]
    out = set()
    for q, a in {i: a for i, a in reversed(whole)}.items():
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(b) == len(a))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def found(df):
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()}


def test_equals_brute_force_with_ties_over_many_blocks(frame):
    random.seed(1)
    rows = [(i, [random.choice((-0.5, 0.25, 1.0)) for _ in range(4)], 0) for i in range(120)]
    how = TopK(k=7, rows=16, queries=3, bins=4)
    assert found(top_k(frame(rows, SCHEMA), lambda i: i % 5 == 0, how=how)) == brute(rows, 7, 5)


def test_one_vector_held_by_most_rows(frame):
    rows = [(i, [1.0, 2.0], 0) for i in range(90)] + [(90 + i, [float(i), 1.0], 0) for i in range(10)]
    assert found(top_k(frame(rows, SCHEMA), lambda i: i % 20 == 0, how=TopK(rows=32))) == brute(rows, 20, 20)


def test_odd_vectors_take_no_part(frame):
    rows = [(0, [1.0, 0.0], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 1),
            (5, [1.0], 1), (6, [0.5, 0.5], 1), (None, [1.0, 1.0], 1), (7, [-3.0, 9.0], 1), (8, [3e30, 1.0], 1)]
    got = found(top_k(frame(rows, SCHEMA), lambda i: i % 20 == 0))
    assert got == {(0, 1, 6, 2048), (0, 2, 7, -12288)}


def test_large_components_stay_exact(frame):
    rows = [(0, [1e6, 1.0], 0), (1, [1e6, 2.0], 0), (2, [1e6, 1.5], 0)]
    assert found(top_k(frame(rows, SCHEMA), lambda i: i % 20 == 0)) == brute(rows, 20, 20)


def test_no_rows(frame):
    assert found(top_k(frame([], SCHEMA), lambda i: i % 20 == 0)) == set()
