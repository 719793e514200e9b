import numpy as np
import pytest
from pyspark.sql import functions as F

from hedgerow.llm import mixing
from hedgerow.llm.mixing import Mixing, calibrated, mix_sources, rake


def brute_rake(cells, targets, error=1e-4, rounds=50):
    w = np.array([c[-1] for c in cells], float)
    w /= w.sum()
    for _ in range(rounds):
        worst = 0
        for k, shares in enumerate(targets):
            for value, share in shares.items():
                rows = [i for i, c in enumerate(cells) if c[k] == value]
                total = w[rows].sum()
                worst = max(worst, abs(total / share - 1))
                w[rows] *= share / total
        if worst <= error:
            break
    return w * sum(c[-1] for c in cells) / np.array([c[-1] for c in cells])


CELLS = [("a", "x", 900), ("a", "y", 50), ("b", "x", 30), ("b", "y", 20), ("c", "y", 7)]


def test_raking_equals_numpy(frame):
    shares = [{"a": 0.4, "b": 0.4, "c": 0.2}, {"x": 0.5, "y": 0.5}]
    targets = {"s": frame(list(shares[0].items()), "s string, target double"), "l": frame(list(shares[1].items()), "l string, target double")}
    got = {(r.s, r.l): r.weight for r in rake(frame(CELLS, "s string, l string, tokens long"), targets).collect()}
    for (s, l, _), want in zip(CELLS, brute_rake(CELLS, shares)):
        assert got[s, l] == pytest.approx(want, rel=1e-6)


def test_probabilities_meet_the_budget(frame):
    rows = [("a", 100, 0.1), ("b", 100, 1.0), ("c", 100, 50.0), ("d", 0, 1.0)]
    cells = calibrated(frame(rows, "s string, tokens long, weight double"), 0.6).collect()
    assert all(0 <= r.probability <= 1 for r in cells)
    assert sum(r.tokens * r.probability for r in cells) == pytest.approx(180)
    assert {r.s: r.probability for r in cells}["c"] == 1


def test_sample_meets_the_margins(frame):
    rows = [(k, f"some words {k} " * 30, ("en", "de", None)[k % 3], "big" if k % 10 else f"small{k % 30}", 1) for k in range(3000)]
    odd = [(9000, None, "en", "big", 1), (9001, " ", "en", "big", 1), (None, "a b", "en", "big", 1), (1, rows[1][1], "de", "big", 1)]
    docs = frame([*rows, *odd], "doc_id long, text string, lang string, source string, mix_kept int")
    how = Mixing(budget=0.3)
    got = mix_sources(docs, how)
    assert got.columns == ["doc_id", "text", "lang", "source", "mix_weight", "mix_probability", "mix_kept"] and got.count() == 3004
    assert got.where("doc_id in (9000, 9001) and (mix_kept or mix_weight <> 0)").count() == 0
    kept = got.where("mix_kept")
    share = kept.where("source = 'big'").count() / kept.count()
    sizes = np.sqrt([2700, *[100] * 3])
    assert abs(kept.count() / 3000 - 0.3) < 0.04 and abs(share - sizes[0] / sizes.sum()) < 0.06
    again = mix_sources(docs.repartition(7), how).where("mix_kept")
    assert sorted(map(str, (r.doc_id for r in again.collect()))) == sorted(map(str, (r.doc_id for r in kept.collect())))
    one = mix_sources(docs, Mixing(budget=1.0, margins={"source": 1.0, "lang": 1.0, "topic": 1.0})).where("not mix_kept")
    assert {r.doc_id for r in one.collect()} == {9000, 9001}


def test_given_targets_and_many_cells(frame):
    docs = frame([(k, "w " * 10, "en", "ab"[k % 2]) for k in range(200)], "doc_id long, text string, lang string, source string")
    targets = {"source": frame([("a", 1.0)], "source string, target double")}
    got = mix_sources(docs, Mixing(cells=0, budget=0.5), attributes={"source": F.col("source")}, targets=targets)
    assert {(r.source, r.mix_kept) for r in got.collect()} == {("a", True), ("b", False)}


def test_no_rows(frame):
    none = frame([], "doc_id long, text string, lang string, source string")
    assert mix_sources(none).count() == 0 and mixing.Mixing()


def test_no_task_holds_all_cells_of_a_value(frame, monkeypatch):
    plans, put = [], mixing.written

    def seen(df, label):
        plans.append(df._jdf.queryExecution().toString())
        return put(df, label)

    monkeypatch.setattr(mixing, "written", seen)
    targets = {"s": frame([("a", 0.4), ("b", 0.4), ("c", 0.2)], "s string, target double"), "l": frame([("x", 0.5), ("y", 0.5)], "l string, target double")}
    rake(frame(CELLS, "s string, l string, tokens long"), targets, Mixing(rounds=2)).collect()
    assert len(plans) == 3 and not any("Window" in plan for plan in plans)


@pytest.mark.parametrize("cells", [0, 50_000])
def test_columns_of_any_name_are_kept(frame, cells):
    names = "doc_id long, text string, source string, lang string, _tokens int, _topic string, _salt int, __source string, mix_kept int"
    rows = [(k, "one two three " * (k + 1), "ab"[k % 2], "en", 7, "keep", 5, "s", 9) for k in range(6)]
    got = mixing.mix_sources(frame(rows, names), mixing.Mixing(cells=cells)).orderBy("doc_id").collect()
    assert [(r._tokens, r._topic, r._salt, r["__source"]) for r in got] == [(7, "keep", 5, "s")] * 6
    assert {type(r.mix_kept) for r in got} == {bool}
