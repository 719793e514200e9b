import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hedgerow.llm import toxicity
from hedgerow.llm.learning import labelled_hashes, logistic, logistic_rows
from hedgerow.llm.shared import remainder
from hedgerow.llm.toxicity import Model, Scanner, Toxicity
from hedgerow.llm.transducers import addressed, compose, grammar, negated, reported

LEXICON = {"=idiot": 5.0, "mord": 3.0}


def scored(text):
    total, matched, *sums = Scanner(LEXICON, 4.0).features(text)
    return round(math.expm1(total), 6), round(math.expm1(matched)), {
        k: round(math.expm1(v), 6) for k, v in zip(Scanner.OUTPUTS, sums) if v}


def test_patterns_weigh_clauses():
    assert scored("an Idiot here") == (5.0, 1, {"I": 5.0})
    assert scored("you are an idiot") == (7.5, 1, {"D": 7.5})
    assert scored("not an idiot") == (2.5, 1, {"M": 2.5})
    assert scored("he said what an idiot") == (3.0, 1, {"Q": 3.0})
    assert scored("you will not be hurt") == (4.0, 1, {"M": 4.0})
    assert scored("he said nothing. idiot!") == (5.0, 1, {"I": 5.0})
    assert scored("morden mord idiotic") == (3.0, 1, {"I": 3.0})
    assert scored("idiot. fine. idiot; idiot") == (15.0, 3, {"I": 15.0})
    assert scored("") == (0, 0, {})


@pytest.mark.parametrize("words", ["UNwIR", "RUINIT", "NNwwwI", "wTUT", "IRNI"])
def test_composition_equals_running_one_after_the_other(words):
    machines, states = [addressed(), negated(), reported()], [0, 0, 0]
    whole, at = grammar(), 0
    for symbol in words:
        out, weight = symbol, 1.0
        for k, machine in enumerate(machines):
            out, w, states[k] = machine.step(states[k], out)
            weight *= w
        got, product, at = whole.step(at, symbol)
        assert (got, pytest.approx(product)) == (out, weight)
    assert compose(addressed(), negated(), "ITUNRw").states == 8


def test_learns_and_keeps_rows(frame):
    docs = [(k, f"plain words number {k} follow" + (" you moron" if k % 2 else ""), k % 3) for k in range(120)]
    labels = frame([(k, k % 2, 1) for k in range(120)] + [(3, None, 1), (None, 1, 1), (3, 1, 1)], "doc_id long, toxic int, quality int")
    rows = frame([*docs, (500, None, 1), (501, "", 1), (None, "moron", 1), (501, "", 1)], "doc_id long, text string, toxicity int")
    model = toxicity.fit(rows, labels, remainder("doc_id", 5) != 0, Toxicity(least=3))
    assert "=moron" in model.lexicon
    got = toxicity.toxicity(rows, model)
    assert got.columns == ["doc_id", "text", "toxicity"] and got.count() == 124
    assert all((r.toxicity >= 0.5) == ("moron" in (r.text or "")) for r in got.collect())


def test_nothing_to_learn_from(frame):
    none = frame([], "doc_id long, text string")
    model = toxicity.fit(none, frame([], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.toxicity(none, model).count() == 0
    assert isinstance(model, Model) and 0 <= toxicity.toxicity(frame([(1, "x")], "doc_id long, text string"), model).first().toxicity <= 1


def test_every_labelled_text_counts(spark, frame):
    """A word that only stands in the toxic texts which come last by hash is learnt as well."""
    ids = [r.id for r in spark.range(3200).orderBy(F.xxhash64("id"), "id").collect()]
    docs = [(k, f"plain words {k}" + (" zorkan" if at >= 3100 else " idiot")) for at, k in enumerate(ids)]
    docs += [(k, f"plain words {k}") for k in range(4000, 4400)]
    labels = frame([(k, int(k < 4000)) for k, _ in docs], "doc_id long, toxic int")
    rows = frame(docs, "doc_id long, text string")
    model = toxicity.fit(rows, labels, F.lit(True))
    assert {"=zorkan", "=idiot"} <= set(model.lexicon)
    assert {r.doc_id for r in toxicity.toxicity(rows, model).where("toxicity >= 0.5").collect()} == set(ids)


def test_summed_steps_are_newtons(frame):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, 3))
    y = (x @ [1.0, -2.0, 0.5] + draw.normal(size=400) > 0).astype(int)
    rows = frame([(a.tolist(), int(b)) for a, b in zip(x, y)], "x array<double>, y int").repartition(5)
    assert np.allclose(logistic_rows(rows, 3), logistic(x, y), atol=1e-6)


def test_texts_are_not_moved_to_their_labels(spark, frame, monkeypatch):
    """What is joined to the labels are hashes; the model is that of the distinct texts, copies and nulls included."""
    draw = np.random.default_rng(2)
    rows = []
    for k in range(300):
        words = ["".join(chr(97 + c) for c in draw.integers(0, 26, 9)) for _ in range(10)]
        rows.append((k, " ".join(draw.choice(words, 2000)) + (" idiot" if k % 3 == 0 else "")))
    docs = frame(rows + rows[:60] + [(1000, None), (None, "idiot")], "doc_id long, text string")
    labels = frame([(k, int(k % 3 == 0)) for k, _ in rows] + [(1000, 0)], "doc_id long, toxic int")
    tables, sizes, write = [], [], toxicity.written
    monkeypatch.setattr(toxicity, "written", lambda df, label: tables.append(out := write(df, label)) or sizes.append(out.count()) or out)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        marks, share = labelled_hashes(docs, labels, "doc_id", "text", "toxic", F.lit(True))
        assert sorted(marks.columns) == ["h", "y"] and marks.count() == 301 and share == pytest.approx(100 / 301)
        model = toxicity.fit(docs, labels, F.lit(True))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert len(tables) == 2 and not [df.columns for df in tables if "text" in df.columns]
    assert sizes == [301, 301] and "=idiot" in model.lexicon
    assert all((r.toxicity >= 0.5) == ("idiot" in (r.text or "")) for r in toxicity.toxicity(docs, model).collect())
