import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hedgerow.llm import quality
from hedgerow.llm.quality import FEATURES, Quality, _forward, _gradients, passages
from hedgerow.llm.learning import sigmoid


def test_passages_cover_whole_texts():
    texts = pa.array(["a b c d e", None, "", "x " * 7, " \n"])
    owner, x = passages(texts, 3)
    assert owner.tolist() == [0, 0, 1, 2, 3, 3, 3, 4] and x.shape == (8, FEATURES)
    assert (x[[2, 3, 7]] == 0).all()
    assert np.isclose(x[4, 8], 2 / 3) and np.isclose(x[4, 10], 1 / 3)  # repeated and distinct words of "x x x"


def test_long_texts_in_parts_give_the_same_passages():
    random = np.random.default_rng(3)
    long = " ".join(random.choice(["ab", "ab", "c|", "Déf", "1.2", "!!"], 5000))
    texts = pa.array(["a b", long, "", "  " + long[:700] + "\n", None, "x"])
    owner, x = passages(texts, 7)
    for size in (64, 1000, 5000):
        parts, y = passages(texts, 7, size)
        assert (parts == owner).all() and np.allclose(x[:, :15], y[:, :15]) and np.allclose(x[:, 16], y[:, 16])
        assert np.abs(x[:, 15] - y[:, 15]).max() < 1e-9


def test_gradients_equal_finite_differences():
    random = np.random.default_rng(2)
    p = {"W": random.normal(size=(5, 4)), "b": random.normal(size=4), "V": random.normal(size=(4, 3)),
         "U": random.normal(size=(4, 3)), "w": random.normal(size=3), "c": random.normal(size=4), "d": random.normal(size=1)}
    x, owner, y = random.normal(size=(9, 5)), np.array([0, 0, 0, 1, 2, 2, 2, 2, 3]), np.array([1.0, 0, 1, 0])
    begin = np.searchsorted(owner, np.arange(4))

    def loss():
        q = sigmoid(_forward(p, x, begin, owner)[-1])
        return -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))

    for name, g in _gradients(p, x, begin, owner, y).items():
        for at in np.ndindex(*p[name].shape):
            p[name][at] += 1e-5
            up = loss()
            p[name][at] -= 2e-5
            down = loss()
            p[name][at] += 1e-5
            assert np.isclose((up - down) / 2e-5, g[at], atol=1e-6)


def test_learns_from_bags_and_keeps_rows(frame):
    good = "some words in a row that read well and differ much from each other "
    docs = [(k, good * 4 + ("" if k % 3 else "!!$$ %%% | " * 40) + good * (k % 4), 1) for k in range(90)]
    odd = [(500, None, 1), (501, "", 1), (None, good, 1), (500, None, 1), (502, "| " * 200_000, 1)]
    rows = frame([*docs, *odd], "doc_id long, text string, quality_score int")
    labels = frame([(k, int(k % 3 > 0)) for k in range(90)] + [(1, None)], "doc_id long, quality int")
    model = quality.fit(rows, labels, F.lit(True), Quality(words=20, steps=80))
    got = quality.quality(rows, model)
    assert got.columns == rows.columns and got.count() == 95
    scores = {r.doc_id: r.quality_score for r in got.collect()}
    assert all((scores[k] >= 0.3) == (k % 3 > 0) for k in range(90)) and scores[502] < 0.3
    assert all(0 <= s <= 1 for s in scores.values())


def test_nothing_to_learn_from(frame):
    none = frame([], "doc_id long, text string")
    model = quality.fit(none, frame([], "doc_id long, quality int"), F.lit(True))
    assert quality.quality(none, model).count() == 0
