import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hedgerow.llm import langid
from hedgerow.llm.chain import marginals
from hedgerow.llm.langid import LangId


def brute(emission, moves):
    n, labels = emission.shape
    single, pair, total = np.zeros((n, labels)), np.zeros((labels, labels)), 0.0
    for path in itertools.product(range(labels), repeat=n):
        p = np.exp(sum(emission[t, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total += p
        for t, k in enumerate(path):
            single[t, k] += p
        for a, b in zip(path, path[1:]):
            pair[a, b] += p
    return single / total, pair / total


def test_forward_backward_equals_all_paths():
    random = np.random.default_rng(5)
    moves, sizes = random.normal(size=(3, 3)), (1, 7, 2, 6)
    emissions = [random.normal(size=(n, 3)) * 3 for n in sizes]
    fresh = np.concatenate([np.arange(n) == 0 for n in sizes])
    got, pairs = marginals(np.concatenate(emissions), fresh, moves, pairs=True)
    want = [brute(e, moves) for e in emissions]
    assert np.allclose(got, np.concatenate([w[0] for w in want]))
    assert np.allclose(pairs, sum(w[1] for w in want))


def test_words_are_runs_of_letters():
    texts = pa.array(["Héllo wörld, a1b!", "", None, "12 ..", "ß"])
    (row, sizes, features, begin), = langid.words(texts, 17)
    assert row.tolist() == [0, 0, 0, 0, 4] and sizes.tolist() == [5, 5, 1, 1, 1]
    one, two = (list(langid.words(pa.array([t]), 17))[0][2].tolist() for t in ("abc", "ABC"))
    assert one == two


ENGLISH = "the thing that they think of this other weather with them there "
GERMAN = "der zug durch wald und schnee ging nicht zurück zum haus "


def test_learns_and_labels_switched_text(frame):
    docs = [(k, (ENGLISH if k % 2 else GERMAN) * 3, "en" if k % 2 else "de", 1) for k in range(40)]
    odd = [(100, None, "en", 1), (101, "", "en", 1), (102, "12 !", "de", 1), (103, GERMAN * 5000, None, 1), (None, ENGLISH, "en", 1)]
    rows = frame([*docs, *odd, (100, None, "en", 1)], "doc_id long, text string, lang string, score int")
    model = langid.fit(rows, F.lit(True), LangId(steps=15))
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.languages(rows, model).collect()]
    assert len(got) == 46
    by = {i: (p, s) for i, p, s in got}
    assert all(by[k][0] == ("en" if k % 2 else "de") for k in range(40))
    assert by[100] == by[101] == by[102] == ("und", 0.0) and by[103][0] == "de" and by[None][0] == "en"
    mixed = frame([(1, ENGLISH + GERMAN)], "doc_id long, text string")
    labels = [r.lang for r in langid.word_languages(mixed, model).orderBy("position").collect()]
    assert labels[:10] == ["en"] * 10 and labels[-9:] == ["de"] * 9


def test_nothing_to_learn_from(frame):
    none = frame([], "doc_id long, text string, lang string")
    model = langid.fit(none, F.lit(True))
    assert langid.languages(none, model).count() == 0
    assert langid.languages(frame([(1, "x")], "doc_id long, text string"), model).first().lang_pred == "und"
