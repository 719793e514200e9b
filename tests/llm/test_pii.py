import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hedgerow.llm import pii
from hedgerow.llm.pii import KINDS, Pii, base_spans, listed

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text):
    """The patterns as they are written, straight through the text."""
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2:
                doubled = [int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(digits))]
                if not 12 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1.@-+ 4(é5)\n0", max_size=60))
def test_base_spans_are_the_patterns(text):
    assert base_spans(text) == plain(text)


def test_known_spans():
    text = "é und.34@mail7.example.com at 1.2.3.4, 300.1.1.1, 4111 1111 1111 1111 +1 (974) 555-3436."
    assert [(KINDS[k], text[s:e]) for s, k, e in base_spans(text)] == [
        ("email", "und.34@mail7.example.com"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (974) 555-3436")]
    assert base_spans("a@b.c@d.e") == plain("a@b.c@d.e")
    assert base_spans("1" * 50_000 + " " + "a" * 50_000) == []


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(k, f"w 4111 1111 1111 {1111 + 0 * k} then +1 (974) 555-{1000 + k} or 10.0.0.{k} by a.{k}x@b.de", 1) for k in range(50)]
    odd = [(100, None, 1), (101, "", 1), (102, "plain 1234567890123456 words", 1), (None, "a@b.de", 1), (100, None, 1),
           (103, "call +1 (974) 555-1234 or (974) 555-1234 or 555 9999 now", 1), (104, "mail john.s7@x.de as john.s7 says", 1)]
    return spark.createDataFrame(rows + odd, "doc_id long, text string, spans int")


def test_spans_of_all_rows(corpus):
    got = pii.find_pii(corpus, pii.fit(corpus)).collect()
    assert len(got) == 57
    texts = {r.doc_id: r.text or "" for r in corpus.collect()}
    for r in got:
        base = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        assert set(filter(None, listed(base).split(","))) <= set(r.spans.split(","))


def test_mentions_that_agree_are_added_and_lone_numbers_are_not(corpus):
    got = {r.doc_id: r.spans for r in pii.find_pii(corpus, pii.fit(corpus)).collect()}
    assert got[103] == "phone:5:22,phone:26:40"
    assert got[104] == "email:5:17,email:21:28"
    assert got[102] == got[101] == got[100] == ""


def test_redaction_keeps_everything_else(corpus):
    got = pii.redact(corpus, pii.fit(corpus))
    assert got.columns == corpus.columns
    by = {r.doc_id: r.text for r in got.collect()}
    assert by[100] is None and by[101] == "" and by[102] == "plain 1234567890123456 words"
    assert by[104] == "mail [EMAIL] as [EMAIL] says" and by[103] == "call [PHONE] or [PHONE] or 555 9999 now"


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_pii(none, pii.fit(none)).count() == 0


def test_many_numbers_in_one_text():
    text = "+1 (974) 555-1234; " + "974 555-1234, " * 3000
    model = pii.Model(pii.np.zeros((pii.SHAPES, 5)), pii.np.zeros((5, 5)), 4.0)
    base, found = pii.spans(text, model, Pii())
    assert len(base) == 1 and len(found) > 2900


def test_every_local_part_is_a_candidate(spark):
    rows = [(k, f"the list has info on item {k}", 1) for k in range(60)]
    rows += [(100, "mail maria.lopez@x.org as maria.lopez.", 1), (101, "info@x.org has info on it", 1),
             (102, "ask 86753@q.com or 86753 there", 1), (103, "kim@x.org and kim, not kimono", 1), (104, "jan19901234@x.org is jan19901234 here", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = {r.doc_id: r.spans for r in pii.find_pii(docs, pii.fit(docs)).collect() if r.doc_id >= 100}
    assert got == {100: "email:5:22,email:26:37", 101: "email:0:10", 102: "email:4:15,email:19:24", 103: "email:0:9,email:14:17",
                   104: "email:0:17,email:21:32"}


def test_lone_repeats_count_alike_with_and_without_other_spans():
    shapes = pii.np.full((pii.SHAPES, 5), -1.0)
    shapes[:, 3], shapes[:, 4] = 1.0, 0.0
    model, lone = pii.Model(shapes, pii.np.zeros((5, 5)), float(pii.np.log(400))), "(974) 555-1234 " + "x" * 90
    for n in (1, 6, 8, 50):
        for sure in (0.4, 0.9):
            how = Pii(sure=sure)
            alone, beside = pii.spans(lone * n, model, how)[1], pii.spans(lone * n + "a@b.de", model, how)[1]
            assert len(alone) == len(beside) - 1 == (n if sure < 0.5 else 0)


def test_fitted_on_every_whole_text(frame):
    rows = [(k, f"ask info at desk {k}") for k in range(3200)] + [(4000, "w " * 60_000 + "info"), (4001, "mail info@b.de"), (4002, None)]
    model = pii.fit(frame(rows, "doc_id long, text string"))
    assert model.words == {"info": 3201.0}  # ``ask``, ``at`` and ``desk`` are no address's local part
