"""Filter rules, classification, texts, links and pages on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from hedgerow.functions import dates
from hedgerow.functions import text as T
from hedgerow.operators import classify, filters, pages
from hedgerow.rules import documents as D


def decide(spark, rows, **toggles):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "document_id int, document_type string, description string")
    out = filters.filter_documents(df, **toggles).orderBy("document_id").collect()
    return [(r.allowed, r.filter_reason) for r in out]


def test_filter_rules_in_order(spark):
    cases = [
        ((None, None), True, D.REASON_EMPTY),
        (("", ""), True, D.REASON_EMPTY),
        (("Superseded Documents", "Site plan"), False, D.REASON_SUPERSEDED),
        ((None, "SUPERSEDED block plan"), False, D.REASON_SUPERSEDED),
        (("Site Plans", "public comment"), True, "Portal category: Site Plans"),
        (("Consultation Responses", "Transport Assessment"), False, D.REASON_CATEGORY_CONSULTATION),
        (("Public Comments", "x"), False, D.REASON_CATEGORY_PUBLIC),
        (("Misc", "OCC Highways consultation response"), False, D.REASON_CONSULTATION),
        ((None, "Letter of objection about parking"), False, D.REASON_PUBLIC),
        ((None, "Planning Statement"), True, D.REASON_CORE),
        ((None, "Section 106 agreement"), True, D.REASON_CORE),
        ((None, "Travel Plan"), True, D.REASON_ASSESSMENT),
        ((None, "Officer's report"), True, D.REASON_OFFICER),
        ((None, "Noise and acoustic report"), False, D.REASON_NON_TRANSPORT),
        (("Other", "scan 1"), True, D.REASON_UNKNOWN),
    ]
    assert decide(spark, [c[0] for c in cases]) == [(c[1], c[2]) for c in cases]


def test_filter_toggles(spark):
    rows = [("Consultation Responses", "reply"), (None, "consultee response on highway"), ("Public Comments", "x"), (None, "petition")]
    both = decide(spark, rows, include_consultation=True, include_public=True)
    assert both == [(True, D.REASON_UNKNOWN), (True, D.REASON_ASSESSMENT), (True, D.REASON_UNKNOWN), (True, D.REASON_UNKNOWN)]
    assert all(a for a, _ in decide(spark, rows + [(None, "superseded")], skip_filter=True))


def test_post_filter_reads_titles_only(spark):
    df = spark.createDataFrame([(1, " Consultation Responses ", "x"), (2, "consultation response", "plan"), (3, None, "Petition"), (4, None, None)],
                               "document_id int, document_type string, description string")
    got = {r.document_id: r.removed_by for r in filters.post_filter_selected(df).collect()}
    assert got == {1: "category_denylist_consultation", 2: None, 3: "title_pattern_public", 4: None}


@pytest.mark.parametrize("name, kind", [
    ("Transport_Assessment.pdf", "transport_assessment"), ("D&A Statement.pdf", "design_access_statement"),
    ("infrastructure.pdf", "flood_risk_assessment"), ("tree-survey.pdf", "arboricultural_report"), ("x.pdf", "other"),
])
def test_classify_by_name(spark, name, kind):
    df = spark.createDataFrame([(name,)], "file_name string")
    assert classify.classify_documents(df).head().document_type == kind


def test_classify_by_content_tie_goes_to_earlier_type(spark):
    df = spark.createDataFrame([("x", "trip generation; traffic flow; flood zone, SUDS"), ("x", "only habitat"), ("x", None)],
                               "file_name string, body string")
    got = classify.classify_documents(df, text="body").collect()
    assert [(r.document_type, r.method, r.matched_pattern) for r in got] == [
        ("transport_assessment", "content", "2 keyword matches"), ("other", "fallback", None), ("other", "fallback", None)]


def test_dates_and_ids(spark):
    row = spark.range(1).select(
        dates.parse_date(F.lit("3/2/2025")).cast("string"), dates.parse_date(F.lit("14 February 2024")).cast("string"),
        dates.parse_date(F.lit("nope")), dates.date_to_int(F.lit(None).cast("date")), dates.int_to_date(F.lit(20240229)).cast("string"),
        dates.int_to_date(F.lit(99991231)),
        T.chunk_id(F.lit("25/01178/REM"), F.lit("a1b2c3d4"), F.lit(14), F.lit(1042)),
        T.policy_chunk_id(F.lit("S"), F.lit("r"), F.lit("Chapter 5/a"), F.lit(4)),
        T.section_ref(F.lit("see table 5-2, Section 3.2")), T.stem(F.lit("/a/b.c.pdf")), T.extension(F.lit(".hidden"))).head()
    assert list(row) == ["2025-02-03", "2024-02-14", None, 99991231, "2024-02-29", None,
                         "25_01178_REM_a1b2c3_014_1042", "S__r__Chapter_5_a__004", "Section 3.2", "b.c", ""]


HTML = {
    1: """<p><a class="x" href="/Document/Download?a=1&amp;FILEID=2"> <b>Block</b>\n plan</a><A HREF='r.PDF'></A><a name="t">no</a></p>""",
    2: """<a href=about>About</a><a href="?p=2" title='>'>Next &gt;</a><a href="?p=3">next</a>""", 3: "", 4: None, 5: "<a href='x'>never closed",
}


@pytest.fixture(scope="module")
def links(spark):
    rows = [(i, f"https://p.example/list/{i}", h) for i, h in HTML.items()]
    return pages.page_links(spark.createDataFrame(rows, "page_id int, url string, html string")).cache()


def test_links_of_pages(links):
    got = [(r.page_id, r.link_no, r.href, r.label) for r in links.orderBy("page_id", "link_no").collect()]
    assert [g[:3] for g in got] == [(1, 0, "/Document/Download?a=1&amp;FILEID=2"), (1, 1, "r.PDF"), (2, 0, "about"), (2, 1, "?p=2"), (2, 2, "?p=3")]
    assert got[0][3] == "Block plan" and got[1][3] == ""
    assert [(r.description, r.document_url) for r in pages.document_links(links).orderBy("link_no").collect()] == [
        ("Block plan", "https://p.example/Document/Download?a=1&amp;FILEID=2"), ("Unknown Document", "https://p.example/list/r.PDF")]


def test_next_pages_and_chains(spark, links):
    assert {r.page_id: r.next_url for r in pages.next_page_edges(links).collect()} == {2: "https://p.example/list/?p=3"}
    edges = [(f"u{i:02d}", f"u{i + 1:02d}") for i in range(69)] + [("v0", "v1"), ("c1", "c2"), ("c2", "c0"), ("c0", "c1"), ("s", "s"), ("t", "c2")]
    chain = spark.createDataFrame(edges, "url string, next_url string")
    urls = spark.createDataFrame([(u,) for e in edges for u in e] + [("w",)], "url string")
    got = {}
    for r in pages.page_chains(urls, chain).orderBy("first_url", "step").collect():
        got.setdefault(r.first_url, []).append(r.url)
    assert got.pop("u00") == [f"u{i:02d}" for i in range(70)]
    assert got == {"v0": ["v0", "v1"], "w": ["w"], "c0": ["c0", "c1", "c2"], "s": ["s"], "t": ["t", "c2"]}
    short = pages.page_chains(urls, chain, max_pages=50).filter("first_url = 'u00'").collect()
    assert sorted(r.step for r in short) == list(range(1, 51))


def test_chains_of_any_shape_in_few_rounds(spark, monkeypatch):
    """Random links with tails and cycles against a plain walk; rounds follow the longest chain, not the number of pages."""
    draw = random.Random(5)
    step = {k: 7 * (k // 7) + (k + 1) % 7 for k in range(700) if k % 7 != 3 or k % 2}  # chains and cycles of 7 at most
    step |= {k: draw.randrange(1000, 1060) for k in range(1000, 1060) if k % 9}
    rounds, double = [], pages._doubled
    monkeypatch.setattr(pages, "_doubled", lambda *a, **k: rounds.append(1) or double(*a, **k))
    edges = spark.createDataFrame(list(step.items()), "url long, next_url long")
    urls = spark.createDataFrame([(k,) for k in sorted({*step, *step.values()})], "url long")
    got = {(r.first_url, r.url, r.step) for r in pages.page_chains(urls, edges).collect()}
    on_cycle = {}
    for k in step:
        seen, at = [], k
        while at is not None and at not in seen:
            seen.append(at)
            at = step.get(at)
        if at == k:
            on_cycle[k] = min(seen)
    cut = {k: v for k, v in step.items() if on_cycle.get(k) != v}
    want = set()
    for head in {*step, *step.values()} - set(cut.values()):
        at, n = head, 1
        while at is not None:
            want.add((head, at, n))
            at, n = cut.get(at), n + 1
    assert got == want and len(rounds) <= 20  # 10 + 10 to tell cycles and 4 or more to walk, when rounds went by the number of links


def test_repeated_names_get_numbers(spark):
    df = spark.createDataFrame([("d", "a.pdf", i) for i in range(3)] + [("d", "b", 3), ("d", "b", 4)], "folder string, file_name string, seq int")
    assert [r.stored_name for r in pages.dedupe_names(df).orderBy("seq").collect()] == ["a.pdf", "a_1.pdf", "a_2.pdf", "b", "b_1"]


def test_numbered_pagers_and_document_lists(spark):
    rows = [
        (1, "<p><a href=0>0</a><span class='page Current'><b>1</b></span> <i>,</i><br> <a name=n>x</a> <a href='?p=2'>2</a><a href='?p=3'>3</a></p>"),
        (2, "<a class=active href='?p=1'>1</a><a href='?p=2'>2</a>"),
        (3, "<ul><li class='active'><a href='?p=1'>1</a></li><li><a href='?p=2'>2</a></li></ul>"),  # no link beside it
        (4, "<b class='current'>1</b><a href='?p=2'>2</a><a href='?p=9'>Next</a>"),
        (5, "<div><b class='current'>1</b></div><a href='/about'>About</a>"),
        (6, "<a href=1><b class=current>1</b></a><a href='?p=2'>2</a>"),
        (7, "<ul class='x Documents'><li><a name=a>a</a><a href='/get?n=1'>One</a> <a href='/more'>More</a></li><li>none</li>"
            "<li><ul><li><a href='/get?n=2'></a></li></ul></li><a href='/loose'>l</a></ul><ul><li><a href='/no'>no</a></li></ul><a href='x.pdf'>X</a>"),
    ]
    links = pages.page_links(spark.createDataFrame([(i, "https://p.example/list/", h) for i, h in rows], "page_id int, url string, html string"))
    assert {r.page_id: r.next_url.rpartition("/")[2] for r in pages.next_page_edges(links).collect()} == {1: "?p=2", 2: "?p=2", 4: "?p=9"}
    assert [(r.page_id, r.document_url.removeprefix("https://p.example"), r.description) for r in pages.document_links(links).orderBy("page_id", "link_no").collect()] == [
        (7, "/get?n=1", "One"), (7, "/get?n=2", "Unknown Document"), (7, "/list/x.pdf", "X")]
