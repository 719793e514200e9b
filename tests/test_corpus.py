"""Chunking against a plain list-based splitter, page attribution, ingest, search against brute force."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hedgerow.functions.splitting import chunk_spans, page_chunks
from hedgerow.operators import corpus, registry, search
from hedgerow.rules import documents as D


def slow_split(text, separators, size, overlap):
    """The same cutting, written with lists of pieces."""
    i = next(i for i, s in enumerate(separators) if s == "" or s in text)
    sep, rest = separators[i], separators[i + 1:]
    if sep:
        first, *others = text.split(sep)
        pieces = [p for p in [first] + [sep + o for o in others] if p]
    else:
        pieces = list(text)
    out, fitting = [], []
    for p in pieces + [None]:
        if p is not None and len(p) < size:
            fitting.append(p)
            continue
        window = []
        for q in fitting:
            if window and sum(map(len, window)) + len(q) > size:
                out.append("".join(window).strip())
                while window and (sum(map(len, window)) > overlap or sum(map(len, window)) + len(q) > size):
                    window.pop(0)
            window.append(q)
        out.append("".join(window).strip())
        fitting = []
        if p is not None:
            out += slow_split(p, rest, size, overlap) if rest else [p.strip()]
    return [c for c in out if c]


TEXTS = st.text(alphabet=st.sampled_from("ab. ,;!?\n"), max_size=400)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(4, 40), st.integers(0, 12))
def test_splitter_agrees_with_lists(text, size, overlap):
    got = [text[a:b] for a, b in chunk_spans(text, size, min(overlap, size))]
    assert got == slow_split(text, list(D.CHUNK_SEPARATORS), size, min(overlap, size))


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_splitter_properties(text):
    spans = chunk_spans(text, 30, 8)
    assert all(0 < b - a <= 30 and text[a:b] == text[a:b].strip() for a, b in spans)
    covered = set()
    for a, b in spans:
        covered |= set(range(a, b))
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())
    assert [a for a, _ in spans] == sorted(a for a, _ in spans)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, max_size=6), st.integers(5, 60))
def test_page_numbers(bodies, size):
    full, owner = "", []
    for n, body in enumerate(bodies, 1):
        if body.strip():
            added = ("\n\n" if full else "") + body
            full, owner = full + added, owner + [n] * len(added)
    at = 0
    got = list(page_chunks(list(enumerate(bodies, 1)), size, size // 4))
    assert [c for _, c, _ in got] == ([full[a:b] for a, b in chunk_spans(full, size, size // 4)] if full else [])
    for i, (index, chunk, numbers) in enumerate(got):
        found = full.find(chunk, at)
        found = at if found < 0 else found
        assert index == i and numbers == sorted(set(owner[found:found + len(chunk)]))
        at = max(at, found + 1)


def test_chunk_text_on_spark(spark):
    rows = [(1, "word " * 1000), (2, " \n "), (3, None), (4, "short")]
    got = {}
    for r in corpus.chunk_text(spark.createDataFrame(rows, "document_id int, text string")).collect():
        got.setdefault(r.document_id, []).append(r)
    assert set(got) == {1, 4} and got[4][0].text == "short" and got[4][0].word_count == 1
    assert all(r.char_count <= 800 for r in got[1]) and [r.chunk_index for r in got[1]] == list(range(len(got[1])))


def test_chunk_pages_on_spark(spark):
    rng = random.Random(2)
    docs = {d: [(p, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 400)))) for p in range(1, rng.randrange(2, 9))]
            for d in ("a", "b", "c")}
    rows = [(d, p, t) for d, pages in docs.items() for p, t in pages]
    rng.shuffle(rows)
    out = corpus.chunk_pages(spark.createDataFrame(rows, "document_id string, page_number int, text string")).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.document_id, r.chunk_index)):
        got.setdefault(r.document_id, []).append((r.chunk_index, r.text, r.page_numbers))
    assert got == {d: list(page_chunks(p, 800, 200)) for d, p in docs.items()}


def test_image_ratio_boundary(spark):
    rows = [("at", 1, 0.7), ("above", 1, 0.71), ("mean", 1, 0.9), ("mean", 2, 0.4)]
    df = spark.createDataFrame(rows, "document_id string, page_number int, image_ratio double")
    got = {r.document_id: r.is_image_based for r in corpus.image_based(df).collect()}
    assert got == {"at": False, "above": True, "mean": False}


def ingest(spark, registry_rows=()):
    files = spark.createDataFrame(
        [("25/1/F", "/d/Transport Assessment.pdf", "aaaaaa11", None), ("25/1/F", "/d/x.docx", "bbbbbb22", None), ("25/1/F", "/d/plan.pdf", "cccccc33", None),
         ("25/1/F", "/d/blank.pdf", "dddddd44", None), ("25/1/F", "/d/note.pdf", "eeeeee55", "given"), ("25/1/F", "/d/img.png", "ffffff66", None)],
        "application_ref string, file_path string, file_hash string, document_type string")
    pages = spark.createDataFrame(
        [("/d/Transport Assessment.pdf", 1, "word " * 300, "text_layer", 0.0, 100.0), ("/d/Transport Assessment.pdf", 2, "tail", "ocr", 0.0, 100.0),
         ("/d/plan.pdf", 1, "x", "text_layer", 400.0, 100.0), ("/d/blank.pdf", 1, "  ", "text_layer", 0.0, 100.0),
         ("/d/note.pdf", 1, "see habitat", "text_layer", 0.0, 100.0), ("/d/img.png", 1, "picture", "ocr", 900.0, 100.0)],
        "file_path string, page_number int, text string, extraction_method string, image_area double, page_area double")
    known = spark.createDataFrame(list(registry_rows), "document_id string, file_hash string")
    return corpus.ingest_documents(files, pages, known)


def test_ingest_statuses(spark):
    out = ingest(spark, [("25_1_F_eeeeee", "eeeeee55"), ("25_1_F_aaaaaa", "aaaaaa99")])
    got = {r.file_path: (r.status, r.detail, r.image_ratio) for r in out.status.collect()}
    assert got == {
        "/d/Transport Assessment.pdf": ("success", None, None), "/d/x.docx": ("error", "unsupported_file_type", None),
        "/d/plan.pdf": ("skipped", "image_based", 1.0), "/d/blank.pdf": ("error", "no_content", None),
        "/d/note.pdf": ("already_ingested", None, None), "/d/img.png": ("success", None, None)}
    chunks = out.chunks.orderBy("file_path" if "file_path" in out.chunks.columns else "chunk_id").collect()
    mine = [c for c in chunks if c.document_id == "25_1_F_aaaaaa"]
    assert {(c.document_type, c.extraction_method, c.total_chunks) for c in mine} == {("transport_assessment", "mixed", len(mine))}
    assert mine[0].chunk_id == "25_1_F_aaaaaa_001_000" and len(mine[0].embedding) == 384
    assert {r.document_id: r.chunk_count for r in out.registry.collect()}["25_1_F_aaaaaa"] == len(mine)
    summary = corpus.ingest_summary(out.status).head()
    assert (summary.ingested_count, summary.failed_count, summary.skipped_count, summary.is_complete) == (3, 2, 1, False)


def test_equal_and_colliding_files_in_one_call(spark):
    files = spark.createDataFrame(
        [("A", "/2.pdf", "aaaaaa1"), ("A", "/1.pdf", "aaaaaa1"), ("A", "/3.pdf", "aaaaaa2"), ("B", "/4.pdf", "aaaaaa1"), ("A", "/0.docx", "aaaaaa1"),
         ("A", "/5.pdf", "cccccc1"), ("A", "/6.pdf", "cccccc1")],
        "application_ref string, file_path string, file_hash string").withColumn("document_type", F.lit("t"))
    pages = spark.createDataFrame([(f"/{k}.pdf", 1, "" if k > 4 else f"words {k}", "text_layer", 0.0, 1.0) for k in range(1, 7)],
        "file_path string, page_number int, text string, extraction_method string, image_area double, page_area double")
    out = corpus.ingest_documents(files, pages, spark.createDataFrame([], "document_id string, file_hash string"))
    assert {r.file_path: r.status for r in out.status.collect()} == {
        "/0.docx": "error", "/1.pdf": "success", "/2.pdf": "already_ingested", "/3.pdf": "success", "/4.pdf": "success",
        "/5.pdf": "error", "/6.pdf": "error"}
    chunks = out.chunks.drop("embedding", "page_numbers").cache()
    assert chunks.filter("application_ref = 'A'").select("chunk_id").distinct().count() == 1  # ids collide, keys do not
    twice = registry.upsert(registry.upsert(chunks.limit(0), chunks, corpus.CHUNK_KEY), chunks, corpus.CHUNK_KEY)
    assert sorted(r.text for r in twice.collect()) == ["words 1", "words 3", "words 4"]
    assert out.registry.count() == 3


def test_encoder_with_a_limit_says_what_it_cut(spark):
    class Short(corpus.HashingEncoder):
        max_chars = 3

    df = spark.createDataFrame([("ab c",), ("ab",), (None,)], "text string")
    assert [r.truncated for r in corpus.embed_chunks(df, Short).collect()] == [True, False, False]
    assert "truncated" not in corpus.embed_chunks(df).columns


def test_given_type_wins(spark):
    assert {c.document_type for c in ingest(spark).chunks.filter("document_id = '25_1_F_eeeeee'").collect()} == {"given"}


def test_ingest_splits_once(spark):
    """The three results read written tables: no plan holds the splitter, and copies of a row do not double chunks."""
    out = ingest(spark)
    for part, encoders in ((out.status, 0), (out.registry, 0), (out.chunks, 1)):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "MapInPandas" not in plan and plan.count("ArrowEvalPython") <= encoders
    ids = [(c.application_ref, c.file_hash, c.page_number, c.chunk_index) for c in out.chunks.collect()]
    assert len(ids) == len(set(ids)) > 0


def test_policy_ingest(spark):
    revisions = spark.createDataFrame([("P", "r1", "v", "2024-01-02", None), ("P", "r2", "v", "2025-01-02", "2025-06-30")],
                                      "source string, revision_id string, version_label string, f string, t string").select(
        "source", "revision_id", "version_label", F.col("f").cast("date").alias("effective_from"), F.col("t").cast("date").alias("effective_to"))
    pages = spark.createDataFrame([("P", "r1", 1, "Chapter 5 rules"), ("P", "r2", 1, " ")], "source string, revision_id string, page_number int, text string")
    out = corpus.ingest_policy_revisions(revisions, pages)
    assert {(r.revision_id, r.status, r.chunk_count) for r in out.status.collect()} == {("r1", "active", 1), ("r2", "failed", 0)}
    c = out.chunks.head()
    assert (c.chunk_id, c.effective_from, c.effective_to, c.page_number) == ("P__r1__Chapter_5__000", 20240102, 99991231, 1)


def test_blank_text_has_no_embedding(spark):
    df = corpus.embed_chunks(spark.createDataFrame([("a b",), (" ",), (None,)], "text string"))
    assert [r.embedding is None for r in df.collect()] == [False, True, True]


@pytest.mark.parametrize("blocks", [(8192, 2048), (250, 3)])
def test_knn_in_one_and_in_many_blocks(spark, blocks):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(3000, 8)).astype(np.float32)
    groups = [int(g) for g in rng.integers(0, 3, 3000)]
    df = spark.createDataFrame([(i, [float(x) for x in v], g) for i, (v, g) in enumerate(zip(vectors, groups))],
                               "vec_id int, embedding array<float>, grp int").repartition(6)
    asked = df.filter("vec_id < 7").withColumnRenamed("vec_id", "query_id")
    wide = vectors.astype(np.float64)
    for match in (None, "grp"):
        got = {}
        for r in search.knn(asked, df, 5, match=match, exclude_self=True, block_vectors=blocks[0],
                            block_queries=blocks[1]).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        for q in range(7):
            d = ((wide - wide[q]) ** 2).sum(1)
            order = [i for i in np.lexsort((np.arange(3000), d)) if i != q and (match is None or groups[i] == groups[q])]
            assert got[q] == order[:5]


def test_search_filters_before_ranking(spark):
    chunks = spark.createDataFrame([("a", [1.0, 0.0], "X", "t"), ("b", [0.9, 0.1], "Y", "u")], "chunk_id string, embedding array<float>, application_ref string, document_type string")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    from hedgerow.operators import filters

    hits = search.search_documents(q, chunks, 5, filters.search_predicate("Y", ["t", "u"])).collect()
    assert [(h.chunk_id, h.document_type) for h in hits] == [("b", "u")]
    assert search.search_documents(q, chunks.filter("false"), 5).count() == 0


def test_each_query_has_its_own_filter(spark):
    chunks = spark.createDataFrame([("a", [1.0, 0.0], "X"), ("b", [0.9, 0.1], "Y"), ("c", [0.0, 1.0], "Y"), ("d", [1.0, 0.0], None), ("e", None, "X")],
                                   "chunk_id string, embedding array<float>, application_ref string")
    q = spark.createDataFrame([(1, [1.0, 0.0], "Y"), (2, [1.0, 0.0], "X"), (3, [1.0, 0.0], None), (4, None, "X"), (5, [1.0, 0.0], "Z")],
                              "query_id int, embedding array<float>, application_ref string")
    hits = search.search_documents(q, chunks, 5, match="application_ref").collect()
    assert sorted((h.query_id, h.rank, h.chunk_id) for h in hits) == [(1, 1, "b"), (1, 2, "c"), (2, 1, "a"), (3, 1, "d")]


def test_upsert_is_idempotent(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, v int")
    updates = spark.createDataFrame([("b", 3), ("c", 4)], "chunk_id string, v int")
    once = registry.upsert(target, updates)
    assert {tuple(r) for r in registry.upsert(once, updates).collect()} == {("a", 1), ("b", 3), ("c", 4)}


def handed(monkeypatch, df, method, make):
    """The function that ``make`` hands to a method of DataFrames."""
    kept, plain = [], getattr(type(df), method)
    monkeypatch.setattr(type(df), method, lambda self, f, schema: kept.append(f) or plain(self, f, schema))
    make(df)
    return kept[0]


def test_chunks_of_many_short_documents_are_sent_together(spark, monkeypatch):
    rows = [(f"d{k}", n, f"page {n} of {k}") for k in range(300) for n in (1, 2)]
    df = spark.createDataFrame(rows, "document_id string, page_number int, text string")
    cut = handed(monkeypatch, df, "mapInPandas", corpus.chunk_pages)
    whole = pd.DataFrame(rows, columns=["document_id", "page_number", "text"])
    frames = list(cut(iter([whole[:101], whole[101:]])))
    assert len(frames) <= 3
    got = [tuple(r) for r in pd.concat(frames).itertuples(index=False)]
    assert got == [(f"d{k}", 0, f"page 1 of {k}\n\npage 2 of {k}", [1, 2], 1) for k in range(300)]


def test_chunks_of_large_batches_are_sent_in_slices(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a")], "document_id int, text string")
    cut = handed(monkeypatch, df, "mapInArrow", corpus.chunk_text)
    texts = [f"{k} " + "some words " * 9000 for k in range(60)]
    sent = list(cut(iter([pa.RecordBatch.from_arrays([pa.array([*range(59), None]), pa.array(texts)], ["document_id", "text"])])))
    assert len(sent) > 4 and max(b.nbytes for b in sent) < 2 * (corpus._SLICE + 100_000)
    got = [(k, i, t) for b in sent for k, i, t in zip(*(c.to_pylist() for c in b.columns))]
    assert got == [(k if k < 59 else None, i, t[a:b]) for k, t in enumerate(texts)
                   for i, (a, b) in enumerate(chunk_spans(t, corpus.CHARS, corpus.OVERLAP))]
