"""Review structures, evidence, jobs, progress and admission."""

import datetime as dt
import json
import random
from collections import deque

import pytest

from hedgerow.operators import jobs, reviews
from hedgerow.streaming.lifecycle import JobBook, lifecycle_batch

GOOD = {
    "overall_rating": " RED ", "summary": "s", "aspects": [{"name": "n", "rating": "Green", "key_issue": "k", "analysis": "a"}],
    "policy_compliance": [{"requirement": "q", "policy_source": "p", "compliant": "Yes"}, {"requirement": "q", "policy_source": "p", "compliant": None},
                          {"requirement": "q", "policy_source": "p", "compliant": True}],
    "recommendations": ["r"], "suggested_conditions": [], "key_documents": [{"document_id": "d", "category": "Route plan", "summary": "s"}],
}


def bad(**changes):
    return json.dumps({**GOOD, **changes})


@pytest.mark.parametrize("body, valid", [
    (json.dumps(GOOD), True), ("```json\n" + json.dumps(GOOD) + "\n```", True), (bad(overall_rating="purple"), False), (bad(aspects=[]), False),
    (json.dumps({k: v for k, v in GOOD.items() if k != "summary"}), False), (bad(policy_compliance=[{"requirement": "q", "policy_source": "p", "compliant": "maybe"}]), False),
    ("not json", False), (json.dumps(GOOD) + " trailing", False), ("", False),
])
def test_structure(spark, body, valid):
    row = reviews.parse_reviews(spark.createDataFrame([(body,)], "body string")).head()
    assert row.valid is valid
    if valid:
        assert row.overall_rating == "red" and row.aspects[0].rating == "green"
        assert [c.compliant for c in row.policy_compliance] == [True, False, True]
        assert row.key_documents[0].category == "Transport & Access"
    else:
        assert row.overall_rating is None and row.aspects is None


def test_fallback_rating(spark):
    df = spark.createDataFrame([(bad(aspects=[]), "**Overall Rating:** 🟢 ok"), ("x", None)], "body string, markdown string")
    assert [r.rating for r in reviews.rate_reviews(reviews.parse_reviews(df)).collect()] == ["green", "amber"]


def test_manifest_and_key_documents(spark):
    old = spark.createDataFrame([("A", "1"), ("A", "2")], "application_ref string, document_id string")
    new = spark.createDataFrame([("A", "2"), ("A", "3")], "application_ref string, document_id string")
    diff = reviews.diff_manifest(old, new)
    assert {(r.document_id, r.change) for r in diff.collect()} == {("1", "removed"), ("2", "reused"), ("3", "new")}
    meta = spark.createDataFrame([("d", "Title", "u")], "document_id string, description string, url string")
    items = spark.createDataFrame([("d",), ("zz",)], "document_id string")
    assert {(r.document_id, r.title, r.url) for r in reviews.backfill_key_documents(items, meta).collect()} == {
        ("d", "Title", "u"), ("zz", "(unknown document)", None)}


def test_evidence_caps_and_defaults(spark):
    rows = [("r1", "application", i, f"f{i}", "t") for i in range(30)] + [("r2", "policy", i, "P", "t") for i in range(16)]
    hits = spark.createDataFrame(rows, "review_id string, kind string, ord int, origin string, text string")
    every = {r.review_id: r for r in reviews.assemble_evidence(hits).collect()}
    assert every["r1"].application_evidence.count("---") == 29 and every["r1"].left_out == every["r2"].left_out == 0
    got = {r.review_id: r for r in reviews.assemble_evidence(hits, 20, 15).collect()}
    assert (got["r1"].left_out, got["r2"].left_out) == (10, 1)
    assert got["r1"].application_evidence.count("---") == 19 and got["r1"].application_evidence.startswith("[f0] t")
    assert got["r1"].policy_evidence == "No policy content retrieved." and got["r2"].policy_evidence.count("---") == 14


def test_verification(spark):
    claims = spark.createDataFrame([("a", True), ("b", True), ("b", False), ("c", False)], "review_id string, verified boolean")
    every = spark.createDataFrame([(x,) for x in "abcd"], "review_id string")
    assert {(r.review_id, r.status) for r in reviews.verification_rollup(claims, every).collect()} == {
        ("a", "verified"), ("b", "partial"), ("c", "failed"), ("d", "verified")}


def ts(seconds):
    return dt.datetime(2025, 1, 1) + dt.timedelta(seconds=seconds)


def test_progress(spark):
    log = [("start", "fetching_metadata", None, None), ("complete", "fetching_metadata", None, None), ("start", "ingesting_documents", None, None),
           ("progress", "ingesting_documents", 5, 22), ("error", "ingesting_documents", None, None), ("complete", "fetching_metadata", None, None)]
    rows = [("r", p, e, c, t, ts(i), i) for i, (e, p, c, t) in enumerate(log)]
    df = spark.createDataFrame(rows, "review_id string, phase string, event string, sub_current int, sub_total int, ts timestamp, event_id int")
    assert [r.percent_complete for r in jobs.progress_percent(df).orderBy("event_id").collect()] == [0, 5, 5, 10, 5, 5]
    row = jobs.review_progress(df).head()
    assert (row.phase, row.percent_complete, row.error_count) == ("ingesting_documents", 10, 1)
    full = [("r", p, "complete", None, None, ts(i), i) for i, p in enumerate(
        ("fetching_metadata", "filtering_documents", "downloading_documents", "ingesting_documents", "analysing_application",
         "assessing_routes", "generating_review", "verifying_review"))]
    assert jobs.review_progress(spark.createDataFrame(full, df.schema)).head().percent_complete == 99


def test_job_listing_filters_combine(spark):
    rows = [(f"r{i}", f"A{i % 2}", "queued" if i % 3 else "completed", ts(i), ts(i + 5)) for i in range(30)]
    df = spark.createDataFrame(rows, "review_id string, application_ref string, status string, created_at timestamp, completed_at timestamp")
    got = [r.review_id for r in jobs.list_jobs(df, "queued", "A1", limit=3, offset=1).collect()]
    assert got == ["r25", "r23", "r19"] and jobs.count_jobs(df, "queued", "A1").head().total == 10
    assert {r.application_ref: r.review_id for r in jobs.latest_completed(df).collect()} == {"A0": "r24", "A1": "r27"}
    assert {r.application_ref: r.active_review_id for r in jobs.active_jobs(df).collect()} == {"A0": "r28", "A1": "r29"}


def admitted(times, limit, window):
    log, out = deque(), []
    for t in times:
        while log and log[0] <= t - window:
            log.popleft()
        if len(log) >= limit:
            out.append((False, 0, int(log[0] + window - t) + 1))
        else:
            log.append(t)
            out.append((True, limit - len(log), None))
    return out


def test_admission_matches_the_log(spark):
    rng = random.Random(8)
    keys = {"hot": sorted(rng.randrange(0, 4000) for _ in range(800)), "b": [0, 10, 20, 59, 60, 61, 200], "c": [5]}
    rows = [(k, i, ts(t)) for k, times in keys.items() for i, t in enumerate(times)]
    rng.shuffle(rows)
    got = {}
    out = jobs.admit_requests(spark.createDataFrame(rows, "key string, request_id int, ts timestamp"), limit=4, window_s=60)
    for r in sorted(out.collect(), key=lambda r: (r.key, r.request_id)):
        got.setdefault(r.key, []).append((r.admitted, r.remaining, r.retry_after))
    assert got == {k: admitted(times, 4, 60) for k, times in keys.items()}
    assert any(not a for a, _, _ in got["hot"])


def test_job_book():
    book = JobBook()
    assert book.apply("a", "queued", 1, False)[-1][-1] == "accepted"
    assert book.apply("b", "queued", 2, False) == [("b", "rejected", 2, None, None, "duplicate")]
    assert [(r[0], r[1], r[-1]) for r in book.apply("c", "queued", 3, True)] == [("a", "cancelled", "force_cancelled"), ("c", "queued", "accepted")]
    book.apply("c", "processing", 4, False)
    assert book.apply("c", "completed", 5, False)[0][1:] == ("completed", 3, 4, 5, "updated")
    assert book.active is None and book.apply("zz", "completed", 6, False)[0][-1] == "unknown"


def test_lifecycle_batch(spark):
    rows = [("A", "r1", "queued", False, 1), ("A", "r2", "queued", False, 2), ("A", "r1", "completed", False, 3), ("A", "r3", "queued", False, 4),
            ("B", "r4", "queued", False, 1)]
    df = spark.createDataFrame([(a, r, e, f, ts(i), i) for a, r, e, f, i in rows],
                               "application_ref string, review_id string, event string, force boolean, ts timestamp, event_id int")
    got = sorted((r.application_ref, r.review_id, r.status, r.outcome) for r in lifecycle_batch(df).collect())
    assert got == [("A", "r1", "completed", "updated"), ("A", "r1", "queued", "accepted"), ("A", "r2", "rejected", "duplicate"),
                   ("A", "r3", "queued", "accepted"), ("B", "r4", "queued", "accepted")]
