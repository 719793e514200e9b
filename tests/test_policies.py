"""Revisions in force: reference cases by hand, and brute force over random overlapping intervals."""

import datetime as dt
import random

from pyspark.sql import functions as F

from hedgerow.operators import policies, registry, search

KIND = "source string, revision_id string, effective_from date, effective_to date, status string"


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def random_revisions(rng, sources=4, each=60):
    rows = []
    for s in range(sources):
        for i in range(each if s == 0 else rng.randrange(0, 6)):
            a = rng.randrange(0, 900)
            rows.append((f"S{s}", f"r{i:03d}", day(a), None if rng.random() < 0.2 else day(a + rng.randrange(0, 300)),
                         rng.choice(["active", "superseded", "failed", "processing"])))
    return rows


def test_asof_on_overlapping_revisions(spark):
    rng = random.Random(11)
    rows = random_revisions(rng)
    probes = [(f"S{rng.randrange(0, 5)}", day(rng.randrange(-50, 1300)), i) for i in range(500)]
    got = policies.effective_revision(
        spark.createDataFrame(probes, "source string, on_date date, n int"), spark.createDataFrame(rows, KIND)).collect()
    assert len(got) == len(probes)
    for r in got:
        mine = [x for x in rows if x[0] == r.source]
        live = [x for x in mine if x[4] in ("active", "superseded") and x[2] <= r.on_date and (x[3] is None or x[3] >= r.on_date)]
        if live:
            assert r.revision_id == max(live, key=lambda x: (x[2], x[1]))[1] and r.reason is None
        else:
            want = "no_revisions" if not mine else "date_in_gap" if r.on_date >= min(x[2] for x in mine) else "date_before_first_revision"
            assert (r.revision_id, r.reason) == (None, want)


def test_boundaries_and_gap(spark):
    rows = [("P", "a", dt.date(2023, 9, 5), dt.date(2024, 12, 11), "superseded"), ("P", "b", dt.date(2024, 12, 20), None, "active"),
            ("Q", "c", dt.date(2020, 1, 1), None, "processing")]
    probes = [("P", dt.date(2023, 9, 4)), ("P", dt.date(2023, 9, 5)), ("P", dt.date(2024, 12, 11)), ("P", dt.date(2024, 12, 12)),
              ("P", dt.date(2024, 12, 20)), ("P", dt.date(2999, 1, 1)), ("Q", dt.date(2021, 1, 1)), ("Z", dt.date(2021, 1, 1))]
    df = policies.resolve(spark.createDataFrame(probes, "source string, on_date date"), spark.createDataFrame(rows, KIND))
    got = {(r.source, r.on_date): r.revision_id or r.reason for r in df.collect()}
    assert [got[p] for p in probes] == ["date_before_first_revision", "a", "a", "date_in_gap", "b", "b", "date_in_gap", "no_revisions"]


def test_snapshot_buckets(spark):
    p = spark.createDataFrame([("P", "t", "c"), ("Z", "t", "c")], "source string, title string, category string")
    rows = [("P", "a", dt.date(2023, 1, 1), dt.date(2023, 12, 31), "active")]
    days = spark.createDataFrame([(dt.date(2022, 1, 1),), (dt.date(2023, 6, 1),), (dt.date(2024, 6, 1),)], "on_date date")
    snap = policies.policy_snapshot(p, days, spark.createDataFrame(rows, KIND))
    counts = {r.on_date.year: (r.policies_with_revision, r.policies_not_yet_effective, r.policies_in_gap, r.policies)
              for r in policies.snapshot_counts(snap).collect()}
    assert counts == {2022: (0, 1, 0, 2), 2023: (1, 0, 0, 2), 2024: (0, 0, 1, 2)}


def test_new_revisions_against_the_visit_order(spark):
    rng = random.Random(13)
    rows = random_revisions(rng)
    new = []
    for i in range(200):
        a = rng.randrange(-50, 1000)
        new.append((f"S{rng.randrange(0, 5)}", f"n{i}", day(a), None if rng.random() < 0.5 else day(a + rng.randrange(0, 100))))
    df = policies.check_new_revisions(
        spark.createDataFrame(new, "source string, revision_id string, effective_from date, effective_to date"),
        spark.createDataFrame(rows, KIND))
    got = {r.revision_id: r for r in df.collect()}
    for source, rid, a, b in new:
        conflict, ended = None, []
        for x in sorted((x for x in rows if x[0] == source and x[4] != "failed"), key=lambda x: (x[2], x[1])):
            if x[3] is None:
                if b is not None and b < x[2]:
                    continue
                if a <= x[2]:
                    conflict = x[1]
                    break
                ended.append(x[1])
            elif a <= x[3] and (b or dt.date.max) >= x[2]:
                conflict = x[1]
                break
        r = got[rid]
        assert r.conflict_with == conflict
        assert r.supersedes == (ended[-1] if ended and conflict is None else None)
        assert r.supersedes_until == (a - dt.timedelta(days=1) if r.supersedes else None)


def test_overlaps_and_supersession(spark):
    rows = random_revisions(random.Random(17))
    df = spark.createDataFrame(rows, KIND)
    live = [x for x in rows if x[4] != "failed"]
    want = {(n[0], n[1]) for n in live for e in live if e[0] == n[0] and (e[2], e[1]) < (n[2], n[1]) and (e[3] or dt.date.max) >= n[2]}
    assert {(r.source, r.revision_id) for r in policies.revision_overlaps(df).collect()} == want
    ends = {(r.source, r.revision_id): r.effective_to for r in policies.auto_supersede(df).collect()}
    for x in rows:
        later = [y[2] for y in live if y[0] == x[0] and y[2] > x[2]]
        want_end = min(later) - dt.timedelta(days=1) if x[3] is None and x[4] != "failed" and later else x[3]
        assert ends[x[0], x[1]] == want_end


def test_sole_active_revision_stays(spark):
    rows = [("P", "a", day(0), None, "active"), ("P", "b", day(9), None, "failed"), ("Q", "c", day(0), None, "active"), ("Q", "d", day(5), None, "active")]
    revisions = spark.createDataFrame(rows, KIND)
    doomed = spark.createDataFrame([("P", "a"), ("P", "b"), ("Q", "c"), ("Q", "zz")], "source string, revision_id string")
    changed = registry.delete_revisions(revisions, revisions, doomed)
    assert {r.revision_id for r in changed.table[0].collect()} == {"a", "d"}
    assert {(r.revision_id, r.reason) for r in changed.rejected.collect()} == {("a", "sole_active_revision"), ("zz", "not_found")}


def test_partial_updates(spark):
    table = spark.createDataFrame([("A", "one", "x"), ("B", "two", "y"), ("C", "three", "z")], "source string, title string, category string")
    changes = spark.createDataFrame([("A", "update", None, "q"), ("B", "delete", None, None), ("C", "create", "no", None),
                                     ("D", "create", "new", None), ("E", "update", "lost", None)],
                                    "source string, op string, title string, category string")
    out = registry.apply_changes(table, changes)
    assert {tuple(r) for r in out.table.collect()} == {("A", "one", "q"), ("C", "three", "z"), ("D", "new", None)}
    assert {(r.source, r.reason) for r in out.rejected.collect()} == {("C", "already_exists"), ("E", "not_found")}


def test_validation(spark):
    rows = [("LTN_1_20", day(5), day(4)), ("ltn", day(1), None), ("NPPF", day(1), day(1))]
    df = spark.createDataFrame(rows, "source string, effective_from date, effective_to date")
    assert [r.violations for r in policies.validate_revisions(df).collect()] == [["bad_range"], ["bad_source"], []]
    refs = spark.createDataFrame([("25/01178/REM",), ("25/0117/ABCDE",), ("5/01178/F",)], "application_ref string")
    assert [r.valid_ref for r in policies.validate_references(refs).collect()] == [True, False, False]


def test_overview_takes_the_earliest_active_revision(spark):
    p = spark.createDataFrame([("P",), ("Q",)], "source string")
    rows = [("P", "a", day(0), None, "superseded"), ("P", "b", day(3), None, "active"), ("P", "c", day(5), day(90), "active")]
    got = {r.source: (r.revision_count, r.current_revision) for r in policies.policy_overview(
        p, spark.createDataFrame(rows, KIND), F.lit(day(60))).collect()}
    assert got == {"P": (3, "b"), "Q": (0, None)}


def test_a_new_revision_ends_every_open_one(spark):
    days = "source string, revision_id string, effective_from string, effective_to string, status string"
    dated = lambda df: df.withColumns({c: df[c].cast("date") for c in ("effective_from", "effective_to")})
    held = dated(spark.createDataFrame([
        ("P", "a", "2020-01-01", None, "active"), ("P", "b", "2021-01-01", None, "active"), ("P", "c", "2022-01-01", None, "failed"),
        ("P", "d", "2019-01-01", "2019-06-01", "active"), ("Q", "e", "2020-01-01", None, "active"), ("Q", "f", "2024-06-01", "2024-07-01", "active")], days))
    new = dated(spark.createDataFrame([("P", "n", "2024-01-01", None, ""), ("Q", "m", "2024-01-01", None, ""), ("R", "k", "2024-01-01", None, "")], days))
    got = policies.superseded_revisions(new.drop("status"), held).collect()
    assert {(r.source, r.revision_id, r.ended, str(r.ended_on)) for r in got} == {("P", "n", "a", "2023-12-31"), ("P", "n", "b", "2023-12-31")}


def in_force(rows, source, date):
    live = [x for x in rows if x[0] == source and x[4] in ("active", "superseded") and x[2] <= date and (x[3] is None or x[3] >= date)]
    return max(live, key=lambda x: (x[2], x[1]))[1] if live else None


def test_reigns_hold_every_day_once(spark):
    rows = random_revisions(random.Random(17))
    held = {}
    for r in policies.reigns(spark.createDataFrame(rows, KIND)).collect():
        for n in range(r.lo, (r.hi if r.hi is not None else 20_000) + 1):
            assert held.setdefault((r.source, n), r.revision_id) == r.revision_id
    first = (day(0) - dt.date(1970, 1, 1)).days
    for s in range(4):
        for n in range(-10, 1300):
            assert held.get((f"S{s}", first + n)) == in_force(rows, f"S{s}", day(n))


def test_policy_search_by_validity(spark):
    rng = random.Random(19)
    rows = random_revisions(rng)
    chunks = [(i, s, r, [float(rng.randrange(-9, 9)) for _ in range(3)]) for i, (s, r) in
              enumerate((x[0], x[1]) for x in rows for _ in range(2))]
    asked = [(q, day(rng.randrange(-20, 1300)), [float(rng.randrange(-9, 9)) for _ in range(3)]) for q in range(40)]
    asked += [(40, None, [1.0, 1.0, 1.0]), (41, dt.date(9999, 12, 31), [1.0, 1.0, 1.0]), (42, dt.date(1, 1, 1), [1.0, 1.0, 1.0])]
    found = search.search_policy_asof(
        spark.createDataFrame(asked, "query_id int, on_date date, embedding array<float>"),
        spark.createDataFrame(chunks, "chunk_id int, source string, revision_id string, embedding array<float>"),
        spark.createDataFrame(rows, KIND), 3).collect()
    want = []
    for q, date, e in asked:
        near = sorted((sum((a - b) ** 2 for a, b in zip(e, v)), i) for i, s, r, v in chunks if date and in_force(rows, s, date) == r)
        want += [(q, i, d) for d, i in near[:3]]
    assert sorted((r.query_id, r.chunk_id, r.distance) for r in found) == sorted(want)
    assert {r.query_id for r in found} >= {41}
