"""Policies and the revisions in force on a date.

Tables: ``policies(source, title, category, ...)`` and ``policy_revisions(source, revision_id,
effective_from, effective_to, status, ...)``; an interval is closed at both ends and a null end
means still in force.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hedgerow.functions import dates
from hedgerow.operators.intervals import best_on, day_candidates, span_of
from hedgerow.operators.pairing import every_pair
from hedgerow.rules import policies as P


def _epoch(day) -> Column:
    return F.unix_date(day)


def _candidates(pairs: DataFrame, revisions: DataFrame, carry) -> DataFrame:
    """(source, span, held, first_start) for the spans of 64 days that ``pairs(source, on_date)`` asks about."""
    asked = pairs.filter("source is not null and on_date is not null").select(
        "source", span_of(_epoch("on_date")).alias("span")).distinct()
    live = revisions.filter(F.col("status").isin(*P.IN_FORCE_STATUSES)).select(
        "source", _epoch("effective_from").alias("lo"), _epoch("effective_to").alias("hi"),
        F.struct("effective_from", "revision_id", *carry).alias("rev"))
    firsts = revisions.groupBy("source").agg(F.min("effective_from").alias("first_start"))
    return asked.join(day_candidates(asked, live, ["source"], "rev"), ["source", "span"], "left").join(firsts, "source", "left")


def effective_revision(probes: DataFrame, revisions: DataFrame, carry=("effective_to", "status")) -> DataFrame:
    """As-of lookup: every probe row (source, on_date, ...) with its revision, or the reason there is none.

    Latest start wins, then the larger revision id; only active and superseded revisions count.  Revisions are cut only
    where a probe asks, and the probes are joined once, to one row per (source, span of 64 days).  A probe without
    source or date has neither revision nor reason.
    """
    day = _epoch("on_date")
    found = probes.withColumn("_span", span_of(day)).join(
        _candidates(probes, revisions, carry).withColumnRenamed("span", "_span"), ["source", "_span"], "left")
    rev = F.col("_rev")
    reason = (
        F.when(rev.isNotNull() | F.col("source").isNull() | F.col("on_date").isNull(), F.lit(None).cast("string"))
        .when(F.col("first_start").isNull(), "no_revisions")
        .when(F.col("on_date") < F.col("first_start"), "date_before_first_revision")
        .otherwise("date_in_gap")
    )
    return found.withColumn("_rev", best_on(day, "rev")).select(
        *[F.col(c) for c in probes.columns], "_rev.revision_id", "_rev.effective_from",
        *[F.col(f"_rev.{c}").alias(c) for c in carry], reason.alias("reason"))


def resolve(pairs: DataFrame, revisions: DataFrame, carry=("effective_to", "status")) -> DataFrame:
    """``effective_revision`` of each distinct (source, on_date)."""
    return effective_revision(pairs.select("source", "on_date").distinct(), revisions, carry)


def reigns(revisions: DataFrame) -> DataFrame:
    """(source, revision_id, lo, hi): the runs of days on which a revision is the one in force; an open run has no ``hi``.

    What is in force changes only where a revision starts or the day after one ends.  Those days are resolved; the
    windows run over the distinct ones of a source, of which there is at most a calendar's worth.
    """
    live = revisions.filter(F.col("status").isin(*P.IN_FORCE_STATUSES))
    cuts = live.select("source", F.explode(F.array("effective_from", F.date_add("effective_to", 1))).alias("on_date"))
    w = Window.partitionBy("source").orderBy("on_date")
    rev = F.struct("revision_id", "effective_from")
    found = resolve(cuts.filter("on_date is not null"), revisions, ()).withColumn("_before", F.lag(rev).over(w))
    changes = found.filter(F.col("_before").isNull() | (rev != F.col("_before"))
                           | F.col("revision_id").isNull() | F.col("_before.revision_id").isNull())
    runs = changes.withColumn("_next", F.lead("on_date").over(w)).filter("revision_id is not null")
    return runs.select("source", "revision_id", _epoch("on_date").alias("lo"), (_epoch("_next") - 1).alias("hi"))


def policy_snapshot(policies: DataFrame, dates_: DataFrame, revisions: DataFrame) -> DataFrame:
    """One row per policy and date (column ``on_date``) with its revision, reason and bucket."""
    probes = every_pair(policies, dates_.select("on_date").distinct(), "on_date")
    found = effective_revision(probes, revisions)
    return found.withColumn(
        "bucket",
        F.when(F.col("revision_id").isNotNull(), "with_revision")
        .when(F.col("reason") == "date_before_first_revision", "not_yet_effective")
        .when(F.col("reason") == "date_in_gap", "in_gap"),
    )


def snapshot_counts(snapshot: DataFrame) -> DataFrame:
    """Sizes of the three snapshot lists per date."""
    return snapshot.groupBy("on_date").agg(
        F.count_if(F.col("bucket") == "with_revision").alias("policies_with_revision"),
        F.count_if(F.col("bucket") == "not_yet_effective").alias("policies_not_yet_effective"),
        F.count_if(F.col("bucket") == "in_gap").alias("policies_in_gap"),
        F.count("*").alias("policies"),
    )


def revision_ids_for_date(probes: DataFrame, revisions: DataFrame) -> DataFrame:
    """source, on_date -> revision_id or null."""
    return resolve(probes, revisions).select("source", "on_date", "revision_id")


def validate_revision_for_date(claims: DataFrame, revisions: DataFrame) -> DataFrame:
    """Was the cited revision in force on the date?  Its status does not matter."""
    known = revisions.select("source", "revision_id", "effective_from", "effective_to")
    inside = dates.in_force(F.col("on_date"), F.col("effective_from"), F.col("effective_to"))
    return (
        claims.join(known, ["source", "revision_id"], "left")
        .withColumn("valid", F.coalesce(inside, F.lit(False)))
        .drop("effective_from", "effective_to")
    )


def next_starts(revisions: DataFrame) -> DataFrame:
    """Next later start per (source, start) over non-failed revisions.

    The window runs over distinct start days, of which a source has at most a calendar's worth.
    """
    w = Window.partitionBy("source").orderBy("effective_from")
    return (
        revisions.filter(F.col("status") != "failed")
        .select("source", "effective_from").distinct()
        .withColumn("next_from", F.lead("effective_from").over(w))
    )


def auto_supersede(revisions: DataFrame) -> DataFrame:
    """An open revision ends the day before the next one of its source starts."""
    open_ = F.col("effective_to").isNull() & (F.col("status") != "failed") & F.col("next_from").isNotNull()
    return (
        revisions.join(next_starts(revisions), ["source", "effective_from"], "left")
        .withColumn("superseded", F.coalesce(open_, F.lit(False)))
        .withColumn("effective_to", F.when(open_, F.date_sub("next_from", 1)).otherwise(F.col("effective_to")))
        .drop("next_from")
    )


def superseded_by(revisions: DataFrame) -> DataFrame:
    """The revision that starts the day after this one ends, taken from the dates alone."""
    starts = (
        revisions.filter(F.col("status") != "failed")
        .groupBy("source", "effective_from")
        .agg(F.max("revision_id").alias("superseded_by"))
        .select("source", F.date_sub("effective_from", 1).alias("effective_to"), "superseded_by")
    )
    return revisions.join(starts, ["source", "effective_to"], "left")


def _by_day(days: DataFrame, starts: DataFrame, picked: Column, ahead: bool) -> DataFrame:
    """For each (source, day) the nearest start day's ``picked`` value: at or after, or before.

    Both inputs hold distinct days per source, so the window is bounded by the calendar.
    """
    union = days.select("source", "day", F.lit(None).alias("picked"), F.lit(1).alias("ask")).unionByName(
        starts.select("source", "day", picked.alias("picked"), F.lit(0).alias("ask")))
    if ahead:  # starts of the same day count
        w = Window.partitionBy("source").orderBy(F.col("day").desc(), "ask")
    else:  # starts of the same day do not
        w = Window.partitionBy("source").orderBy("day", F.col("ask").desc())
    near = F.last("picked", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return union.withColumn("near", near).filter("ask = 1").select("source", "day", "near")


def check_new_revisions(new: DataFrame, revisions: DataFrame) -> DataFrame:
    """Would each new revision (source, revision_id, effective_from, effective_to) be accepted?

    Existing revisions are visited by (start, id).  An open one that starts earlier is superseded;
    an open one that starts within the new interval, or a closed one that overlaps it, is a
    conflict.  ``conflict_with`` is the first conflict or null; ``supersedes`` the latest open
    revision that would end at ``supersedes_until``.  A rejected revision changes nothing.

    The first conflict is either the earliest closed interval that holds the new start (a stabbing
    query by nodes of spans) or the next start on or after it; no pairs of revisions are formed.
    """
    live = revisions.filter(F.col("status") != "failed")
    start = F.struct(F.col("effective_from").alias("at"), F.col("revision_id").alias("id"))
    days = new.select("source", F.col("effective_from").alias("day")).distinct()

    # earliest closed interval holding the day
    closed = live.filter(F.col("effective_to").isNotNull()).select(
        "source", _epoch("effective_from").alias("lo"), _epoch("effective_to").alias("hi"), start.alias("start"))
    asked = days.select("source", span_of(_epoch("day")).alias("span"))
    holding = (
        days.withColumn("span", span_of(_epoch("day")))
        .join(day_candidates(asked.distinct(), closed, ["source"], "start", largest=False), ["source", "span"])
        .select("source", "day", best_on(_epoch("day"), "start", largest=False).alias("holding"))
    )

    starts = live.groupBy("source", F.col("effective_from").alias("day")).agg(
        F.min(start).alias("first"), F.max(F.when(F.col("effective_to").isNull(), start)).alias("open"))
    ahead = _by_day(days, starts, F.col("first"), True).withColumnRenamed("near", "ahead")
    before = _by_day(days, starts.filter("open is not null"), F.col("open"), False).withColumnRenamed("near", "open")

    far = F.make_date(F.lit(9999), F.lit(12), F.lit(31))
    inside = F.when(F.col("ahead.at") <= F.coalesce("effective_to", far), F.col("ahead"))
    facts = days.join(holding, ["source", "day"], "left").join(ahead, ["source", "day"], "left").join(
        before, ["source", "day"], "left").withColumnRenamed("day", "effective_from")
    return (
        new.join(facts, ["source", "effective_from"], "left")
        .withColumn("conflict_with", F.least(F.col("holding"), inside)["id"])
        .withColumn("supersedes", F.when(F.col("conflict_with").isNull(), F.col("open.id")))
        .withColumn("supersedes_until", F.when(F.col("supersedes").isNotNull(), F.date_sub("effective_from", 1)))
        .drop("holding", "ahead", "open")
    )


def superseded_revisions(new: DataFrame, revisions: DataFrame) -> DataFrame:
    """Every revision that an accepted new one ends: (source, revision_id, ended, ended_on).

    These are all open revisions of the source that start earlier; each ends the day before the new one starts.  A
    rejected revision ends nothing.
    """
    accepted = check_new_revisions(new, revisions).filter("conflict_with is null").select(
        "source", "revision_id", F.col("effective_from").alias("_starts"))
    open_ = revisions.filter("status <> 'failed' and effective_to is null").select(
        "source", F.col("revision_id").alias("ended"), F.col("effective_from").alias("_since"))
    return accepted.join(open_, "source").filter("_since < _starts").select(
        "source", "revision_id", "ended", F.date_sub("_starts", 1).alias("ended_on"))


def revision_overlaps(revisions: DataFrame) -> DataFrame:
    """Non-failed revisions that overlap an earlier one of their source.

    A revision overlaps something before it exactly when the furthest end among all earlier
    (start, id) reaches its start, so no pairs are formed: starts are grouped per day, the
    furthest end is carried along the days of a source, and same-day copies are compared with
    the day's first id.
    """
    live = revisions.filter(F.col("status") != "failed")
    far = F.make_date(F.lit(9999), F.lit(12), F.lit(31))
    days = live.groupBy("source", "effective_from").agg(
        F.max(F.coalesce("effective_to", far)).alias("day_end"),
        F.min("revision_id").alias("first_id"),
    )
    w = Window.partitionBy("source").orderBy("effective_from").rowsBetween(Window.unboundedPreceding, -1)
    reach = days.withColumn("reach", F.max("day_end").over(w)).select(
        "source", "effective_from", "reach", "first_id")
    return (
        live.join(reach, ["source", "effective_from"])
        .withColumn("overlaps", F.coalesce(F.col("reach") >= F.col("effective_from"), F.lit(False))
                    | (F.col("revision_id") != F.col("first_id")))
        .filter("overlaps")
        .drop("reach", "first_id", "overlaps")
    )


def policy_overview(policies: DataFrame, revisions: DataFrame, today: Column) -> DataFrame:
    """Per policy: number of revisions and the active revision in force today (earliest start)."""
    live = (F.col("status") == "active") & dates.in_force(today, F.col("effective_from"), F.col("effective_to"))
    per = revisions.groupBy("source").agg(
        F.count("*").alias("revision_count"),
        F.min(F.when(live, F.struct("effective_from", "revision_id"))).alias("now"),
    )
    return (
        policies.join(per, "source", "left")
        .withColumn("revision_count", F.coalesce("revision_count", F.lit(0)))
        .withColumn("current_revision", F.col("now.revision_id"))
        .drop("now")
    )


def list_policies(policies: DataFrame, category=None, source=None) -> DataFrame:
    if category is not None:
        policies = policies.filter(F.col("category") == category)
    if source is not None:
        policies = policies.filter(F.col("source") == source)
    return policies.orderBy("source")


def list_revisions(revisions: DataFrame, source=None) -> DataFrame:
    """Newest start first."""
    if source is not None:
        revisions = revisions.filter(F.col("source") == source)
    return revisions.orderBy(F.col("effective_from").desc(), F.col("revision_id").desc())


def can_delete_revision(revisions: DataFrame) -> DataFrame:
    """False for the only active revision of a source."""
    active = revisions.groupBy("source").agg(F.count_if(F.col("status") == "active").alias("active_count"))
    return revisions.join(active, "source").withColumn(
        "can_delete", ~((F.col("status") == "active") & (F.col("active_count") <= 1)))


def validate_revisions(revisions: DataFrame) -> DataFrame:
    """Add ``violations``: codes of every format or range rule a row breaks."""
    checks = F.array(
        F.when(~F.col("source").rlike(P.SLUG_PATTERN), "bad_source"),
        F.when(F.col("effective_to") < F.col("effective_from"), "bad_range"),
    )
    return revisions.withColumn("violations", F.array_compact(checks))


def validate_references(df: DataFrame, column: str = "application_ref") -> DataFrame:
    return df.withColumn("valid_ref", F.coalesce(F.col(column).rlike(P.REFERENCE_PATTERN), F.lit(False)))


def in_force_chunks(chunks: DataFrame, on_date=None, sources=None, revision_id=None) -> DataFrame:
    """Policy chunks by their own frozen validity numbers, source and revision (pushed to the scan)."""
    if on_date is not None:
        day = dates.date_to_int(on_date)
        chunks = chunks.filter((F.col("effective_from") <= day) & (F.col("effective_to") >= day))
    if sources:
        chunks = chunks.filter(F.col("source").isin(*sources))
    if revision_id is not None:
        chunks = chunks.filter(F.col("revision_id") == revision_id)
    return chunks


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Chunks per revision, per source and in all, in one pass."""
    return (
        chunks.rollup("source", "revision_id")
        .agg(F.count("*").alias("chunks"), F.grouping_id().alias("level"))
    )


def policy_section(chunks: DataFrame) -> DataFrame:
    """Every section of every revision: joined text and the pages it is on."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return chunks.filter(F.col("section_ref") != "").groupBy("source", "revision_id", "section_ref").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"),
        F.array_sort(F.collect_set("page_number")).alias("page_numbers"),
        F.count("*").alias("chunks"),
    )
