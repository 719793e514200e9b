"""Review jobs, their progress, and request admission, over tables.

``review_jobs(review_id, application_ref, status, created_at, started_at, completed_at)`` is the
latest state; ``job_events`` the log it comes from; ``phase_events(review_id, phase, event,
sub_current, sub_total, ts, event_id)`` the progress log, event being start, progress or complete.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgerow.operators import ordered
from hedgerow.rules import reviews as R


def list_jobs(jobs: DataFrame, status=None, application_ref=None, limit: int = R.PAGE_SIZE,
              offset: int = 0) -> DataFrame:
    """One page of jobs, newest first; both filters apply."""
    return (
        _job_filter(jobs, status, application_ref)
        .orderBy(F.col("created_at").desc(), F.col("review_id").desc())
        .offset(offset).limit(limit)
    )


def count_jobs(jobs: DataFrame, status=None, application_ref=None) -> DataFrame:
    return _job_filter(jobs, status, application_ref).agg(F.count("*").alias("total"))


def _job_filter(jobs, status, application_ref):
    if status is not None:
        jobs = jobs.filter(F.col("status") == status)
    if application_ref is not None:
        jobs = jobs.filter(F.col("application_ref") == application_ref)
    return jobs


def latest_completed(jobs: DataFrame) -> DataFrame:
    """Most recently completed review of each application (partial maxima, no window)."""
    done = F.struct("completed_at", "review_id")
    return (
        jobs.filter((F.col("status") == "completed") & F.col("completed_at").isNotNull())
        .groupBy("application_ref").agg(F.max(done).alias("d"))
        .select("application_ref", "d.review_id", "d.completed_at")
    )


def active_jobs(jobs: DataFrame) -> DataFrame:
    """Does an application have a queued or running review, and which (the newest)?"""
    running = F.col("status").isin(*R.ACTIVE_STATUSES)
    return jobs.groupBy("application_ref").agg(
        F.bool_or(running).alias("has_active"),
        F.max_by(F.when(running, F.col("review_id")), F.when(running, F.struct("created_at", "review_id")))
        .alias("active_review_id"))


# --- progress ---------------------------------------------------------------

def _weight(phase: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for kv in R.PHASE_WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(weights, phase), F.lit(0))


def progress_percent(events: DataFrame) -> DataFrame:
    """Percent complete after every event.

    Weights of the phases completed so far, plus the whole part of the current phase's share on a
    progress event, at most 99.  Phases are at most eight, so each review's first completions fit
    one row and no window over its events is needed.
    """
    at = F.struct("ts", "event_id")
    firsts = (
        events.filter("event = 'complete'").groupBy("review_id", "phase").agg(F.min(at).alias("at"))
        .groupBy("review_id").agg(F.collect_list(F.struct("at", _weight(F.col("phase")).alias("weight"))).alias("done"))
    )
    done = F.aggregate(
        F.filter(F.coalesce(F.col("done"), F.array()), lambda d: d["at"] <= at),
        F.lit(0), lambda s, d: s + d["weight"])
    share = F.when(
        (F.col("event") == "progress") & (F.coalesce("sub_total", F.lit(0)) > 0),
        F.floor(_weight(F.col("phase")) * (F.coalesce("sub_current", F.lit(0)) / F.col("sub_total"))).cast("int"),
    ).otherwise(0)
    return (
        events.join(firsts, "review_id", "left")
        .withColumn("percent_complete", F.least(F.lit(99), done + share)).drop("done")
    )


def review_progress(events: DataFrame) -> DataFrame:
    """Where each review stands: completed weight, current share, errors (also runs on a stream).

    The order within a review is only needed for the last progress event, so this is one
    aggregation: which phases completed, and the latest (ts, event_id) progress.
    """
    at = F.struct("ts", "event_id")
    moving = F.col("event").isin("start", "progress")
    phases = [F.max((F.col("event") == "complete") & (F.col("phase") == p)).alias(f"_{p}") for p in R.PHASE_WEIGHTS]
    last = F.max(F.when(moving, F.struct(at.alias("at"), "phase", "event", "sub_current", "sub_total"))).alias("_last")
    done = sum((F.when(F.col(f"_{p}"), w).otherwise(0) for p, w in R.PHASE_WEIGHTS.items()), F.lit(0))
    current = F.col("_last")
    finished = F.lit(False)
    for p in R.PHASE_WEIGHTS:
        finished = finished | ((current["phase"] == p) & F.col(f"_{p}"))
    share = F.when(
        (F.coalesce(current["sub_total"], F.lit(0)) > 0) & ~finished,
        F.floor(_weight(current["phase"]) * (F.coalesce(current["sub_current"], F.lit(0)) / current["sub_total"])).cast("int"),
    ).otherwise(0)
    return (
        events.groupBy("review_id").agg(
            *phases, last, F.count_if(F.col("event") == "error").alias("error_count"))
        .select("review_id", current["phase"].alias("phase"),
                F.least(F.lit(99), done + share).alias("percent_complete"), "error_count")
    )


def phase_durations(events: DataFrame) -> DataFrame:
    """Seconds from the start to the completion of each phase of each review."""
    start = F.min(F.when(F.col("event") == "start", F.col("ts")))
    end = F.max(F.when(F.col("event") == "complete", F.col("ts")))
    return (
        events.groupBy("review_id", "phase")
        .agg(start.alias("started_at"), end.alias("completed_at"),
             F.count_if(F.col("event") == "error").alias("error_count"))
        .withColumn("duration_seconds", (F.unix_micros(F.col("completed_at").cast("timestamp"))
                                         - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1_000_000)
    )


def review_durations(phases: DataFrame) -> DataFrame:
    """Total over a review's phases: phases done, first start to last completion, errors."""
    first, last = F.min("started_at").cast("timestamp"), F.max("completed_at").cast("timestamp")
    return phases.groupBy("review_id").agg(
        F.count("completed_at").alias("phases_completed"),
        ((F.unix_micros(last) - F.unix_micros(first)) / 1_000_000).alias("total_duration_seconds"),
        F.sum("error_count").alias("error_count"))


# --- job lifecycle ----------------------------------------------------------

def job_lifecycle(events: DataFrame) -> DataFrame:
    """Fold job events (review_id, application_ref, event, ts, event_id) to the latest state.

    ``event`` is the status reached; the last one counts, the first ``processing`` is the start.
    """
    at = F.struct("ts", "event_id")
    ended = F.col("event").isin("completed", "failed", "cancelled")
    return events.groupBy("review_id").agg(
        F.max_by("application_ref", at).alias("application_ref"),
        F.max_by("event", at).alias("status"),
        F.min("ts").alias("created_at"),
        F.min(F.when(F.col("event") == "processing", F.col("ts"))).alias("started_at"),
        F.max(F.when(ended, F.col("ts"))).alias("completed_at"),
    )


# --- admission --------------------------------------------------------------

def idle_sessions(requests: DataFrame, window_s: int, key: str = "key", order=("ts", "request_id")) -> DataFrame:
    """Add ``session``: a pause of a whole window empties the log, so what follows starts afresh."""
    def paused(before, row):
        def micros(r):
            return F.unix_micros(r[order[0]].cast("timestamp"))

        return micros(row) - micros(before) >= window_s * 1_000_000

    return ordered.islands(requests, [key], list(order), [order[0]], paused, "session",
                           ordered.time_block(order[0], max(window_s, 60) * 16))


def admit_requests(requests: DataFrame, limit: int = R.REQUEST_LIMIT, window_s: int = R.REQUEST_WINDOW_S,
                   key: str = "key") -> DataFrame:
    """Sliding-log rate limit over ``requests(key, request_id, ts)``.

    An admitted request occupies one of ``limit`` places until a window has passed; refused ones
    occupy none.  Adds ``admitted``, ``remaining`` and ``retry_after`` (whole seconds, null if
    admitted).  A key is cut where it pauses for a whole window; the parts are independent, are
    spread over tasks and read as a sorted stream that remembers ``limit`` times only.
    """
    def walk(batches):
        import pandas as pd

        from hedgerow.streaming.admission import SlidingLog

        at, log = None, None
        for batch in batches:
            out = []
            for k, session, request, micros in batch.itertuples(index=False, name=None):
                if (k, session) != at:
                    at, log = (k, session), SlidingLog(limit, window_s)
                out.append((k, request, *log.offer(micros)))
            yield pd.DataFrame(out, columns=["k", "request_id", "admitted", "remaining", "retry_after"])

    types = dict(requests.dtypes)
    parts = (
        idle_sessions(requests, window_s, key)
        .select(key, "session", "request_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
        .repartition(key, "session").sortWithinPartitions(key, "session", "micros", "request_id")
    )
    return parts.mapInPandas(
        walk, f"k {types[key]}, request_id {types['request_id']}, admitted boolean, remaining int, retry_after int"
    ).withColumnRenamed("k", key)


def count_requests(requests: DataFrame, window: str = "60 seconds", slide: str = "10 seconds", delay: str = "30 seconds") -> DataFrame:
    """Requests per key and sliding window; on a stream a window is final, and leaves the state, ``delay`` after its end."""
    if requests.isStreaming:
        requests = requests.withWatermark("ts", delay)
    return requests.groupBy("key", F.window("ts", window, slide).alias("w")).agg(
        F.count("*").alias("requests")).select("key", "w.start", "w.end", "requests")
