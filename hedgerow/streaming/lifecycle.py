"""Job lifecycle on a stream of job events: one active job per application."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hedgerow.rules import reviews as R

FIELDS = "status string, created_us bigint, started_us bigint, completed_us bigint"
OUT = "application_ref {key}, review_id {review}, " + FIELDS + ", outcome string"


class JobBook:
    """Jobs of one application, looked up one at a time, and which one is queued or running."""

    def __init__(self, lookup=None, active=None):
        self.jobs, self.lookup, self.active = {}, lookup, active

    def get(self, review):
        """(status, created, started, completed) of a job, or None."""
        if review not in self.jobs and self.lookup is not None:
            held = self.lookup(review)
            if held is not None:
                self.jobs[review] = held
        return self.jobs.get(review)

    def apply(self, review, event, micros, force):
        """Rows (review, status, created, started, completed, outcome) the event causes."""
        if event == "queued":
            if self.active is not None and self.active != review:
                if not force:
                    return [(review, "rejected", micros, None, None, "duplicate")]
                stopped = self.active
                self._set(stopped, "cancelled", micros)
                rows = [(stopped, *self.jobs[stopped], "force_cancelled")]
            else:
                rows = []
            self.jobs[review] = ("queued", micros, None, None)
            self.active = review
            return rows + [(review, *self.jobs[review], "accepted")]
        if self.get(review) is None:
            return [(review, event, None, None, None, "unknown")]
        self._set(review, event, micros)
        return [(review, *self.jobs[review], "updated")]

    def _set(self, review, status, micros):
        _, created, started, completed = self.get(review)
        if status == "processing":
            started = micros if started is None else started
        else:
            completed = micros
        self.jobs[review] = (status, created, started, completed)
        if status in R.ACTIVE_STATUSES:
            self.active = review
        elif self.active == review:
            self.active = None


class _Lifecycle(StatefulProcessor):
    def __init__(self, ttl_days, review_type):
        self.ttl_ms, self.review_type = ttl_days * 86_400_000, review_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        # times that are not known yet are stored as -1
        self.state = handle.getMapState("jobs", f"review_id {self.review_type}", FIELDS, self.ttl_ms)
        self.active = handle.getValueState("active", f"review_id {self.review_type}", self.ttl_ms)

    def _lookup(self, review):
        if not self.state.containsKey((review,)):
            return None
        status, *times = self.state.getValue((review,))
        return (status, *(None if t < 0 else t for t in times))

    def handleInputRows(self, key, rows, timer_values):
        import pandas as pd

        batch = pd.concat(list(rows)).sort_values(["micros", "event_id"])
        book = JobBook(self._lookup, self.active.get()[0] if self.active.exists() else None)
        out, touched = [], set()
        for review, event, micros, force in zip(batch["review_id"], batch["event"], batch["micros"], batch["force"]):
            for row in book.apply(review, event, int(micros), bool(force)):
                out.append((key[0], *row))
                touched.add(row[0])
        for review in touched & set(book.jobs):
            status, *times = book.jobs[review]
            self.state.updateValue((review,), (status, *(-1 if t is None else t for t in times)))
        if book.active is None:
            self.active.clear()
        else:
            self.active.update((book.active,))
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows):
    import pandas as pd

    names = ["application_ref", "review_id", "status", "created_us", "started_us", "completed_us", "outcome"]
    frame = pd.DataFrame(rows, columns=names)
    for c in names[3:6]:
        frame[c] = frame[c].astype("Int64")
    return frame


def _events(events: DataFrame) -> DataFrame:
    return events.select("application_ref", "review_id", "event", "event_id",
                         F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
                         F.coalesce("force", F.lit(False)).alias("force"))


def _times(df: DataFrame) -> DataFrame:
    def stamp(c):
        return F.timestamp_micros(F.col(f"{c}_us")).alias(f"{c}_at")

    return df.select("application_ref", "review_id", "status", stamp("created"), stamp("started"),
                     stamp("completed"), "outcome")


def lifecycle_stream(events: DataFrame, ttl_days: int = R.RESULT_TTL_DAYS) -> DataFrame:
    """State changes for a stream (application_ref, review_id, event, force, ts, event_id).

    A submission (``queued``) while another job of the application is active is a duplicate unless
    forced, which cancels the active one.  Jobs are forgotten ``ttl_days`` after their last change.
    """
    types = dict(events.dtypes)
    out = OUT.format(key=types["application_ref"], review=types["review_id"])
    return _times(_events(events).groupBy("application_ref").transformWithStateInPandas(
        statefulProcessor=_Lifecycle(ttl_days, types["review_id"]),
        outputStructType=out, outputMode="Append", timeMode="ProcessingTime"))


def lifecycle_batch(events: DataFrame) -> DataFrame:
    """The same state changes for a finished event log, read as a sorted stream per application."""
    def walk(batches):
        at, book = None, None
        for batch in batches:
            out = []
            for app, review, event, micros, force in batch.itertuples(index=False, name=None):
                if app != at:
                    at, book = app, JobBook()
                out += [(app, *row) for row in book.apply(review, event, int(micros), bool(force))]
            yield _frame(out)

    types = dict(events.dtypes)
    rows = (
        _events(events).repartition("application_ref")
        .sortWithinPartitions("application_ref", "micros", "event_id")
        .select("application_ref", "review_id", "event", "micros", "force")
    )
    return _times(rows.mapInPandas(walk, OUT.format(key=types["application_ref"], review=types["review_id"])))
