"""Progress of reviews on a stream of phase events."""

from pyspark.sql import DataFrame

from hedgerow.operators import jobs


def progress_stream(events: DataFrame) -> DataFrame:
    """Latest progress and error count per review, for update mode.

    State is one row per review: eight flags and the latest progress event.
    """
    return jobs.review_progress(events)
