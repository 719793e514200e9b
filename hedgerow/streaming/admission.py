"""Sliding-log admission on a stream of requests."""

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hedgerow.rules import reviews as R


class SlidingLog:
    """Times (microseconds) of the admitted requests of one key within the last window."""

    def __init__(self, limit, window_s, times=()):
        self.limit, self.window, self.times = limit, window_s * 1_000_000, deque(times)

    def offer(self, now):
        """(admitted, remaining, retry_after seconds or None) for a request at ``now``."""
        while self.times and self.times[0] <= now - self.window:
            self.times.popleft()
        if len(self.times) >= self.limit:
            oldest = self.times[0] if self.times else now
            return False, 0, (oldest + self.window - now) // 1_000_000 + 1
        self.times.append(now)
        return True, self.limit - len(self.times), None


class _Admission(StatefulProcessor):
    """Waiting requests by second, and the log of those admitted; a timer opens each second once the watermark is past it."""

    def __init__(self, limit, window_s, id_type):
        self.limit, self.window_s, self.id_type = limit, window_s, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("admitted", "micros bigint")
        self.waiting = handle.getMapState("waiting", "second bigint", f"micros array<bigint>, ids array<{self.id_type}>")

    def _rows(self, key, out):
        import pandas as pd

        return pd.DataFrame(out, columns=["key", "request_id", "admitted", "remaining", "retry_after", "late"]).astype(
            {"remaining": "Int32", "retry_after": "Int32"})

    def handleInputRows(self, key, rows, timerValues):
        watermark = timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            late = []
            for second, part in batch.groupby(batch["micros"] // 1_000_000):
                second = int(second)
                if (second + 1) * 1000 <= watermark:  # what came after it has been decided
                    late += [(key[0], r, False, 0, None, True) for r in part["request_id"]]
                    continue
                micros, ids = part["micros"].tolist(), part["request_id"].tolist()
                if self.waiting.containsKey((second,)):
                    held = self.waiting.getValue((second,))
                    micros, ids = [*held[0], *micros], [*held[1], *ids]
                else:
                    self.handle.registerTimer((second + 1) * 1000)
                self.waiting.updateValue((second,), (micros, ids))
            if late:
                yield self._rows(key, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        watermark = timerValues.getCurrentWatermarkInMs()
        ready = sorted(s for (s,) in self.waiting.keys() if (s + 1) * 1000 <= watermark)
        log = SlidingLog(self.limit, self.window_s, [t[0] for t in self.log.get()])
        for second in ready:
            micros, ids = self.waiting.getValue((second,))
            yield self._rows(key, [(key[0], r, *log.offer(t), False) for t, r in sorted(zip(micros, ids))])
            self.waiting.removeKey((second,))
        live = [int(t) for t in log.times if t // 1000 + self.window_s * 1000 >= watermark]
        if live:
            self.log.put([(t,) for t in live])
            if ready:
                self.handle.registerTimer(live[-1] // 1000 + self.window_s * 1000 + 1)
        else:
            self.log.clear()

    def close(self) -> None:
        pass


def admit_stream(requests: DataFrame, limit: int = R.REQUEST_LIMIT, window_s: int = R.REQUEST_WINDOW_S,
                 delay: str = "10 seconds") -> DataFrame:
    """Admission decisions for a stream ``requests(key, request_id, ts)``, in order of event time.

    A request waits until the watermark, ``delay`` behind the newest time seen, is past its second; so rows that come out
    of order within ``delay`` are decided as if they had come in order. Later ones are refused by rule (``late``) and
    take no place. State of a key: what waits, one second in memory at a time, and at most ``limit`` times, which
    a timer clears a window after the last one. Needs the RocksDB state store provider.
    """
    types = dict(requests.dtypes)
    return (
        requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
        # the time goes on as a number, so that Spark does not drop late rows before they are answered
        .select("key", "request_id", F.unix_micros("ts").alias("micros"))
        .groupBy("key")
        .transformWithStateInPandas(
            statefulProcessor=_Admission(limit, window_s, types["request_id"]),
            outputStructType=(f"key {types['key']}, request_id {types['request_id']}, admitted boolean, "
                              "remaining int, retry_after int, late boolean"),
            outputMode="Append", timeMode="EventTime")
    )
