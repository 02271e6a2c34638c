"""The running count of a day's requests as a stream, row by row, in the order of the events and not of their arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


class DailyCounter(StatefulProcessor):
    """Holds a day's events until the watermark has passed them, numbers them by (time, id), and forgets the day by a timer at its end.

    State: the number given last, and the waiting events, a row of arrays for each arrival. One timer is set: at the first waiting event, else at the day's end.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")
        self.waiting = handle.getListState("waiting", "us array<long>, ids array<long>")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            us, ids = [int(x) for x in frame["us"]], [int(x) for x in frame["event_id"]]
            if us:
                self.waiting.appendValue((us, ids))
                first = min([*us, *([] if first is None else [first])])
        if first is not None and not self.timer.exists():
            self._set(first // 1000 + 1)
        yield pd.DataFrame({"day": [], "event_id": [], "requests_today": []})

    def _set(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((int(u), int(i)) for us, ids in self.waiting.get() for u, i in zip(us, ids))
        ready = [x for x in held if x[0] < passed]
        rest = held[len(ready) :]
        before = int(self.count.get()[0]) if self.count.exists() else 0
        self.waiting.clear()
        self.timer.clear()
        end = (int(key[0]) + 1) * DAY_MS
        if rest:
            self.waiting.appendValue(([u for u, _ in rest], [i for _, i in rest]))
            self.count.update((before + len(ready),))
            self._set(rest[0][0] // 1000 + 1)
        elif passed >= end * 1000:
            self.count.clear()  # the day is over
        else:
            self.count.update((before + len(ready),))
            self._set(end)
        yield pd.DataFrame({"day": [int(key[0])] * len(ready), "event_id": [i for _, i in ready], "requests_today": [before + n for n in range(1, len(ready) + 1)]})

    def close(self) -> None:
        pass


def running_daily_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of events (event_id, ts) -> day, event_id, requests_today, once for each event, after the watermark has passed it.

    Equal to telemetry.running_daily for all events that come at most `late` behind the newest; later ones are dropped. Null times are left out.
    A day is one key and its events pass through one task: this is the counter of a service; the batch form deals a day to spans.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = events.where("ts is not null").select("event_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("us", F.unix_micros("ts")).withColumn("day", F.floor(F.col("us") / (DAY_MS * 1000)).cast("long"))
    out = rows.withWatermark("ts", late).groupBy("day").transformWithStateInPandas(DailyCounter(), outputStructType="day long, event_id long, requests_today long", outputMode="Append", timeMode="EventTime")
    return out.select(F.date_from_unix_date(F.col("day").cast("int")).alias("day"), "event_id", "requests_today")
