"""What a stream reports about itself."""

from __future__ import annotations

import threading
import time
from collections import defaultdict

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

#: Seconds to wait for the report of a batch that has ended.
PATIENCE = 30.0


class StreamTotals(StreamingQueryListener):
    """Adds up the reports of every stream of a session as they come, so a stream may be of any
    length: Spark itself keeps the latest hundred only."""

    def __init__(self, metrics: str) -> None:
        self.metrics = metrics
        self._lock = threading.Lock()
        self._sums: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        self._last: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        progress = event.progress
        counts = progress.observedMetrics.get(self.metrics)
        with self._lock:
            sums = self._sums[str(progress.runId)]
            sums[" rows read"] += progress.numInputRows
            sums[" milliseconds"] += progress.batchDuration
            for name, count in (counts.asDict() if counts else {}).items():
                sums[name] += count or 0
            self._last[str(progress.runId)] = progress.batchId

    def of(self, query: StreamingQuery) -> dict[str, int]:
        """The sums of one run, as soon as its latest batch is among them."""
        run, last = str(query.runId), query.lastProgress
        until = time.monotonic() + PATIENCE
        while last is not None and self._last.get(run, -1) < last.batchId:
            if time.monotonic() > until:
                raise ValueError("the stream was started before its reports were watched")
            time.sleep(0.05)
        with self._lock:
            return dict(self._sums[run])


_watching: dict[str, StreamTotals] = {}


def watch(spark: SparkSession, metrics: str) -> StreamTotals:
    """The totals of a session's streams, from the first call on."""
    app = spark.sparkContext.applicationId
    if app not in _watching:
        _watching[app] = StreamTotals(metrics)
        spark.streams.addListener(_watching[app])
    return _watching[app]


def stream_summary(spark: SparkSession, query: StreamingQuery, unit: str | None = None) -> DataFrame:
    """Status, total, seconds spent and throughput of this run, as one row.

    With a ``unit``, e.g. utterances, the total is the rows that the stream made of the landed lines,
    before any rule dropped some; without one, the lines themselves.
    """
    sums = _totals(spark, query)
    total, seconds = sums.get("rows" if unit else " rows read", 0), sums.get(" milliseconds", 0) / 1000
    unit = unit or "lines"
    rate = total / seconds if seconds else 0.0
    row = Row(
        status="running" if query.isActive else "complete",
        total=total,
        elapsed_seconds=round(seconds, 2),
        throughput=round(rate, 2),
        throughput_description=f"{round(rate, 0)} {unit}/second",
    )
    layout = "status string, total long, elapsed_seconds double, throughput double, throughput_description string"
    return spark.createDataFrame([row], layout)


def observed_breaches(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """Rows and breaches per rule that the stream counted while the rows flowed by."""
    totals = {k: n for k, n in _totals(spark, query).items() if not k.startswith(" ")}
    rows = totals.pop("rows", 0)
    return spark.createDataFrame(
        [(name, rows, failed) for name, failed in totals.items()], "rule string, rows long, failed long"
    )


def _totals(spark: SparkSession, query: StreamingQuery) -> dict[str, int]:
    from aerovox.streaming.ingest import QUALITY_METRICS

    return watch(spark, QUALITY_METRICS).of(query)
