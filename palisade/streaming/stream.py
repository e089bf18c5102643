"""The guard on streams: checks and scans are row-local, so they apply to a streaming DataFrame as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detector import Detector
from ..operators.scan import scan_rows


def check_stream(stream: DataFrame, column: str, detector: Detector | None = None, name: str = "verdict") -> DataFrame:
    return (detector or Detector()).check(stream, column, name)


def scan_stream(stream: DataFrame, detector: Detector | None = None) -> DataFrame:
    return scan_rows(stream, detector.signatures if detector else None)


def blocked_per_window(checked: DataFrame, time: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """window, reason, n: blocked texts by event-time window, with a watermark that bounds the state."""
    return checked.withWatermark(time, late).where("verdict.blocked").groupBy(F.window(time, window), F.col("verdict.reason").alias("reason")).agg(F.count("*").alias("n"))


def adaptive_query(stream: DataFrame, column: str, detector: Callable[[], Detector], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Checks each micro-batch with the detector as it is then, so patterns learned meanwhile count from the next batch on."""

    def each(batch: DataFrame, epoch: int) -> None:
        sink(detector().check(batch, column), epoch)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
