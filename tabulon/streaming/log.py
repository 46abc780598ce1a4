"""Appends to the sealed log from a stream of requests, and running counts by period with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabulon.operators import sealedlog as S


def append(requests: DataFrame, seals: DataFrame, periods: DataFrame, log: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Judge each micro-batch and append envelopes and rejected requests to two Parquet tables.

    Sequence numbers have no gaps, as in ``sealedlog.post``: a batch goes on where the one before it ended, which that one
    left in a row of its own beside the log (``<log>_next``). So a batch that is run again writes the same rows; it does so
    into its own folders, replacing what a failed attempt left.
    """
    ends = f"{log}_next"

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        first = spark.read.schema("next long").parquet(f"{ends}/epoch={epoch - 1}").first()["next"] if epoch else 0
        batch = batch.persist()
        S.post(batch, seals, periods, first_seq=first).write.mode("overwrite").parquet(f"{log}/epoch={epoch}")
        written = spark.read.parquet(f"{log}/epoch={epoch}").agg((F.count("*") + first).alias("next"))
        written.write.mode("overwrite").parquet(f"{ends}/epoch={epoch}")
        S.judged(batch, seals, periods).where("reason IS NOT NULL").write.mode("overwrite").parquet(f"{rejected}/epoch={epoch}")
        batch.unpersist()

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, ts: str = "ts", width: str = "1 day", late: str = "2 days", by: str = "event_type") -> DataFrame:
    """Writes by window and type; rows later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"))
