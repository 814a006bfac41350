"""Late rows of a stream go to the rejects instead of being dropped without a trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATE = "late"


def marked(rows: DataFrame, batch: str, at: Column, delay_ms: int) -> DataFrame:
    """``rows`` with watermark_ms and is_late, in batch: a row is late if it is older than the newest one of earlier batches by more than ``delay_ms``.

    ``batch`` numbers the batches in order. One row a batch is ranked, whatever the batches hold.
    """
    newest = rows.groupBy(batch).agg(F.max(at).alias("_newest"))
    before = F.max("_newest").over(Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1))
    marks = newest.select(batch, (before - delay_ms).alias("watermark_ms"))
    return rows.join(marks, batch).withColumn("is_late", F.coalesce(at < F.col("watermark_ms"), F.lit(False)))


def _newest(spark: SparkSession, marks: str, before: int) -> int | None:
    """The newest time of all batches before one, from the marks that they have left (one row a batch)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(marks)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("newest_ms long, batch long").parquet(marks).where(F.col("batch") < before).agg(F.max("newest_ms")).first()[0]


def split(stream: DataFrame, at: Column, delay_ms: int, folder: str, **trigger) -> StreamingQuery:
    """Writes a stream's rows to ``folder``/accepted, or with ``reason`` to ``folder``/rejects if they are late by ``delay_ms``.

    ``at``: event time in milliseconds. Later steps read ``accepted`` as a stream, with a watermark of the
    same delay: it can't pass what is accepted here, so none of it is dropped. Each batch writes its own
    folders, and its newest time, so that a batch that is run again writes the same once more.
    ``folder`` must be seen by all executors; it holds the checkpoint too.
    """
    accepted, rejects, marks = (f"{folder}/{x}" for x in ("accepted", "rejects", "marks"))

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = _newest(spark, marks, number)
        timed = batch.withColumn("_at", at)
        late = F.coalesce(F.col("_at") < F.lit(None if newest is None else newest - delay_ms).cast("long"), F.lit(False))
        rows = timed.withColumn("_late", late).persist()
        own = f"batch={number}"
        rows.where("_late").drop("_at", "_late").withColumn("reason", F.lit(LATE)).write.mode("overwrite").parquet(f"{rejects}/{own}")
        rows.where("not _late").drop("_at", "_late").write.mode("overwrite").parquet(f"{accepted}/{own}")
        rows.agg(F.max("_at").alias("newest_ms")).write.mode("overwrite").parquet(f"{marks}/{own}")
        rows.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(**trigger) if trigger else writer).start()
