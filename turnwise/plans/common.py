"""Tables of the driver, seen as the engine's entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone (the session's zone is UTC)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


#: Event levels as frame levels: about two thirds are loud enough for speech.
LEVEL = 5_000.0


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: client_id, ts_us, event_id, rms, peak."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("client_id"), micros("ts").alias("ts_us"), "event_id", (F.col("value") / LEVEL).alias("rms"), (F.col("value") / LEVEL * 1.6).alias("peak"))


FRAMES_SQL = f"SELECT user_id AS client_id, epoch_us(ts) AS ts_us, event_id, value / {LEVEL} AS rms, value / {LEVEL} * 1.6 AS peak FROM events"


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as captures of ten minutes in three rooms."""
    e = table(spark, sf_dir, "events")
    at = micros("ts")
    return e.select(
        (F.col("user_id") % 3).alias("room"), F.col("user_id").alias("client_id"), F.col("event_id").alias("utterance_id"),
        F.floor(at / 1000).alias("started_ms"), (F.floor(at / 1000) + 600_000).alias("ended_ms"),
        (F.col("value") / 500).alias("avg_rms"), (F.col("value") / 400).alias("peak_rms"),
    )


UTTERANCES_SQL = """SELECT user_id % 3 AS room, user_id AS client_id, event_id AS utterance_id, epoch_us(ts) // 1000 AS started_ms,
    epoch_us(ts) // 1000 + 600000 AS ended_ms, value / 500 AS avg_rms, value / 400 AS peak_rms FROM events"""
