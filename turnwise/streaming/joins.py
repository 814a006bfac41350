"""Captures of the same speech among captures that are still coming in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intervals


def same_window_stream(
    utterances: DataFrame, at: str = "started_at", delay: str = "10 seconds", start_delta: int = intervals.START_DELTA_MS, end_delta: int = intervals.END_DELTA_MS, least: float = intervals.OVERLAP
) -> DataFrame:
    """``intervals.same_window`` as a join of a stream with itself; ``at`` is the start as a timestamp.

    The starts of a pair are at most ``start_delta`` apart, which bounds by the watermark how long a
    capture is kept for partners to come; so the state holds the captures of ``delay`` and that much.
    Both sides are keyed by room and slot, so a busy room isn't one task.
    """
    slot = F.floor(F.col("started_ms") / start_delta)
    own = utterances.withWatermark(at, delay)
    a = own.withColumn("slot", F.explode(F.array(slot - 1, slot, slot + 1))).alias("a")
    b = own.withColumn("slot", slot).alias("b")
    s1, e1, s2, e2 = F.col("a.started_ms"), F.col("a.ended_ms"), F.col("b.started_ms"), F.col("b.ended_ms")
    apart = F.expr(f"INTERVAL '{start_delta / 1000:.3f}' SECOND")
    fits = (
        (F.col("a.room") == F.col("b.room")) & (F.col("a.slot") == F.col("b.slot")) & (F.col("a.client_id") != F.col("b.client_id"))
        & (F.col(f"a.{at}") >= F.col(f"b.{at}") - apart) & (F.col(f"a.{at}") <= F.col(f"b.{at}") + apart)
        & (F.abs(s1 - s2) <= start_delta) & (F.abs(e1 - e2) <= end_delta) & (intervals.overlap_ratio(s1, e1, s2, e2) >= least)
    )
    return a.join(b, fits).select(*intervals.pair_columns())


def echo_stream(utterances: DataFrame, **limits) -> DataFrame:
    """``intervals.echoes`` on a stream."""
    return intervals.echoes(same_window_stream(utterances, **limits))
