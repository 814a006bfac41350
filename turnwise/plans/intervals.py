"""Queries on intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals
from ..registry import query
from .common import UTTERANCES_SQL, utterances

_PAIRS = f"""
    WITH u AS ({UTTERANCES_SQL}), p AS (
        SELECT a.room, a.utterance_id AS left_id, b.utterance_id AS right_id,
               greatest(0, least(a.ended_ms, b.ended_ms) - greatest(a.started_ms, b.started_ms))
               / least(greatest(1, a.ended_ms - a.started_ms), greatest(1, b.ended_ms - b.started_ms)) AS overlap_ratio,
               a.avg_rms AS left_rms, b.avg_rms AS right_rms, a.peak_rms AS left_peak, b.peak_rms AS right_peak
        FROM u a JOIN u b ON a.room = b.room AND a.client_id <> b.client_id
             AND abs(a.started_ms - b.started_ms) <= 65000 AND abs(a.ended_ms - b.ended_ms) <= 90000)"""


@query("C1_C2_same_capture_window", _PAIRS + "SELECT room, left_id, right_id, round(overlap_ratio, 9) AS overlap_ratio FROM p WHERE overlap_ratio >= 0.7")
def same_window(spark, d):
    """Captures of the same speech (limits a hundred times wider than the product's, for the density of the test)."""
    p = intervals.same_window(utterances(spark, d), 65_000, 90_000)
    return p.select("room", "left_id", "right_id", F.round("overlap_ratio", 9).alias("overlap_ratio"))


@query("C3_room_echo", _PAIRS + "SELECT room, left_id, right_id FROM p WHERE overlap_ratio >= 0.7 AND left_rms > 0 AND right_rms > 0 AND left_rms / right_rms >= 1.6 AND left_peak / greatest(right_peak, 1e-9) >= 1.25")
def room_echo(spark, d):
    """Pairs of which the second is likely an echo."""
    return intervals.echoes(intervals.same_window(utterances(spark, d), 65_000, 90_000)).select("room", "left_id", "right_id")


_MERGED = f"""
    WITH u AS ({UTTERANCES_SQL}), r AS (SELECT client_id, started_ms AS s, ended_ms AS e FROM u),
    m AS (SELECT *, max(e) OVER (PARTITION BY client_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY client_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
    merged AS (SELECT client_id, min(s) AS s, max(e) AS e FROM i GROUP BY client_id, island)"""


def _ranges(spark, d):
    return utterances(spark, d).select("client_id", F.col("started_ms").alias("start"), F.col("ended_ms").alias("end"))


@query("D18_merge_ranges", _MERGED + 'SELECT client_id, s AS start, e AS "end" FROM merged')
def merge_ranges(spark, d):
    """Unions of intervals, touching ones too."""
    return intervals.merged(_ranges(spark, d), ["client_id"])


@query("D19_covered", _MERGED + "SELECT client_id, CAST(sum(e - s) AS BIGINT) AS covered FROM merged GROUP BY client_id")
def covered(spark, d):
    """Clean length of each client."""
    return intervals.merged(_ranges(spark, d), ["client_id"]).groupBy("client_id").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


@query(
    "C6_B23_subtract_ranges",
    _MERGED
    + """, b AS (SELECT client_id, min(s) - 5600 AS bs, max(e) + 5600 AS be FROM merged GROUP BY client_id),
    g AS (SELECT client_id, lag(e) OVER (PARTITION BY client_id ORDER BY s) AS s, s AS e FROM merged
          UNION ALL SELECT client_id, bs, bs + 5600 FROM b UNION ALL SELECT client_id, be - 5600, be FROM b)
    SELECT client_id, s AS start, e AS "end" FROM g WHERE s IS NOT NULL AND e - s >= 5600""",
)
def subtract_ranges(spark, d):
    """What no capture covers, in pieces of 5600 or more."""
    r = _ranges(spark, d)
    base = r.groupBy("client_id").agg((F.min("start") - 5600).alias("base_start"), (F.max("end") + 5600).alias("base_end"))
    return intervals.subtracted(base, r, ["client_id"])


@query(
    "C5_other_speaker_blocks",
    f"""WITH u AS (SELECT room, client_id AS label, started_ms // 100 AS s, ended_ms // 100 AS e FROM ({UTTERANCES_SQL}))
        SELECT DISTINCT a.room, a.label, a.s AS base_start, a.e AS base_end, greatest(a.s, b.s) AS start, least(a.e, b.e) AS "end"
        FROM u a JOIN u b ON a.room = b.room AND a.label <> b.label AND a.s < b.e AND b.s < a.e""",
)
def other_blocks(spark, d):
    """Overlaps with segments of other speakers."""
    u = utterances(spark, d).select("room", F.col("client_id").alias("label"), F.floor(F.col("started_ms") / 100).alias("start"), F.floor(F.col("ended_ms") / 100).alias("end"))
    return intervals.blocked_by_others(u, ["room"], 6_000)


@query("S10_gate_groups")
def gate_groups(spark, d):
    """Seeds, their groups, the dominant capture and suspected echoes."""
    return intervals.gate_groups(utterances(spark, d).withColumn("received_ms", F.col("ended_ms")))
