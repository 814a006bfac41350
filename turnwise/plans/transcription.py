"""Queries on captures cut by voice activity, translation modes, and files that are written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import audio, boundary
from ..operators import transcription
from ..registry import query
from ..sources import io
from ..streaming import run
from .common import table

_PIECE = 64


def _stub_detector():
    """Stand-in for voice activity: every second stretch of 64 samples is speech, the last one maybe shorter; none in captures whose length five divides."""

    def regions(row: dict) -> dict:
        n = len(row["pcm"]) // 2
        return {"regions": [{"start": at, "end": at + _PIECE} for at in range(0, n, 2 * _PIECE)] if len(row["pcm"]) % 5 else []}

    return regions


def _stub_recogniser():
    """Stand-in for a recogniser: the samples' first two bytes, nothing where the first is a space."""
    return lambda row: {"text": "  " if row["pcm"][:1] == b" " else bytes(row["pcm"][:2]).hex()}


@query("U6_U5_voiced_segments", f"""
    WITH b AS (SELECT item_id, lower(hex(encode(text))) AS h, strlen(text) // 2 AS n, strlen(text) % 5 = 0 AS quiet FROM benchmark WHERE strlen(text) > 1),
    p AS (SELECT item_id, k, k * {_PIECE * 2} / 16000.0 AS start, least(k * {_PIECE * 2} + {_PIECE}, n) / 16000.0 AS "end", h[k * {_PIECE * 8} + 1:k * {_PIECE * 8} + 4] AS text FROM b, unnest(range(0, (n + {_PIECE * 2 - 1}) // {_PIECE * 2})) t(k) WHERE item_id % 3 <> 0 AND NOT quiet),
    s AS (SELECT item_id, string_agg(text, ' ' ORDER BY k) AS text, count(*) AS m, max("end") AS last FROM p WHERE text[1:2] <> '20' GROUP BY item_id)
    SELECT b.item_id, CASE WHEN b.item_id % 3 = 0 THEN CASE WHEN h[1:2] = '20' THEN '  ' ELSE h[1:4] END ELSE coalesce(s.text, '') END AS text, n / 16000.0 AS duration, CAST(coalesce(m, 0) AS INTEGER) AS n_segments, last AS last_end FROM b LEFT JOIN s USING (item_id)""")
def voiced_segments(spark, d):
    """Captures with voice activity on (two thirds), off, and without speech, through detector and recogniser."""
    b = table(spark, d, "benchmark").where("octet_length(text) > 1")
    c = b.select("item_id", F.col("text").cast("binary").alias("pcm"), F.lit("en").alias("language"), (F.col("item_id") % 3 != 0).alias("vad"))
    out = transcription.transcribed(c, ["item_id"], _stub_recogniser, _stub_detector)
    return out.select("item_id", "text", "duration", F.coalesce(F.size("segments"), F.lit(0)).alias("n_segments"), F.element_at("segments", -1)["end"].alias("last_end"))


def _stub_translator():
    """Stand-in for a translator: it tells its beam, after the target language as models may."""
    return lambda row: {"text": f"vi: b{'#' * row['beam']}\t{'x' * 12}"}


@query("U7_H72_translation_modes", "SELECT event_id, 'b' || CASE WHEN event_type IN ('view', 'error') THEN '##' ELSE '#' END || ' xxxxxxxxxxxx' AS translation, 'ok' AS translation_status FROM events")
def translation_modes(spark, d):
    """Final turns by direction and mode; the beam is given to the model, and the target language is taken off."""
    mode = F.when(F.col("event_type") == "view", "QA").when(F.col("event_type") == "error", "retry").when(F.col("event_type") == "click", "beam1")
    t = table(spark, d, "events").select("event_id", F.lit("a plain text to be told").alias("translation_input_text"), F.lit(True).alias("is_final"), mode.alias("translation_mode"))
    return boundary.translated(t, _stub_translator).select("event_id", "translation", "translation_status")


@query("A14_A13_normalised_files", "SELECT item_id, CAST(strlen(text) // 2 * 2 + 44 AS INTEGER) AS n_bytes, upper(sha256(text)) AS digest FROM benchmark WHERE strlen(text) > 1 AND strlen(text) // 2 / 16000.0 <= 0.02 AND strlen(text) // 2 * 2 + 44 <= 600 AND strlen(text) % 2 = 0")
def normalised_files(spark, d):
    """WAV files within limits of length and size, normalised and checked again."""
    pcm = F.col("text").cast("binary")
    files = table(spark, d, "benchmark").where("octet_length(text) > 1 and octet_length(text) % 2 = 0").select("item_id", audio.to_wav(pcm).alias("content"))
    files = files.select("item_id", "content", audio.probe_audio("content").alias("facts"))
    out = io.normalised(files, max_seconds=0.02, max_bytes=600)
    return out.select("item_id", F.octet_length("wav").alias("n_bytes"), F.upper(F.sha2(F.col("pcm"), 256)).alias("digest"))


@query("A27_snippet_lines", "SELECT CAST(item_id AS VARCHAR) AS id, md5(text) AS raw_digest, lower(text) = text AS is_lower, CAST(NULL AS VARCHAR) AS capu FROM benchmark")
def snippet_lines(spark, d):
    """Lines of JSON, written by Spark and read as typed rows; fields that a line lacks are null."""
    folder = run.shared_folder(spark)
    b = table(spark, d, "benchmark")
    b.select(F.to_json(F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("raw"), F.lower("text").alias("clean_lower"))).alias("value")).write.mode("append").text(folder)
    got = io.golden_snippets(spark, folder)
    return got.select("id", F.md5(F.col("raw").cast("binary")).alias("raw_digest"), (F.col("clean_lower") == F.col("raw")).alias("is_lower"), "capu")


@query("A9_written_rejects", "SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'too-short' END AS reason, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE event_type = 'error' OR value < 8 GROUP BY ALL")
def written_rejects(spark, d):
    """Dead letters written by reason and read again, none lost."""
    folder = run.shared_folder(spark) + "/rejects"
    reason = F.when(F.col("event_type") == "error", "error").when(F.col("value") < 8, "too-short")
    rows = table(spark, d, "events").select(reason.alias("reason"), F.col("event_id").cast("string").alias("payload"), F.lit(None).cast("bigint").alias("at_ms"))
    io.write_rejects(rows.where("reason is not null"), folder)
    return spark.read.parquet(folder).groupBy("reason").agg(F.count("*").alias("n"), F.sum(F.col("payload").cast("bigint")).alias("ids"))


@query("A10_spool_orphans", "SELECT event_id AS segment_id, user_id FROM events WHERE event_type = 'error' OR value <= 20")
def spool_orphans(spark, d):
    """A10: files of the spool that no committed segment names."""
    e = table(spark, d, "events")
    return io.orphans(e.select(F.col("event_id").alias("segment_id"), "user_id"), e.where("event_type <> 'error' and value > 20").select(F.col("event_id").alias("segment_id")))
