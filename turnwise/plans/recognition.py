"""Queries on final utterances and speakers of clips (S12, S17, S18), with stand-ins for the models that are labelled as such."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import recognition, reid
from ..registry import query
from .common import table


def _stub_recogniser():
    """Stand-in for a recogniser: audio that is its own text."""
    return lambda row: {"ok": True, "text": bytes(row["pcm"]).decode("utf-8", "replace"), "language": row["language"]}


@query("S12_process_utterance")
def process_utterance(spark, d):
    """Turns as utterances that are decoded with the last words before them, and again alone where that is not to be trusted."""
    before = F.array_join(F.slice(F.split(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), r"\s+"), -12, 12), " ")
    n = F.size(F.split("text", r"\s+"))
    rows = table(spark, d, "conversations").withColumn("before", F.coalesce(F.try_element_at(F.array(before), F.lit(1)), F.lit("")))
    rows = rows.select(
        F.lit("all").alias("room"), F.col("role").alias("client_id"), F.col("conv_id").cast("string").alias("turn_id"), F.col("turn").cast("int").alias("segment_index"),
        F.trim(F.concat_ws(" ", "before", "text")).cast("binary").alias("window"), F.col("text").cast("binary").alias("pcm"), F.lit("en").alias("language_pref"),
        F.when(F.col("before") != "", 12_000).otherwise(0).cast("long").alias("context_prefix_ms"), (n * 1000).cast("long").alias("audio_ms"),
    )
    merged, rejects = recognition.processed(rows, _stub_recogniser)
    names = ["client_id", "turn_id", "segment_index", "decodes"]
    kept = merged.select(*names, F.col("merge_mode").alias("outcome"), F.length("merged_text").alias("n_chars"))
    return kept.unionByName(rejects.select(*names, F.col("reject_reason").alias("outcome"), F.lit(0).alias("n_chars")))


def _stub_diariser():
    """Stand-in for a diariser: two voices that overlap by 2000 samples."""
    return lambda row: {"regions": [{"start": 0, "end": 20_000, "label": 0}, {"start": 18_000, "end": 36_000, "label": 1}], "speakers": 2}


def _stub_embedder():
    """Stand-in for a voice embedding: one direction for each of three sample values."""
    return lambda row: {"v": [float(row["pcm"][0] == c) for c in b"ABC"]}


@query("S17_S18_speakers_of_turns", """
    WITH l AS (SELECT conv_id, turn, 0 AS label, turn % 3 AS voice FROM conversations UNION ALL SELECT conv_id, turn, 1, (conv_id + turn * 2) % 3 FROM conversations),
    f AS (SELECT conv_id, voice, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn * 2 + label)) - 1 AS n FROM l GROUP BY conv_id, voice),
    s AS (SELECT conv_id, turn, 'SPEAKER_' || lpad(CAST(n AS VARCHAR), 2, '0') AS speaker_id FROM l JOIN f USING (conv_id, voice) WHERE label = 0),
    t AS (SELECT conv_id, speaker_id, count(*) AS c, min(turn) AS first FROM s GROUP BY ALL)
    SELECT conv_id, speaker_id, CAST(m AS INTEGER) AS n_segments, CAST(m + 1 AS INTEGER) AS revision FROM (
      SELECT *, sum(c) OVER (PARTITION BY conv_id) AS m, row_number() OVER (PARTITION BY conv_id ORDER BY c DESC, first) AS place FROM t) WHERE place = 1""")
def speakers_of_turns(spark, d):
    """Clips of two voices through diariser and embedding, assigned in order, written to their turns."""
    c = table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") % 3).alias("a"), ((F.col("conv_id") + F.col("turn") * 2) % 3).alias("b"))
    sound = lambda v, n: F.repeat(F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col(v) + 1).cast("int")), n)
    clips = c.select("conv_id", "turn", F.concat(sound("a", 40_000), sound("b", 32_000)).cast("binary").alias("pcm"))
    found = reid.reidentified(clips, "conv_id", ["turn"], _stub_diariser, _stub_embedder)
    decisions = found.select(
        F.lit("c").alias("client_id"), F.col("conv_id").cast("string").alias("turn_id"), F.col("turn").cast("int").alias("segment_index"), F.col("turn").cast("long").alias("seq"),
        *reid.FIELDS, F.lit(2250).cast("long").alias("audio_ms"), (F.col("turn") * 2250).cast("long").alias("started_ms"), ((F.col("turn") + 1) * 2250).cast("long").alias("ended_ms"),
    )
    turns = c.groupBy("conv_id").agg(F.lit(1).alias("revision")).select("conv_id", F.lit("c").alias("client_id"), F.col("conv_id").cast("string").alias("turn_id"), "revision")
    out = reid.with_speakers(turns, decisions)
    return out.select("conv_id", "speaker_id", F.size("speaker_segments").alias("n_segments"), F.col("revision").cast("int").alias("revision"))
