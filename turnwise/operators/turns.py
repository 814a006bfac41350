"""Turn rows: roll-up of segments, dominant speaker, upserts, stale results, finalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .align import merge_rolling
from .folds import folded

KEY = ("room", "client_id", "turn_id")


def rolled_up(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a turn of its segments: audio, count, first start, last end, revision."""
    return segments.groupBy(*keys).agg(
        F.sum("audio_ms").alias("audio_ms"),
        F.count("*").alias("segment_count"),
        F.min("started_ms").alias("started_ms"),
        F.max("ended_ms").alias("ended_ms"),
        F.count("*").alias("revision"),
        F.max_by("segment_index", "segment_index").alias("last_segment_index"),
    )


def dominant_speaker(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The speaker with most audio of each turn (a segment counts 1 ms at least); of equals the one that spoke first."""
    sums = segments.groupBy(*keys, "speaker_id").agg(F.sum(F.greatest(F.lit(1), F.col("audio_ms"))).alias("spoken_ms"), F.min("segment_index").alias("first_index"))
    order = Window.partitionBy(*keys).orderBy(F.desc("spoken_ms"), "first_index", "speaker_id")
    return sums.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def with_segment(segments: Column, new: Column) -> Column:
    """An array of segments with ``new`` in place of the one of its index, sorted by index."""
    others = F.filter(segments, lambda s: s["segment_index"] != new["segment_index"])
    return F.array_sort(F.concat(others, F.array(new)), lambda a, b: F.when(a["segment_index"] < b["segment_index"], -1).when(a["segment_index"] > b["segment_index"], 1).otherwise(0))


def not_stale(results: DataFrame, turns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Results whose source revision and text are still those of the turn."""
    now = turns.select(*keys, F.col("source_revision").alias("_revision"), F.col("translation_input_text").alias("_text"))
    fits = (F.col("source_revision") == F.col("_revision")) & F.col("translation_source_text").eqNullSafe(F.col("_text"))
    return results.join(now, list(keys)).where(fits).drop("_revision", "_text")


def looked_up(segments: DataFrame, turns: DataFrame, keys: Sequence[str] = ("client_id", "turn_id")) -> DataFrame:
    """``segments`` with the columns of their turn, and is_new: whether there is none yet."""
    known = turns.withColumn("_known", F.lit(True))
    return segments.join(known, list(keys), "left").withColumn("is_new", F.col("_known").isNull()).drop("_known")


def gathered(segments: DataFrame, keys: Sequence[str], order: str = "segment_index") -> DataFrame:
    """Each turn with the array of its segments (all other columns), by ``order``. The capture limits bound a turn."""
    others = [c for c in segments.columns if c not in keys and c != order]
    return segments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *others))).alias("segments"))


def to_prune(state: DataFrame, *kept: DataFrame, keys: Sequence[str] = ("client_id", "turn_id")) -> DataFrame:
    """State rows whose key is in none of the tables to keep."""
    union = kept[0].select(*keys)
    for k in kept[1:]:
        union = union.unionByName(k.select(*keys))
    return state.join(union.distinct(), list(keys), "left_anti")


UPSERTED = "room string, client_id string, turn_id string, segment_index int, revision int, source_revision int, segment_count int, audio_ms long, started_ms long, ended_ms long, canonical_text string, merge_mode string, merge_similarity double, verification_status string, is_final boolean, translation_stale boolean"


def upsert(row: dict | None, hypothesis: dict) -> dict:
    """A turn row after one more recognised segment. Batch and streaming share this step.

    The text is merged by the rolling rule; the revision counts changes, the source revision those
    of the text; a translation of an older text is stale.
    """
    before = row or {}
    text, mode, similarity = merge_rolling(before.get("canonical_text"), hypothesis["text"])
    changed = text != before.get("canonical_text")
    return {
        "room": hypothesis["room"],
        "client_id": hypothesis["client_id"],
        "turn_id": hypothesis["turn_id"],
        "segment_index": hypothesis["segment_index"],
        "revision": before.get("revision", 0) + 1,
        "source_revision": before.get("source_revision", 0) + changed,
        "segment_count": max(before.get("segment_count", 0), hypothesis["segment_index"] + 1),
        "audio_ms": before.get("audio_ms", 0) + hypothesis["audio_ms"],
        "started_ms": min(before.get("started_ms", hypothesis["started_ms"]), hypothesis["started_ms"]),
        "ended_ms": max(before.get("ended_ms", 0), hypothesis["ended_ms"]),
        "canonical_text": text,
        "merge_mode": mode,
        "merge_similarity": similarity,
        "verification_status": "corrected" if row and mode == "tail-rewrite" and changed else "rolling-final",
        "is_final": False,
        "translation_stale": bool(row) and changed,
    }


def turn_log(hypotheses: DataFrame) -> DataFrame:
    """Every revision of every turn, from recognised segments (KEY, segment_index, started_ms, ended_ms, audio_ms, text)."""
    columns = ["segment_index", "started_ms", "ended_ms", "audio_ms", "text"]
    names = [*KEY, *(f.split()[0] for f in UPSERTED.split(", ")[len(KEY) :])]

    def one(held: dict, *values) -> list[tuple]:
        held["row"] = upsert(held.get("row"), dict(zip(columns, values, strict=True)) | dict.fromkeys(KEY))
        return [tuple(held["row"][c] for c in names[len(KEY) :])]

    return folded(hypotheses, KEY, ["segment_index"], columns, dict, one, UPSERTED.split(", ", len(KEY))[-1])


def finalised(turns: DataFrame, now_ms: Column, gap_ms: int = 1500) -> DataFrame:
    """Turns whose gap has passed and that wait for no segment become final; others stay as they are."""
    done = (F.coalesce("pending_segments", F.lit(0)) == 0) & (now_ms - F.col("ended_ms") >= gap_ms)
    return turns.withColumn("is_final", F.coalesce("is_final", F.lit(False)) | done)


def assembled(segments: DataFrame, keys: Sequence[str], text: str, order: str) -> DataFrame:
    """Non-empty texts of a turn joined by a space in order, no space before punctuation."""
    clean = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    ordered = F.array_sort(F.collect_list(F.when(clean != "", F.struct(order, clean.alias("t")))))
    return segments.groupBy(*keys).agg(F.regexp_replace(F.array_join(F.transform(ordered, lambda x: x["t"]), " "), r"\s+([,.;:!?%])", "$1").alias("turn_text"))
