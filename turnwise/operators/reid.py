"""Speakers of a clip with several voices: who speaks where, who that is in the room, and what the turn learns of it.

A diariser gives regions with local labels. What only one label covers is that label's clean audio,
from which its voice is taken. Voices are assigned to the room's speakers clip by clip and label by
label; the label with most clean audio speaks for the clip. Clips without a usable voice fall back
to the whole clip if there is one speaker at most.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import audio
from ..functions.boundary import called
from . import identity, intervals
from .folds import folded
from .lineage import cut
from .turns import dominant_speaker, gathered

#: Samples that a voice needs at least (one second), and milliseconds below which a clip is left out.
LEAST_SAMPLES, LEAST_MS = 16_000, 1000
FIELDS = ["speaker_id", "match", "score", "second_score", "margin", "raw_best_score", "raw_second_score", "raw_margin"]
_LOCAL = "array<struct<label:int,clean_samples:bigint,speaker_id:string,match:string,score:double>>"
DECIDED = ", ".join(f"{c} {'string' if c in ('speaker_id', 'match') else 'double'}" for c in FIELDS) + f", status string, local {_LOCAL}"

Model = Callable[[], Callable[[dict], dict]]


def local_voices(clips: DataFrame, keys: Sequence[str], diarise: Model, embed: Model) -> DataFrame:
    """``keys``, speakers, voices (label, clean_samples, v; by label; v null without enough clean audio), whole (the whole clip's v, for clips to fall back).

    ``clips``: keys (which must tell clips apart) and pcm, 16 bits a sample. Regions that leave the clip are held to it.
    """
    keys = list(keys)
    told = cut(called(clips.select(*keys, "pcm"), "diarise", diarise, ["pcm"], "regions array<struct<start:int,end:int,label:int>>, speakers int"))
    n = F.floor(F.octet_length("pcm") / 2)
    spans = told.select(*keys, n.alias("n"), F.explode("regions").alias("r")).select(*keys, F.col("r.label").alias("label"), F.greatest(F.lit(0), "r.start").cast("long").alias("start"), F.least("r.end", "n").cast("long").alias("end"))
    spans = spans.where("end > start").distinct()
    base = [*keys, "label", "base_start", "base_end"]
    blocks = intervals.blocked_by_others(spans, keys).select(*base, "start", "end")
    whole = spans.select(*keys, "label", F.col("start").alias("base_start"), F.col("end").alias("base_end"))
    # Each region loses what others cover on its own, then a label's pieces are one.
    pieces = intervals.subtracted(whole.withColumns({"b": F.col("base_start"), "e": F.col("base_end")}), blocks.withColumnsRenamed({"base_start": "b", "base_end": "e"}), [*keys, "label", "b", "e"])
    clean = intervals.merged(pieces.select(*keys, "label", "start", "end"), [*keys, "label"])
    size = F.sum(F.col("end") - F.col("start")).alias("clean_samples")
    ranges = clean.groupBy(*keys, "label").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"), size)
    labels = spans.select(*keys, "label").distinct().join(ranges, [*keys, "label"], "left").withColumn("clean_samples", F.coalesce("clean_samples", F.lit(0)))
    # A clip's labels meet its audio once; audio is not shuffled with every region.
    per_clip = labels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("label", "clean_samples", "ranges"))).alias("labels"))
    joined = told.join(per_clip, keys, "left")
    enough = F.exists("labels", lambda x: x["clean_samples"] >= LEAST_SAMPLES)
    falls_back = ~F.coalesce(enough, F.lit(False)) & (F.coalesce("speakers", F.lit(0)) <= 1) & (n >= LEAST_SAMPLES) & F.col("error").isNull()
    joined = cut(joined.withColumn("_falls_back", falls_back))
    each = joined.where(F.size("labels") > 0).select(*keys, "pcm", F.explode("labels").alias("l")).select(*keys, "l.label", "l.clean_samples", audio.collect_samples("pcm", "l.ranges").alias("pcm"))
    each = each.withColumn("_usable", F.col("clean_samples") >= LEAST_SAMPLES)
    voices = called(each, "embed", embed, ["pcm"], "v array<float>", "_usable").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("label", "clean_samples", "v"))).alias("voices"))
    whole_clip = called(joined.select(*keys, "speakers", "_falls_back", F.col("error").alias("failed"), "pcm"), "embed", embed, ["pcm"], "v array<float>", "_falls_back")
    return whole_clip.select(*keys, "speakers", "failed", F.col("v").alias("whole")).join(voices, keys, "left")


def decide(room: identity.Room, voices: list[dict] | None, whole: list[float] | None, speakers: int | None, failed: str | None, threshold: float = 0.60) -> tuple:
    """One clip's decision (FIELDS, status, local decisions); updates the room.

    status: ok; whole-single-speaker (the fallback); ambiguous-overlap (several speakers, none with enough audio of
    their own); insufficient-speaker-audio; diarization-failed. Of equal labels the least speaks for the clip.
    """
    usable = [x for x in voices or [] if x["v"] is not None]
    local, best = [], None
    for x in usable:
        d = identity.assign(room, x["v"], threshold, single_soft=len(usable) <= 1)
        local.append((x["label"], x["clean_samples"], *d[:3]))
        if best is None or x["clean_samples"] > best[0]:
            best = x["clean_samples"], d
    if best:
        return (best[1][0], f"seg-{best[1][1]}", *best[1][2:], "ok", local)
    if failed is None and whole is not None:
        d = identity.assign(room, whole, threshold, single_soft=True)
        return (d[0], f"seg-fallback-{d[1]}", *d[2:], "whole-single-speaker", [])
    status = "diarization-failed" if failed is not None else "ambiguous-overlap" if (speakers or 0) > 1 else "insufficient-speaker-audio"
    return (*[None] * len(FIELDS), status, [])


def reidentified(clips: DataFrame, room: str, order: Sequence[str], diarise: Model, embed: Model, threshold: float = 0.60) -> DataFrame:
    """room, order and DECIDED of each clip of LEAST_MS or more, clips of a room in order.

    ``clips``: room, order (columns that tell a room's clips apart), pcm. A room's decisions depend on
    all before, so a room is streamed through one task; its key should be a room's session. The audio is not: only voices are.
    """
    keys = [room, *order]
    long = clips.where(F.octet_length("pcm") >= LEAST_MS * 32)
    heard = local_voices(long, keys, diarise, embed)

    def one(held: identity.Room, *values) -> list[tuple]:
        *place, voices, whole, speakers, failed = values
        return [(*place, *decide(held, voices, whole, speakers, failed, threshold))]

    kinds = dict(clips.dtypes)
    outputs = ", ".join(f"`{c}` {kinds[c]}" for c in order) + f", {DECIDED}"
    return folded(heard, [room], list(order), [*order, "voices", "whole", "speakers", "failed"], identity.Room, one, outputs)


def with_speakers(turns: DataFrame, decisions: DataFrame, keys: Sequence[str] = ("client_id", "turn_id")) -> DataFrame:
    """``turns`` with speaker_id, speaker_segments, speaker_status, and the last decision's scores; revision counts the decisions.

    ``decisions``: keys, segment_index, seq (order of arrival), speaker_id, scores, audio_ms, started_ms, ended_ms. A later
    decision replaces one of the same segment; the speaker with most audio is the turn's, of equals the one that
    spoke first. Clips without a speaker change nothing, and turns without a decision stay as they are.
    """
    keys = list(keys)
    known = decisions.where("speaker_id is not null and speaker_id <> ''").join(turns.select(*keys).distinct(), keys, "left_semi")
    rounded = [F.round(c, 4).alias(c) for c in FIELDS[2:]]
    held = ["speaker_id", "match", "audio_ms", "started_ms", "ended_ms"]
    newest = known.groupBy(*keys, "segment_index").agg(F.max_by(F.struct(*held, *rounded), "seq").alias("x")).select(*keys, "segment_index", "x.*")
    per_turn = gathered(newest, keys).withColumnRenamed("segments", "speaker_segments")
    last = known.groupBy(*keys).agg(F.count("*").alias("_n"), F.max_by(F.struct(*rounded), "seq").alias("_last"))
    most = dominant_speaker(newest, keys).select(*keys, "speaker_id")
    out = turns.join(per_turn, keys, "left").join(most, keys, "left").join(last, keys, "left")
    scores = [F.col(f"_last.{c}").alias(f"speaker_last_{c}") for c in FIELDS[2:]]
    status = F.when(F.col("speaker_id").isNotNull(), "identified").alias("speaker_status")
    others = [c for c in turns.columns if c != "revision"]
    return out.select(*others, (F.coalesce("revision", F.lit(1)) + F.coalesce("_n", F.lit(0))).alias("revision"), "speaker_id", "speaker_segments", status, *scores)
