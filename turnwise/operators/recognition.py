"""Final utterances: one decode of the long window, more decodes only where that one is not to be trusted.

An utterance is decoded with the audio before it (its context). If that text repeats itself, the new
audio is decoded alone. If a good text can't be aligned with what its turn has so far, appending the
window would repeat old speech, so the new audio is decoded alone as well. What is rejected keeps its
reason. Quality rules are column functions; the model is called for the rows that a rule picks only.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.boundary import called
from .align import merge_rolling
from .folds import folded
from .lineage import cut
from .turns import KEY

#: Languages that are published, reasons that a second decode may mend, and merges that found no overlap.
LANGUAGES = ("en", "vi")
REPEATS = ("consecutive-word-loop", "repeated-bigram", "repeated-trigram")
UNALIGNED = ("append-unaligned", "append-no-words")

_REPLY = "ok boolean, text string, language string, reason string"
Model = Callable[[dict], dict]


def _decoded(rows: DataFrame, build: Callable[[], Model], audio: str, prefix: str, where: str | None = None) -> DataFrame:
    """``rows`` with the replies to ``audio``, their columns named with ``prefix``."""
    names = [f.split() for f in _REPLY.split(", ")]

    def make() -> Model:
        model = build()

        def run(row: dict) -> dict:
            reply = model({"pcm": row[audio], "language": row["language_pref"]})
            return {f"{prefix}{n}": reply.get(n) for n, _ in names}

        return run

    outputs = ", ".join(f"{prefix}{n} {kind}" for n, kind in names)
    return called(rows, f"final:{audio}", make, [audio, "language_pref"], outputs, where, f"{prefix}error")


def _reason(rows: DataFrame, name: str, text: str, duration: Column, repetition: bool) -> DataFrame:
    """``rows`` with the first reason against ``text``; the words are a plain column of their own while it is found."""
    timed = rows.withColumn("_words", T.words(text)).withColumn("_ms", duration)
    return timed.withColumn(name, T.quality_reason(F.col(text), F.col("_words"), F.col("_ms"), repetition)).drop("_words", "_ms")


def _alone(rows: DataFrame, build: Callable[[], Model], where: str) -> DataFrame:
    """``rows`` with ``solo_text``: what the new audio says on its own, null unless it was asked for and is good."""
    got = _decoded(rows, build, "pcm", "solo_", where)
    got = got.withColumn("solo_text", F.when(F.coalesce(F.col("solo_ok"), F.lit(False)) & F.col("solo_language").isin(*LANGUAGES), T.clean_text("solo_text")).otherwise(""))
    got = _reason(got, "_against", "solo_text", F.col("audio_ms"), False)
    return got.withColumn("solo_text", F.when(F.col("_against").isNull(), F.col("solo_text"))).drop("solo_ok", "solo_language", "solo_reason", "solo_error", "_against")


def judged(utterances: DataFrame, build: Callable[[], Model]) -> DataFrame:
    """``utterances`` with text, language, reject_reason (null: accepted), recovered and decodes.

    ``utterances``: KEY, segment_index, window (audio with its context), pcm (new audio), language_pref,
    context_prefix_ms, audio_ms. ``recovered``: the text is that of the new audio alone.
    """
    first = _decoded(utterances, build, "window", "window_")
    first = first.withColumn("text", T.clean_text("window_text"))
    whole = F.col("context_prefix_ms") + F.col("audio_ms")
    first = _reason(first, "_quality", "text", whole, True)
    failed = F.when(F.col("window_error").isNotNull(), "failed").when(~F.coalesce("window_ok", F.lit(False)), F.coalesce(F.nullif(F.trim("window_reason"), F.lit("")), F.lit("final-empty")))
    failed = failed.when(~F.coalesce(F.col("window_language").isin(*LANGUAGES), F.lit(False)), "unsupported-language")
    repeats = failed.isNull() & F.col("_quality").isin(*REPEATS)
    first = first.withColumn("_failed", failed).withColumn("_again", F.coalesce(repeats & (F.col("context_prefix_ms") > 0), F.lit(False)))
    # Repeats alone delete no speech: without a context the text is judged by the other rules.
    first = _reason(first, "_lenient", "text", whole, False)
    both = _alone(first, build, "_again")
    recovered = F.col("_again") & F.col("solo_text").isNotNull()
    reason = F.when(repeats & (F.col("context_prefix_ms") <= 0), F.col("_lenient")).when(recovered, F.lit(None)).otherwise(F.col("_quality"))
    both = both.withColumn("text", F.when(recovered, F.col("solo_text")).otherwise(F.col("text"))).withColumn("recovered", recovered)
    reason = F.coalesce("_failed", reason, F.when(F.size(T.words("text")) == 0, "empty-transcript"))
    both = both.withColumn("reject_reason", reason).withColumn("decodes", F.when(F.col("_again"), 2).otherwise(1))
    return both.withColumn("language", F.col("window_language")).select(*utterances.columns, "text", "language", "reject_reason", "recovered", "decodes")


class _Merge(NamedTuple):
    text: str
    mode: str
    similarity: float
    said: str
    asks: bool


def _merged(previous: str, text: str, recovered: bool, tried: bool, solo: str | None) -> _Merge:
    """A turn's text after one more utterance; ``asks``: whether the new audio should be decoded alone before this counts."""
    plain, mode, similarity = merge_rolling(previous, text)
    loose = bool(previous) and mode in UNALIGNED
    appended = lambda said: " ".join(f"{previous} {said}".split())
    if recovered:
        return _Merge(appended(text), "recovery-append-segment-only", similarity, text, False) if loose else _Merge(plain, f"recovery-{mode}", similarity, text, False)
    if not loose or tried and solo is None:
        return _Merge(plain, mode, similarity, text, False)
    if not tried:
        return _Merge(plain, mode, similarity, text, True)
    alone, mode, similarity = merge_rolling(previous, solo)
    if mode == "append-unaligned":
        return _Merge(appended(solo), "recovery-append-segment-only", similarity, solo, False)
    return _Merge(alone, f"recovery-{mode}", similarity, solo, False)


def _folded(accepted: DataFrame) -> DataFrame:
    """Each utterance's merge, turn by turn. After one that asks, a turn's text is not settled: the later ones wait."""

    def one(held: list, place: int, text: str, recovered: bool, tried: bool, solo: str | None) -> list[tuple]:
        if held[1]:
            return []
        x = _merged(held[0], text, recovered, tried, solo)
        held[:] = held if x.asks else (x.text, False)
        held[1] = x.asks
        return [(place, x.text, x.mode, x.similarity, x.said, tried, x.asks)]

    kind = dict(accepted.dtypes)["segment_index"]
    outputs = f"segment_index {kind}, merged_text string, merge_mode string, merge_similarity double, window_text string, tried boolean, asks boolean"
    return folded(accepted, KEY, ["segment_index"], ["segment_index", "text", "recovered", "tried", "solo_text"], lambda: ["", False], one, outputs)


def processed(utterances: DataFrame, build: Callable[[], Model]) -> tuple[DataFrame, DataFrame]:
    """(merged, rejects): each accepted utterance with its turn's text so far, and the others with their reason.

    merged: KEY, segment_index, language, window_text (what it adds), merged_text, merge_mode,
    merge_similarity, decodes, is_correction, is_append. rejects: ``utterances`` with reject_reason and decodes.
    Utterances of a turn are in the order of ``segment_index``, which must not repeat. An utterance whose
    text can't be aligned is decoded alone in a round of its own, for all turns together; only it and
    those after it wait for that.
    """
    told = cut(judged(utterances, build))
    names = [*KEY, "segment_index"]
    good = told.where("reject_reason is null")
    waiting = good.select(*names, "text", "recovered")
    audio = good.select(*names, "pcm", "audio_ms", "language_pref")
    solos = None  # what was decoded alone: names, tried, solo_text
    settled: DataFrame | None = None
    while True:
        if solos is None:
            ready = waiting.select("*", F.lit(False).alias("tried"), F.lit(None).cast("string").alias("solo_text"))
        else:
            ready = waiting.join(solos, names, "left").withColumn("tried", F.coalesce("tried", F.lit(False)))
        merges = cut(_folded(ready))
        asked = merges.where("asks").select(*names)
        open_turns = asked.select(*KEY).distinct()
        done = merges.join(open_turns, list(KEY), "left_anti")
        settled = done if settled is None else settled.unionByName(done)
        if asked.isEmpty():
            break
        alone = _alone(audio.join(asked, names, "left_semi").withColumn("_asked", F.lit(True)), build, "_asked").select(*names, F.lit(True).alias("tried"), "solo_text")
        solos = cut(alone if solos is None else solos.unionByName(alone))
        waiting = waiting.join(open_turns, list(KEY), "left_semi")
    out = settled.join(good.select(*names, "language", "decodes"), names)
    out = out.withColumn("decodes", F.col("decodes") + F.col("tried").cast("int"))
    before = F.coalesce(F.lag("merged_text").over(Window.partitionBy(*KEY).orderBy("segment_index")), F.lit(""))
    out = out.withColumn("is_correction", (before != "") & F.col("merge_mode").contains("tail-rewrite") & (F.col("merged_text") != before))
    out = out.withColumn("is_append", ~F.col("is_correction") & (F.col("merge_mode").contains("append") | (F.col("merge_mode") == "initial")))
    merged = out.select(*names, "language", "window_text", "merged_text", "merge_mode", "merge_similarity", "decodes", "is_correction", "is_append")
    return merged, told.where("reject_reason is not null").select(*utterances.columns, "reject_reason", "decodes")
