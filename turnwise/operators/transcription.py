"""Captures as texts: whole, or cut by voice activity into segments that are decoded one by one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import audio
from ..functions.boundary import called
from .lineage import cut

Model = Callable[[], Callable[[dict], dict]]


def transcribed(captures: DataFrame, keys: Sequence[str], recognise: Model, detect: Model) -> DataFrame:
    """keys, language, text, duration, segments (array of start, end in seconds, text; null if there are none), error.

    ``captures``: keys (which tell them apart), pcm, language, vad. Where ``vad`` isn't true, a capture is decoded at one go and has
    no segments. Else ``detect`` gives its regions (start, end in samples): each is decoded by itself, so that a long capture is
    many rows, blank texts are dropped, the others joined; without regions the text is empty and nothing is decoded. Regions are
    held to the capture, and empty ones left out. The first failure of a capture is its error; it then has no text.
    """
    keys = list(keys)
    n = F.floor(F.octet_length("pcm") / 2)
    told = called(captures.select(*keys, "pcm", "language", F.coalesce("vad", F.lit(False)).alias("vad")), "detect", detect, ["pcm"], "regions array<struct<start:int,end:int>>", "vad", "detect_error")
    held = F.transform("regions", lambda r: F.struct(F.greatest(r["start"], F.lit(0)).cast("long").alias("start"), F.least(r["end"].cast("long"), n).alias("end")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), n.alias("end")))
    parts = F.when(F.col("vad"), F.filter(F.coalesce(held, F.array().cast("array<struct<start:bigint,end:bigint>>")), lambda r: r["end"] > r["start"])).otherwise(whole)
    # The detector is asked once; segments and captures are both read from what it said.
    cuts = cut(told.select(*keys, "language", "vad", "detect_error", n.alias("n"), "pcm", parts.alias("parts")))
    each = cuts.where("detect_error is null").select(*keys, "language", "vad", "pcm", F.explode("parts").alias("r"))
    piece = F.substring("pcm", (F.col("r.start") * 2 + 1).cast("int"), ((F.col("r.end") - F.col("r.start")) * 2).cast("int"))
    heard = called(each.select(*keys, "language", "vad", "r", piece.alias("pcm")), "asr", recognise, ["pcm", "language"], "text string")
    seconds = lambda c: F.col(c) / float(audio.RATE)
    one = F.struct(F.col("r.start").alias("at"), seconds("r.start").alias("start"), seconds("r.end").alias("end"), F.coalesce("text", F.lit("")).alias("text"))
    said = F.when(F.col("error").isNull() & (~F.col("vad") | F.col("text").rlike(r"(?U)\S")), one)
    texts = heard.groupBy(*keys).agg(F.array_sort(F.collect_list(said)).alias("said"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("r.start"))).alias("error"))
    out = cuts.drop("pcm", "parts")
    same = [out[k].eqNullSafe(texts[k]) for k in keys]
    both = out.join(texts, same, "left").select(*[out[k] for k in keys], "language", "vad", "n", F.coalesce("detect_error", "error").alias("error"), F.coalesce("said", F.array().cast("array<struct<at:bigint,start:double,end:double,text:string>>")).alias("said"))
    clear = F.col("error").isNull()
    segments = F.transform("said", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))
    return both.select(
        *keys, "language", F.when(clear, F.array_join(F.transform("said", lambda s: s["text"]), " ")).alias("text"), (F.col("n") / float(audio.RATE)).alias("duration"),
        F.when(clear & F.col("vad") & (F.size("said") > 0), segments).alias("segments"), "error",
    )
