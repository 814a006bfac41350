"""Control messages of clients as sessions, files picked for models, and how two texts differ."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import matching, wire


def sessions(messages: DataFrame, client: str, order: Sequence[str], message: str = "message", refusal: str | None = None, auto: bool = False) -> DataFrame:
    """``messages`` with the fields of ``wire.control``, before, state, reply, mic, current_room, current_language, current_name and told (rooms).

    A client is ``off``, in a ``capture`` or in ``speech`` that it holds a key for, by its messages in order. Starts are taken when
    off; ``capture_stop`` ends both, ``speech_end`` a speech only. So, of the messages between two ends, the first start
    decides, and once that is a capture it lasts until a stop: both are running windows, and no state is folded.
    ``refusal`` names a column that is not null where the server takes no start (storage, recogniser).
    ``reply`` is the answer's type or the error's code. Broken messages change nothing. ``order`` (a time in ms first) must tell a client's messages apart.
    """
    over = Window.partitionBy(client).orderBy(*order)
    running = lambda *keys: Window.partitionBy(client, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    refused = F.col(refusal) if refusal else F.lit(None).cast("string")
    fallback = F.concat_ws("-", F.lit("u"), *[F.col(c).cast("string") for c in (client, *order)])
    rows = messages.withColumn("_m", wire.control(message, fallback, F.col(order[0]), auto))
    verb = F.col("_m.verb")
    stop, end = verb == "capture_stop", verb == "speech_end"
    start = verb.isin("capture_start", "speech_start") & refused.isNull()
    rows = rows.withColumn("_stretch", F.count_if(F.coalesce(stop, F.lit(False))).over(running())).withColumn("_part", F.count_if(F.coalesce(stop | end, F.lit(False))).over(running()))
    rows = rows.withColumn("_opener", F.first(F.when(start, verb), ignorenulls=True).over(running("_stretch", "_part")))
    captured = F.max(F.coalesce(F.col("_opener") == "capture_start", F.lit(False))).over(running("_stretch"))
    rows = rows.withColumn("state", F.when(captured, "capture").when(F.col("_opener") == "speech_start", "speech").otherwise("off"))
    rows = rows.withColumn("before", F.coalesce(F.lag("state").over(over), F.lit("off")))
    off = F.col("before") == "off"
    joined, again = (verb == "join") & off, (verb == "capture_start") & (F.col("before") == "capture")
    taken = start & off
    reply = (
        F.when(verb == "join", F.when(off, "joined").otherwise("join-during-capture"))
        .when(again, "already-active")
        .when(verb == "capture_start", F.when(off, F.coalesce(refused, F.lit("capture_ready"))).otherwise("capture-mode-conflict"))
        .when(verb == "speech_start", F.when(off, refused).otherwise("speech-already-active"))
        .when(verb == "ping", "pong")
    )
    ended = end & (F.col("before") == "speech")
    mic = F.when(joined | stop, "off").when(taken, F.when(verb == "capture_start", "listening").otherwise("speaking")).when(ended, "listening")
    speaks = joined | taken | again | (verb == "language_pref")
    held = lambda value, default: F.coalesce(F.last(value, ignorenulls=True).over(running()), F.lit(default))
    rows = rows.withColumns({
        "reply": reply, "mic": held(mic, "off"), "current_room": held(F.when(joined, F.col("_m.room")), "default"),
        "current_name": held(F.when(joined, F.col("_m.name")), "Guest"), "current_language": held(F.when(speaks, F.col("_m.language")), "vi"),
    })
    old = F.coalesce(F.lag("current_room").over(over), F.lit("default"))
    changes = joined | (verb == "language_pref") | stop | taken | ended
    told = F.when(changes, F.array_distinct(F.array("current_room", old))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("told", told)
    fields = [F.col(f"_m.{c}").alias(c) for c in ("verb", "name", "room", "language", "utterance_id", "started_ms", "client_ts")]
    names = ["before", "state", "reply", "mic", "current_room", "current_language", "current_name", "told"]
    return rows.select(*messages.columns, *[c for c in fields], *names)


def picked(files: DataFrame, folder: str, name: str, exact: Sequence[str], patterns: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """folder, picked: the first of the ``exact`` names that a folder has, else the least name with one of the (prefix, suffix) ``patterns``; null if none."""
    n = F.col(name)
    fits = F.lit(False)
    for prefix, suffix in patterns:
        fits = fits | (n.startswith(prefix) & n.endswith(suffix))
    place = F.when(fits, len(exact))
    for i in reversed(range(len(exact))):
        place = F.when(n == exact[i], i).otherwise(place)
    best = F.min(F.when(place.isNotNull(), F.struct(place.alias("place"), n.alias("name"))))
    return files.groupBy(folder).agg(best["name"].alias("picked"))


DIFFERENCE = "tag string, left_span array<int>, right_span array<int>, left_context string, right_context string, similarity double, normalized_equal boolean"


def difference(a: Column, b: Column, context: int = 90) -> Column:
    """A struct DIFFERENCE: the first edit from ``a`` to ``b`` with its spans and ``context`` characters on both sides, how alike they are, and whether their plain words are equal.

    Edits lie between matching blocks (``delete``, ``insert``, ``replace``); equal texts have none. Null counts as empty.
    """

    @F.pandas_udf("tag string, left_from int, left_to int, right_from int, right_to int, similarity double")
    def first(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_first_edit(x or "", y or "") for x, y in zip(left, right, strict=True)], columns=["tag", "left_from", "left_to", "right_from", "right_to", "similarity"]).astype({c: "Int32" for c in ("left_from", "left_to", "right_from", "right_to")})

    e = first(a, b)

    def around(text: Column, begin: Column, to: Column) -> Column:
        low = F.greatest(begin - context, F.lit(0))
        return F.substring(F.coalesce(text, F.lit("")), low + 1, to + context - low)

    plain = lambda t: F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    span = lambda side: F.when(e["tag"].isNotNull(), F.array(e[f"{side}_from"], e[f"{side}_to"]))
    return F.struct(
        e["tag"].alias("tag"), span("left").alias("left_span"), span("right").alias("right_span"), around(a, e["left_from"], e["left_to"]).alias("left_context"),
        around(b, e["right_from"], e["right_to"]).alias("right_context"), e["similarity"].alias("similarity"), (plain(a) == plain(b)).alias("normalized_equal"),
    )


def _first_edit(a: str, b: str) -> tuple:
    """Tag and spans of the first edit (None if the texts are equal), and the ratio of what matches."""
    if a == b:
        return None, None, None, None, None, 1.0
    found = matching.blocks(a, b)
    alike = 2.0 * sum(x.size for x in found) / (len(a) + len(b))
    ends = [(x.a, x.b, x.a + x.size, x.b + x.size) for x in found] + [(len(a), len(b), len(a), len(b))]
    i = j = 0
    for to_a, to_b, after_a, after_b in ends:
        if (i, j) != (to_a, to_b):
            tag = "insert" if i == to_a else "delete" if j == to_b else "replace"
            return tag, i, to_a, j, to_b, alike
        i, j = after_a, after_b
    raise AssertionError("texts that differ have an edit")
