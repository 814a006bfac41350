"""Intervals: overlap joins, unions, differences, and grouping of captures of the same speech."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sessions import stretches

START_DELTA_MS, END_DELTA_MS, OVERLAP, RMS_RATIO, PEAK_RATIO = 650, 900, 0.70, 1.60, 1.25
LEAST_PIECE = 5600


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def overlap_ratio(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over the shorter duration, which counts as 1 at least."""
    return overlap(s1, e1, s2, e2) / F.least(F.greatest(F.lit(1), e1 - s1), F.greatest(F.lit(1), e2 - s2))


def pair_columns() -> list[Column]:
    """What a pair of captures, joined as ``a`` and ``b``, comes out with."""
    ratio = overlap_ratio(F.col("a.started_ms"), F.col("a.ended_ms"), F.col("b.started_ms"), F.col("b.ended_ms"))
    names = {"room": "a.room", "left_id": "a.utterance_id", "right_id": "b.utterance_id", "left_rms": "a.avg_rms", "right_rms": "b.avg_rms", "left_peak": "a.peak_rms", "right_peak": "b.peak_rms"}
    return [*(F.col(c).alias(name) for name, c in names.items()), ratio.alias("overlap_ratio")]


def same_window(utterances: DataFrame, start_delta: int = START_DELTA_MS, end_delta: int = END_DELTA_MS, least: float = OVERLAP) -> DataFrame:
    """Pairs of captures of the same speech: same room, other client, starts and ends near, overlap large.

    ``utterances``: room, client_id, utterance_id, started_ms, ended_ms, avg_rms, peak_rms. As the
    starts of a pair are near, the join is on the room and a time slot as wide as they may differ,
    where the left side looks at its own and both neighbour slots: a busy room isn't one key.
    """
    slot = F.floor(F.col("started_ms") / start_delta)
    near = utterances.withColumn("slot", F.explode(F.array(slot - 1, slot, slot + 1)))
    a, b = near.alias("a"), utterances.withColumn("slot", slot).alias("b")
    s1, e1, s2, e2 = F.col("a.started_ms"), F.col("a.ended_ms"), F.col("b.started_ms"), F.col("b.ended_ms")
    fits = (
        (F.col("a.room") == F.col("b.room")) & (F.col("a.slot") == F.col("b.slot")) & (F.col("a.client_id") != F.col("b.client_id"))
        & (F.abs(s1 - s2) <= start_delta) & (F.abs(e1 - e2) <= end_delta) & (overlap_ratio(s1, e1, s2, e2) >= least)
    )
    return a.join(b, fits).select(*pair_columns())


def echoes(pairs: DataFrame) -> DataFrame:
    """Of ``same_window``'s pairs those whose left side is so much louder that the right one is likely its echo."""
    louder = (F.col("left_rms") > 0) & (F.col("right_rms") > 0)
    return pairs.where(louder & (F.col("left_rms") / F.col("right_rms") >= RMS_RATIO) & (F.col("left_peak") / F.greatest("right_peak", F.lit(1e-9)) >= PEAK_RATIO))


def merged(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unions of half-open ranges (``start``, ``end``) within each key; touching ranges merge, empty ones go."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.where("end > start").withColumn("fresh", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    island = marked.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def subtracted(base: DataFrame, blocked: DataFrame, keys: Sequence[str], least: int = LEAST_PIECE) -> DataFrame:
    """What of each base range (keys, base_start, base_end) no blocked range covers, in pieces of ``least`` or more.

    The gaps between merged blocks and the ends of the base are the pieces.
    """
    inside = merged(blocked, keys).join(base, list(keys)).where("end > base_start and start < base_end")
    inside = inside.select(*keys, "base_start", "base_end", F.greatest("start", "base_start").alias("start"), F.least("end", "base_end").alias("end"))
    order = Window.partitionBy(*keys, "base_start", "base_end").orderBy("start")
    before = inside.select(*keys, F.coalesce(F.lag("end").over(order), "base_start").alias("start"), F.col("start").alias("end"))
    after = inside.groupBy(*keys, "base_start", "base_end").agg(F.max("end").alias("start")).select(*keys, "start", F.col("base_end").alias("end"))
    whole = base.join(inside, [*keys, "base_start", "base_end"], "left_anti").select(*keys, F.col("base_start").alias("start"), F.col("base_end").alias("end"))
    return before.unionByName(after).unionByName(whole).where(F.col("end") - F.col("start") >= F.greatest(F.lit(1), F.lit(least)))


def blocked_by_others(segments: DataFrame, keys: Sequence[str], slot: int = 60_000) -> DataFrame:
    """Overlaps of segments (keys, label, start, end) with those of other labels: keys, label, base and blocked range.

    Segments are dealt once to the time slots that they touch, and meet the different ranges of a slot, where their overlap begins; so a
    busy key isn't one task, nor are all its pairs made. A range comes once with the least and the largest of its labels, whoever else has it.
    An overlap is found once, so that neither pairs nor results are compared: of the ranges that end alike and begin before a segment the
    first does, of those that begin alike and end after it the last, and whether any covers it whole is asked apart.
    ``slot`` should be about as long as a segment.
    """
    first, last = F.floor(F.col("start") / slot), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / slot)
    by, columns = [*keys, "slot"], [*keys, "label", "start", "end"]
    whole_rows = segments.select(*columns).where(" and ".join(f"`{c}` is not null" for c in columns))
    bases = whole_rows.select("*", F.explode(F.sequence(first, last)).alias("slot")).where("slot is not null").repartition(*by).distinct()
    ranges = bases.groupBy(*by, "start", "end").agg(F.min("label").alias("least"), F.max("label").alias("most"))

    def once(alike: str, order: Column, name: str) -> Column:
        """For the first of the ranges alike: true; for the first one with another label than the only one of that: this label."""
        window = Window.partitionBy(*by, alike).orderBy(order)
        only, of = F.first("least").over(window), F.first("most").over(window)
        other = (F.col("least") != only) | (F.col("most") != only)
        nth = F.count_if(other).over(window)
        return F.struct((F.row_number().over(window) == 1).alias("first"), F.when((only == of) & other & (nth == 1), only).alias("instead_of")).alias(name)

    ranges = ranges.select("*", once("end", F.col("start"), "ends")).select("*", once("start", F.col("end").desc(), "starts"))
    a, b = bases.alias("a"), ranges.alias("b")
    cond = F.col("a.slot") == F.col("b.slot")
    for k in keys:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    cond = cond & ((F.col("a.label") != F.col("b.least")) | (F.col("a.label") != F.col("b.most"))) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    cond = cond & (F.col("a.slot") == F.floor(F.greatest("a.start", "b.start") / slot))
    later, sooner = F.col("b.start") > F.col("a.start"), F.col("b.end") < F.col("a.end")
    told = lambda name: F.col(f"b.{name}.first") | (F.col(f"b.{name}.instead_of") == F.col("a.label"))
    part = (later & sooner) | (~later & sooner & told("ends")) | (later & ~sooner & told("starts"))
    base = [*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.label").alias("label"), F.col("a.start").alias("base_start"), F.col("a.end").alias("base_end")]
    met = a.join(b.hint("merge"), cond & part).select(*base, F.greatest("a.start", "b.start").alias("start"), F.least("a.end", "b.end").alias("end"))
    whole = a.join(b.hint("merge"), cond & ~later & ~sooner, "left_semi").select(*base, F.col("a.start").alias("start"), F.col("a.end").alias("end"))
    return met.unionByName(whole)


def uncontested(own: DataFrame, keys: Sequence[str], least: int = LEAST_PIECE, slot: int = 60_000) -> DataFrame:
    """What of each label's ranges no other label of the same keys covers, in pieces of ``least`` or more: keys, label, start, end.

    ``own``: keys, label (a whole number), start, end, a label's ranges disjoint and not touching (``merged``). No pairs are made: between two
    neighbouring ends of ranges so many labels are there as have begun but not ended, and where that is one, the sum of labels is that label.
    Ranges are cut at time slots, so a busy key isn't one task; pieces that meet at a slot's end are one again.
    """
    first, last = F.floor(F.col("start") / slot), F.floor((F.col("end") - 1) / slot)
    parts = own.where("end > start").select(*keys, "label", "start", "end", F.explode(F.sequence(first, last)).alias("slot"))
    start, end = F.greatest("start", F.col("slot") * slot), F.least("end", (F.col("slot") + 1) * slot)
    edge = lambda at, n: F.struct(at.alias("at"), F.lit(n).alias("n"), (F.col("label").cast("decimal(20,0)") * n).alias("of"))
    edges = parts.select(*keys, "slot", F.explode(F.array(edge(start, 1), edge(end, -1))).alias("e")).groupBy(*keys, "slot", "e.at").agg(F.sum("e.n").alias("n"), F.sum("e.of").alias("of"))
    order = Window.partitionBy(*keys, "slot").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    swept = edges.select(*keys, F.col("at").alias("start"), F.lead("at").over(order).alias("end"), F.sum("n").over(so_far).alias("n"), F.sum("of").over(so_far).alias("label"))
    kind = dict(own.dtypes)["label"]
    alone = swept.where("n = 1").select(*keys, F.col("label").cast(kind).alias("label"), "start", "end")
    return merged(alone, [*keys, "label"]).where(F.col("end") - F.col("start") >= F.greatest(F.lit(1), F.lit(least)))


def gate_groups(utterances: DataFrame) -> DataFrame:
    """Groups of captures of the same speech: room, group_no, utterance_id, is_dominant, echo_suspected.

    Seeds are taken in order (received_ms, utterance_id), which numbers the groups of a room too; a
    group is a seed and what is in the same window as the seed, not transitively. Captures whose starts
    are further apart than a window never meet, so a room is folded stretch by stretch, cut where no
    capture starts for that long, and not as a whole.
    """
    cut = stretches(utterances, ["room"], F.col("started_ms"), ["started_ms", "utterance_id"], START_DELTA_MS, "stretch")
    columns = ["client_id", "utterance_id", "received_ms", "started_ms", "ended_ms", "avg_rms", "peak_rms"]

    def fits(a: dict, b: dict) -> bool:
        shorter = min(max(1, a["ended_ms"] - a["started_ms"]), max(1, b["ended_ms"] - b["started_ms"]))
        shared = max(0, min(a["ended_ms"], b["ended_ms"]) - max(a["started_ms"], b["started_ms"]))
        return (
            a["client_id"] != b["client_id"] and abs(a["started_ms"] - b["started_ms"]) <= START_DELTA_MS
            and abs(a["ended_ms"] - b["ended_ms"]) <= END_DELTA_MS and shared / shorter >= OVERLAP
        )

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        items = group.sort_values(["received_ms", "utterance_id"]).to_dict("records")
        by_start = sorted(range(len(items)), key=lambda i: items[i]["started_ms"])
        starts = [items[i]["started_ms"] for i in by_start]
        room, out, taken = group["room"].iloc[0], [], set()
        for i, seed in enumerate(items):
            if i in taken:
                continue
            # Only captures that start near the seed can be in its group.
            near = by_start[bisect_left(starts, seed["started_ms"] - START_DELTA_MS) : bisect_right(starts, seed["started_ms"] + START_DELTA_MS)]
            own = [i, *sorted(j for j in near if j != i and j not in taken and fits(seed, items[j]))]
            taken.update(own)
            members = [items[j] for j in own]
            loud = max(members, key=lambda x: (x["avg_rms"], x["peak_rms"]))
            for x in members:
                echo = (
                    x is not loud and fits(loud, x) and loud["avg_rms"] > 0 and x["avg_rms"] > 0
                    and loud["avg_rms"] / max(x["avg_rms"], 1e-9) >= RMS_RATIO and loud["peak_rms"] / max(x["peak_rms"], 1e-9) >= PEAK_RATIO
                )
                out.append((room, seed["received_ms"], seed["utterance_id"], x["utterance_id"], x is loud, bool(echo)))
        return pd.DataFrame(out, columns=["room", "seed_ms", "seed_id", "utterance_id", "is_dominant", "echo_suspected"])

    kinds = dict(utterances.dtypes)
    schema = f"room {kinds['room']}, seed_ms {kinds['received_ms']}, seed_id {kinds['utterance_id']}, utterance_id {kinds['utterance_id']}, is_dominant boolean, echo_suspected boolean"
    found = cut.select("room", "stretch", *columns).groupBy("room", "stretch").applyInPandas(fold, schema)
    number = F.dense_rank().over(Window.partitionBy("room").orderBy("seed_ms", "seed_id")) - 1
    return found.select("room", number.cast("int").alias("group_no"), "utterance_id", "is_dominant", "echo_suspected")
