"""The life of a capture: joining and leaving, previews beside final work, the client's buffer, the drain at shutdown."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sessions import stretches

#: A client's transport holds two seconds of audio (fixed value).
BUFFER_BYTES, BYTES_PER_SECOND = 64_000, 32_000
#: A preview is asked for at most so often, and how long a preview and final work hold the recogniser.
INTERVAL_MS, PREVIEW_MS, FINAL_MS = 1200, 600, 900


def captures(events: DataFrame, key: str, leaves: Column, timeout_ms: int, now_ms: Column | None = None) -> DataFrame:
    """One row a capture: key, capture_no, joined_ms, left_ms, n_events, end_reason.

    ``events``: key, ts_ms, seq. A capture begins with the first event, with the first one after the
    client has left (``leaves``), and after a silence of more than ``timeout_ms``; so an end that was
    never announced ends it too. end_reason: ``disconnect``, ``timeout``, or ``open`` for a
    client that is still there at ``now_ms`` (by default the latest event of all).
    """
    latest = events.agg(F.max("ts_ms")).scalar() if now_ms is None else now_ms
    return numbered_captures(events, key, leaves, timeout_ms).groupBy(key, "capture_no").agg(
        F.min("ts_ms").alias("joined_ms"), F.max("ts_ms").alias("left_ms"), F.count("*").alias("n_events"), F.bool_or("_leaves").alias("_left")
    ).withColumn("_now", latest).select(
        key, "capture_no", "joined_ms", "left_ms", "n_events",
        F.when(F.col("_left"), "disconnect").when(F.col("_now") - F.col("left_ms") > timeout_ms, "timeout")
        .when(F.lead("capture_no").over(Window.partitionBy(key).orderBy("capture_no")).isNotNull(), "timeout").otherwise("open").alias("end_reason"),
    )


def numbered_captures(events: DataFrame, key: str, leaves: Column, timeout_ms: int) -> DataFrame:
    """``events`` with capture_no (from 1) and _leaves: the key to hand to the folds, which flush at a capture's end."""
    order = Window.partitionBy(key).orderBy("ts_ms", "seq")
    marked = events.withColumn("_leaves", F.coalesce(leaves, F.lit(False)))
    after = F.coalesce(F.lag("_leaves").over(order), F.lit(True)) | (F.col("ts_ms") - F.lag("ts_ms").over(order) > timeout_ms)
    fresh = F.sum(F.when(after, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("capture_no", fresh.cast("bigint"))


def present(found: DataFrame, key: str) -> DataFrame:
    """Clients that are still there: those of an open capture."""
    return found.where("end_reason = 'open'").select(key).distinct()


def buffered(packets: DataFrame, key: str, order: Sequence[str], at_us: Column, rate: float = BYTES_PER_SECOND, bound: int = BUFFER_BYTES) -> DataFrame:
    """``packets`` (with size) and what the client's buffer holds with each: buffered_bytes, stopped, refused.

    The buffer drains at ``rate`` bytes a second. The packet that would take it over ``bound`` stops the
    capture; it and all after it are refused and counted, never dropped silently. The level is the
    running sum less its running minimum, so two windows give it without a fold.
    """
    w = Window.partitionBy(key).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    drained = F.coalesce((F.col("_at") - F.lag("_at").over(w)) / 1e6 * rate, F.lit(0.0))
    rows = packets.withColumn("_at", at_us).withColumn("_move", F.coalesce(F.lag("size").over(w), F.lit(0)) - drained)
    rows = rows.withColumn("_sum", F.sum("_move").over(upto)).withColumn("_least", F.least(F.lit(0.0), F.min("_sum").over(upto)))
    rows = rows.withColumn("buffered_bytes", F.col("_sum") - F.col("_least") + F.col("size"))
    over = F.max(F.col("buffered_bytes") > bound).over(upto)
    rows = rows.withColumns({"refused": over, "stopped": over & ~F.coalesce(F.max(F.col("buffered_bytes") > bound).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))})
    return rows.drop("_at", "_move", "_sum", "_least")


def drained(queue: DataFrame, done: DataFrame, pending: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a shutdown must keep: keys and reason of every queued or pending item that isn't done.

    ``service-stop-queued`` for items that waited in the queue, ``service-stop-pending`` for those
    that the gate still held. With ``done`` they account for every item.
    """
    one = lambda df, reason: df.select(*keys).distinct().withColumn("reason", F.lit(reason))
    both = one(queue, "service-stop-queued").unionByName(one(pending, "service-stop-pending"))
    first = both.groupBy(*keys).agg(F.max("reason").alias("reason"))  # a queued item isn't pending any more
    return first.join(done.select(*keys).distinct(), list(keys), "left_anti")


def live_previews(requests: DataFrame, lane: str, order: Sequence[str] = ("ts_ms", "event_id"), interval_ms: int = INTERVAL_MS, preview_ms: int = PREVIEW_MS, final_ms: int = FINAL_MS) -> DataFrame:
    """lane, event_id, decision of each request (lane, ts_ms, event_id, is_final) of a recogniser's lane.

    Final work always runs (``final``) and cancels a preview that runs (``cancelled``). A preview is
    skipped while final work holds the lane (``final-busy``), while another preview does
    (``preview-busy``), or before ``interval_ms`` have passed since the last one (``interval``);
    else it is ``scheduled``. Previews are disposable, final work is not.

    After a silence longer than all three spans nothing of what was before counts, so a lane is
    folded by such stretches and not as a whole.
    """
    kinds = dict(requests.dtypes)
    cut = stretches(requests, [lane], F.col("ts_ms"), list(order), max(interval_ms, preview_ms, final_ms))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        last, final_until, running = None, float("-inf"), None
        for r in group.sort_values(list(order)).itertuples(index=False):
            now = r.ts_ms
            if r.is_final:
                if running is not None and now < running[1]:
                    out[running[0]][1] = "cancelled"
                running, final_until, decision = None, now + final_ms, "final"
            elif now < final_until:
                decision = "final-busy"
            elif running is not None and now < running[1]:
                decision = "preview-busy"
            elif last is not None and now - last < interval_ms:
                decision = "interval"
            else:
                decision, last, running = "scheduled", now, (len(out), now + preview_ms)
            out.append([r.event_id, decision])
        frame = pd.DataFrame(out, columns=["event_id", "decision"])
        frame.insert(0, lane, group[lane].iloc[0])
        return frame

    columns = dict.fromkeys([lane, "_stretch", *order, "event_id", "is_final"])
    return cut.select(*columns).groupBy(lane, "_stretch").applyInPandas(fold, f"{lane} {kinds[lane]}, event_id {kinds['event_id']}, decision string")
