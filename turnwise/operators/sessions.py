"""Sessions, numbering and run lengths over ordered events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def gap_sessions(events: DataFrame, keys: Sequence[str], at: Column, order: Sequence[str], gap: int, end: Column | None = None, name: str = "turn_no") -> DataFrame:
    """``events`` with ``name``: 1, 2, …; a gap of more than ``gap`` after the event before begins a new one.

    ``at`` and ``end`` (if events last) are whole numbers in the unit of ``gap``.
    """
    w = _order(keys, order)
    before = F.lag(at if end is None else end).over(w)
    fresh = F.when(at - before <= gap, 0).otherwise(1)
    return events.withColumn("_fresh", fresh).withColumn(name, F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_fresh")


def stretches(events: DataFrame, keys: Sequence[str], at: Column, order: Sequence[str], gap: int, name: str = "_stretch", together: int = 4096) -> DataFrame:
    """``events`` with ``name``: the part of its key's history that an event belongs to.

    A part ends only where nothing has come for more than ``gap``, so a fold whose state is gone by
    then may run over each part on its own; a part goes on to the first such pause after ``together`` events.
    """
    w = _order(keys, order)
    fresh = F.coalesce(at - F.lag(at).over(w) > gap, F.lit(True))
    rows = events.withColumn("_place", F.row_number().over(w)).withColumn("_begin", F.when(fresh, F.col("_place")))
    begin = F.max("_begin").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, F.floor(begin / together)).drop("_place", "_begin")


def run_length(events: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, name: str) -> DataFrame:
    """``events`` with ``name``: how many events in a row, up to this one, have ``flag`` (0 where it fails)."""
    w = _order(keys, order)
    marked = events.withColumn("_on", F.when(flag, 1).otherwise(0)).withColumn("_off", F.sum(1 - F.col("_on")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(*keys, "_off").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(name, F.sum("_on").over(inner).cast("bigint")).drop("_on", "_off")


def preroll(events: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, size: int = 30, name: str = "preroll") -> DataFrame:
    """``events`` with ``name``: the last ``size`` values, this one included."""
    return events.withColumn(name, F.collect_list(value).over(_order(keys, order).rowsBetween(1 - size, 0)))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, start: int = 0) -> DataFrame:
    return rows.withColumn(name, (F.row_number().over(_order(keys, order)) - 1 + start).cast("bigint"))


def latest(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The row with the highest ``seq`` of each key: last wins. An aggregate, so partial sums precede the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(seq)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


def merged_latest(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Newest non-null value of each column by key: a later row is laid over an earlier one."""
    others = [c for c in rows.columns if c not in (*keys, seq)]
    newest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in others]
    return rows.groupBy(*keys).agg(F.max(seq).alias(seq), *newest)


def ranked(rows: DataFrame, at: Column, order: Sequence[str], name: str, parts: int = 64) -> DataFrame:
    """``rows`` with their place (from 1) in the order of ``order`` over the whole table.

    ``at`` is a number that the order begins with. Its quantiles deal the rows into ``parts`` ranges; each
    is numbered on its own and starts where those before it end, so no task sorts all rows. At most
    ``parts`` bounds and counts come to the driver.
    """
    bounds = rows.select(F.percentile_approx(at, [i / parts for i in range(1, parts)], F.lit(10_000))).first()[0] or []
    range_of = F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(bounds))]), lambda x: x <= at)) if bounds else F.lit(0)
    dealt = rows.withColumn("_range", F.coalesce(range_of, F.lit(-1)))
    starts, start = [], 0
    for r in sorted(dealt.groupBy("_range").count().collect()):
        starts += [F.lit(r["_range"]), F.lit(start)]
        start += r["count"]
    offset = F.element_at(F.create_map(*starts), F.col("_range")) if starts else F.lit(0)
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + offset
    return dealt.withColumn(name, place.cast("bigint")).drop("_range")


def first_seen(rows: DataFrame, key: str, seq: str, name: str = "ordinal") -> DataFrame:
    """Keys with their rank by first appearance, from 1."""
    firsts = rows.groupBy(key).agg(F.min(seq).alias("first_seq"))
    return ranked(firsts, F.col("first_seq"), ["first_seq", key], name)


def left_context(segments: DataFrame, keys: Sequence[str], order: Sequence[str], novel: str, context: int = 10_000, window: int = 24_000, name: str = "context_prefix") -> DataFrame:
    """``segments`` with the audio before it in the turn that a decoder sees too: at most ``context``, and ``window`` in all."""
    before = F.coalesce(F.sum(novel).over(_order(keys, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return segments.withColumn(name, F.least(before, F.lit(context), F.greatest(F.lit(0), F.lit(window) - F.col(novel))).cast("bigint"))


def live_windows(events: DataFrame, keys: Sequence[str], at: Column, every: int, size: int) -> DataFrame:
    """``events`` of segments (keys), one row for each window that an event is in: window_no (from 1), window_start, window_end.

    A segment's windows are anchored at its first event: the n-th ends ``n * every`` after it and looks
    back over ``size`` at most; the last ends with the segment, however short it is since the one before. Ends belong to a window, beginnings don't,
    but for the segment's own. ``at`` and the numbers are whole and of one unit.
    """
    ends = events.withColumn("_at", at).groupBy(*keys).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    rows = events.withColumn("_at", at).join(ends, list(keys))
    n_windows = F.greatest(F.lit(1), F.ceil((F.col("_last") - F.col("_first")) / every))
    since = F.col("_at") - F.col("_first")
    first, last = F.greatest(F.lit(1), F.ceil(since / every)), F.least(n_windows, F.floor((since + size) / every) + 1)
    rows = rows.withColumn("window_no", F.explode(F.sequence(first, F.greatest(first, last))))
    end = F.least(F.col("_last"), F.col("_first") + F.col("window_no") * every)
    rows = rows.withColumn("window_end", end).withColumn("window_start", F.greatest(F.col("_first"), end - size))
    inside = (F.col("_at") <= F.col("window_end")) & ((F.col("_at") > F.col("window_start")) | (F.col("_at") == F.col("_first")) & (F.col("window_start") == F.col("_first")))
    return rows.where(inside).drop("_at", "_first", "_last")


def newer_only(rows: DataFrame, keys: Sequence[str], order: Sequence[str], revision: str) -> DataFrame:
    """Rows whose revision is higher than any before it."""
    w = _order(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_most", F.max(revision).over(w)).where(F.col("_most").isNull() | (F.col(revision) > F.col("_most"))).drop("_most")


def top_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")
