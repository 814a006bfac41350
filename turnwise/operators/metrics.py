"""Counts, rates and the three kinds of percentile summaries."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import edit_rate, punctuation_signature


def nearest_rank(values: Column, p: float, half_even: bool = False) -> Column:
    """Element round((n - 1) p) of the sorted values: no interpolation. Ties of the index round up, or to even."""
    s = F.sort_array(values)
    at = (F.size(s) - 1) * F.lit(p)
    return F.element_at(s, ((F.bround(at) if half_even else F.round(at)) + 1).cast("int"))


def latency_summary(x: str, half_even: bool = False) -> list[Column]:
    values = F.collect_list(x)
    return [
        F.avg(x).alias("mean_ms"),
        nearest_rank(values, 0.50, half_even).alias("p50_ms"),
        nearest_rank(values, 0.95, half_even).alias("p95_ms"),
        F.min(x).alias("min_ms"),
        F.max(x).alias("max_ms"),
    ]


def upper_median(x: str) -> Column:
    """Element n // 2 of the sorted values."""
    s = F.sort_array(F.collect_list(x))
    return F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))


def tree_size(files: DataFrame, key: str) -> DataFrame:
    """Files and bytes of each key, from a listing (as of the ``binaryFile`` source: path, length)."""
    return files.groupBy(key).agg(F.count("*").alias("files"), F.sum("length").cast("bigint").alias("bytes"))


def real_time_factor(elapsed: Column, duration: Column) -> Column:
    return F.when(duration > 0, elapsed / duration).otherwise(0.0)


#: Ranges that the values of a key are counted in first.
BINS = 1024


#: Places of a sorted list, from 0, for a number of values.
def half_up(share: float) -> Callable[[Column], Column]:
    return lambda n: F.round((n - 1) * F.lit(share))


def half_even(share: float) -> Callable[[Column], Column]:
    return lambda n: F.bround((n - 1) * F.lit(share))


def upper_middle(n: Column) -> Column:
    return F.floor(n / 2)


def histogram_ranks(df: DataFrame, keys: list[str], value: str, ranks: Mapping[str, float | Callable[[Column], Column]]) -> DataFrame:
    """Ranked values of any number of rows: keys and a column for each name. A rank is a share (nearest rank) or a function of the number of values that gives a place from 0.

    Values are counted in BINS ranges of each key, which tells the range that holds a rank; only the
    values of those ranges are then counted one by one. No list of values is gathered, and no task
    sorts all values of a key. Null values don't count.
    """
    places = {n: half_up(p) if isinstance(p, float) else p for n, p in ranks.items()}
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    ends = rows.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_all"))
    share = (F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low"))
    at = F.when(F.col("_high") > F.col("_low"), F.least(F.floor(share * BINS), F.lit(BINS - 1))).otherwise(F.lit(0)).cast("int")
    binned = rows.join(ends, keys).withColumn("_bin", at)
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), (place(F.col("_all")) + 1).cast("double").alias("rank")) for n, place in places.items()])).alias("_want")
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("n"), F.first("_all").alias("_all")).withColumn("upto", F.sum("n").over(upto))
    held = counts.select(*keys, "_bin", "n", "upto", wanted).where((F.col("upto") >= F.col("_want.rank")) & (F.col("upto") - F.col("n") < F.col("_want.rank")))
    held = held.select(*keys, "_bin", F.col("_want.name").alias("_name"), (F.col("_want.rank") - (F.col("upto") - F.col("n"))).alias("_rank"))
    values = binned.join(held.select(*keys, "_bin").distinct(), [*keys, "_bin"], "left_semi").groupBy(*keys, "_bin", "_v").agg(F.count("*").alias("n"))
    within = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = values.withColumn("upto", F.sum("n").over(within)).join(held, [*keys, "_bin"])
    found = placed.where((F.col("upto") >= F.col("_rank")) & (F.col("upto") - F.col("n") < F.col("_rank")))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in ranks])


def candidate_scores(cases: DataFrame, key: str) -> DataFrame:
    """Scores of each candidate's outputs (key, reference, output, elapsed_ms): counts and rates of exact texts and
    of exact punctuation, mean edit rate, mismatches, whether all match, and mean time."""
    exact = F.col("output").eqNullSafe(F.col("reference"))
    marks = punctuation_signature("output").eqNullSafe(punctuation_signature("reference"))
    n = F.greatest(F.lit(1), F.count("*"))
    return cases.groupBy(key).agg(
        F.count("*").alias("cases"), F.count_if(exact).alias("exact"), (F.count_if(exact) / n).alias("exact_rate"),
        F.count_if(marks).alias("punctuation_exact"), (F.count_if(marks) / n).alias("punctuation_rate"),
        F.avg(edit_rate("reference", "output")).alias("mean_edit_rate"),
        F.count_if(~(exact & marks)).alias("mismatches"), F.bool_and(exact & marks).alias("all_match"), F.avg("elapsed_ms").alias("mean_ms"),
    )


def probed(results: DataFrame) -> DataFrame:
    """``results`` (expected, actual, error) with passed: nothing expected counts as equal, a failure never does."""
    return results.withColumn("passed", F.col("error").isNull() & (F.col("expected").isNull() | (F.col("expected") == F.col("actual"))))
