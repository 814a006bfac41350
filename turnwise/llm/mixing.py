"""Mixing sources to target weights by entropy balancing.

A document of size z in source s gets the rate min(LIMIT, exp(lambda_s * z / mean_s)): of all
rates that meet the token constraint (sum of rate times size is the source's target) and exceed
the limit nowhere, these are nearest to 1 in relative entropy. The lambdas solve the convex dual;
each Newton step aggregates the rates of all sizes over the cluster, and sums whole numbers, so
that reruns agree to the last bit. Rates become copies by size: all documents of a size share one
rate, the number of copies of each size carries the rounding error on to the next smaller size,
and which documents get the one copy more is drawn by a hash of the id.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, unused, word_count

#: Weights of the sources in code-point order, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No document is taken more often, and no source's target exceeds its size times this.
LIMIT = 3
STEPS = 60
#: Rounds of sharing the excess; each caps a source at least, and most cap very many.
ROUNDS = 1000
#: Gradients are summed as whole multiples of this share of a word.
UNIT = 1 << 20
#: Documents of one source and size that are ranked together.
GROUP = 512


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (source: one row each) with their place by code point, null last, from 0, in the column ``name``.

    Dealt out by range: each part is numbered on its own and starts where the parts before it end.
    Of those parts, as many as there are shuffle partitions at most, only the lengths come to the driver.
    """
    ranged = rows.withColumn("last", F.col("source").isNull())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(ranged.repartitionByRange(parts, "last", "source").withColumn("part", F.spark_partition_id()))
    start, starts = 0, {}
    for row in ranged.groupBy("part").count().orderBy("part").collect():
        starts[row["part"]] = start
        start += row["count"]
    within = F.row_number().over(Window.partitionBy("part").orderBy("last", "source")) - 1
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), F.col("part")) if starts else F.lit(0)
    return ranged.withColumn(name, (within + offset).cast("long")).drop("last", "part")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (source, source_size: one row each) with place and target.

    The sources share the sum of all sizes by weight; a target stops at LIMIT times its source's
    size, and the excess is shared again by weight until none is above. ``level`` is what a weight
    of 1 gets; each round raises it by what the sources capped at it leave over, which is one
    aggregation. Raises if ROUNDS don't suffice.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = numbered(sources, "place").withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")))
    ranked = cut(ranked.withColumn("cap", (F.col("source_size") * LIMIT).cast("double")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    for _ in range(ROUNDS):
        full = F.col("cap") < F.lit(level) * F.col("weight")
        n, held, weight = ranked.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not weight:
            break
        level, capped = (total - (held or 0.0)) / weight, n
    else:
        raise RuntimeError(f"the targets are not settled after {ROUNDS} rounds")
    return ranked.withColumn("target", F.least("cap", F.lit(level) * F.col("weight"))).drop("cap", "weight")


def _same(a: str, b: str):
    """Equal, nulls too."""
    return F.col(a).eqNullSafe(F.col(b))


def balanced(sizes: DataFrame, aims: DataFrame, steps: int = STEPS) -> DataFrame:
    """sizes (sid, size, n) with rate, for aims (sid, source_size, docs, target).

    Newton's method on each source's dual, all sources in one aggregation a step; where a step
    would leave the bracket known to hold the root, the bracket is halved instead. What is carried
    from step to step is one row a source.
    """
    mean = F.col("source_size") / F.greatest("docs", F.lit(1))
    state = cut(
        aims.select("sid", "target", F.when(mean > 0, mean).otherwise(1.0).alias("mean"), (F.col("target") >= F.col("source_size") * LIMIT).alias("full"))
        .withColumns({"at": F.lit(0.0), "low": F.lit(-1e4), "high": F.lit(1e4), "done": F.lit(False)})
    )
    for _ in range(steps):
        x = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(LIMIT)), F.exp(F.least(F.col("at") * x, F.lit(50.0))))
        slope = F.when(rate < LIMIT, rate * x).otherwise(0.0)
        whole = lambda v: F.sum(F.round(v * F.col("size") * UNIT).cast("decimal(38,0)") * F.col("n"))
        got = sizes.join(state.where("not done and not full"), "sid").groupBy("sid").agg((whole(rate) / UNIT).cast("double").alias("value"), (whole(slope) / UNIT).cast("double").alias("slope"))
        gap = F.col("value") - F.col("target")
        low, high = F.when(gap < 0, F.col("at")).otherwise(F.col("low")), F.when(gap > 0, F.col("at")).otherwise(F.col("high"))
        newton = F.col("at") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high)
        middle = F.when((low < 0) & (high > 0) & (F.abs(low) + F.abs(high) > 8), F.greatest(F.least(F.col("at") * 4 + F.signum(-gap), high), low)).otherwise((low + high) / 2)
        middle = F.when((middle <= low) | (middle >= high), (low + high) / 2).otherwise(middle)
        done = F.abs(gap) <= F.greatest(F.lit(1e-3), F.col("target") * 1e-9)
        moved = state.join(got, "sid", "left").select(
            "sid", "target", "mean", "full",
            F.when(F.col("value").isNull() | done, F.col("at")).when(inside, newton).otherwise(middle).alias("at"),
            F.when(F.col("value").isNull(), F.col("low")).otherwise(low).alias("low"),
            F.when(F.col("value").isNull(), F.col("high")).otherwise(high).alias("high"),
            F.when(F.col("value").isNull(), F.lit(True)).otherwise(done).alias("done"),
        )
        state = cut(moved)
        if state.where("not done").isEmpty():
            break
    x = F.col("size") / F.col("mean")
    rate = F.when(F.col("full"), F.lit(float(LIMIT))).otherwise(F.least(F.lit(float(LIMIT)), F.exp(F.least(F.col("at") * x, F.lit(50.0)))))
    return sizes.join(state.select("sid", "mean", "at", "full", "target"), "sid").select("sid", "size", "n", "target", rate.alias("rate"))


def _round(group: pd.DataFrame) -> pd.DataFrame:
    """Whole numbers of copies for the sizes of one source, largest first; the error goes on to the next."""
    group = group.sort_values("size", ascending=False)
    owed, copies, aim = 0.0, [], float(group["target"].iloc[0])
    sizes, counts, rates = group["size"].tolist(), group["n"].tolist(), group["rate"].tolist()
    for i, (size, n, rate) in enumerate(zip(sizes, counts, rates, strict=True)):
        owed += n * rate * size
        if i + 1 == len(sizes):
            owed += aim - sum(n * r * s for s, n, r in zip(sizes, counts, rates, strict=True))
        k = min(LIMIT * n, max(0, int(owed / size + 0.5)))
        owed -= k * size
        copies.append(k)
    return pd.DataFrame({"sid": group["sid"], "size": group["size"], "n": group["n"], "copies": copies})


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, mark: Column | None = None) -> DataFrame:
    """doc_id, mark (by default a hash of the text), source, size, source_size, target, copies (0 to LIMIT), taken (copies times size) of every row.

    Null and blank texts have size 0 and no copy. Null sources are one source. Repeated rows are
    mixed like different documents. An empty table gives an empty result. Other columns are left out.
    """
    mark = F.xxhash64("text") if mark is None else mark
    rows = cut(docs.select("doc_id", "source", mark.alias("mark"), word_count(F.col("text")).alias("size")))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    # A source is named by its place in the list from here on: that name is never null.
    aims = cut(targets(sources, weights).withColumnRenamed("place", "sid"))
    named = aims.select(F.col("source").alias("s"), "sid")
    sizes = rows.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    sizes = cut(sizes.join(named, _same("source", "s")).select("sid", "size", "n"))
    rates = balanced(sizes, aims)
    # As many rows as a source has different sizes, which the longest text bounds.
    copies = cut(rates.groupBy("sid").applyInPandas(_round, "sid long, size long, n long, copies long"))
    # Documents of one source and size are dealt into groups of about GROUP by a hash of the id,
    # and each group gets its share of the copies, so no group of equal documents is ranked whole.
    deal = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.greatest(F.lit(1), F.ceil(F.col("n") / GROUP)))
    keyed = cut(rows.where("size > 0").join(named, _same("source", "s")).drop("s").join(sizes, ["sid", "size"]).withColumn("part", deal).drop("n"))
    parts = keyed.groupBy("sid", "size", "part").agg(F.count("*").alias("m")).join(copies, ["sid", "size"])
    upto = Window.partitionBy("sid", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = lambda m: F.floor(m.cast("decimal(38,0)") * F.col("copies") / F.col("n")).cast("long")
    parts = parts.withColumn("sum", F.sum("m").over(upto)).select(
        "sid", "size", "part", "m", (share(F.col("sum")) - share(F.col("sum") - F.col("m"))).alias("part_copies")
    )
    chance = Window.partitionBy("sid", "size", "part").orderBy(F.xxhash64("doc_id", F.lit(90)), "doc_id", "mark")
    each = keyed.join(cut(parts), ["sid", "size", "part"]).withColumn("place", F.row_number().over(chance))
    more = F.when(F.col("place") <= F.col("part_copies") % F.col("m"), 1).otherwise(0)
    taken = each.select("doc_id", "mark", "source", "size", "sid", (F.floor(F.col("part_copies") / F.col("m")) + more).alias("copies"))
    none = rows.where("size = 0").join(named, _same("source", "s")).select("doc_id", "mark", "source", "size", "sid", F.lit(0).cast("long").alias("copies"))
    out = taken.unionByName(none).join(aims.select("sid", "source_size", "target"), "sid")
    return out.select("doc_id", "mark", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def copied(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns, whatever their names.

    Rows that differ in any column are mixed each on its own; rows that are equal in all of them are
    one row here, which comes as often as all of them are taken. An empty table gives an empty result.
    """
    names = docs.columns
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in names])
    counts = mixed(docs, weights, whole).groupBy("doc_id", "mark", "source").agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    mark, key, copy = unused(names, "mix_mark"), unused(names, "mix_key"), unused([*names, "mix_copies"], "mix_copy")
    own = unused(names, "mix_copies")
    # Two digests that are never null stand for a row: the rows are dealt by them once, for repeats and for the join.
    digest = F.xxhash64(F.col("mark"), "doc_id", "source")
    counts = counts.select(F.col("mark").alias(mark), digest.alias(key), F.col("copies").alias(own))
    rows = docs.withColumn(mark, whole).withColumn(key, F.xxhash64(F.col(mark), "doc_id", "source")).dropDuplicates([mark, key])
    taken = rows.join(counts, [mark, key]).select(*[F.col(f"`{c}`") for c in names], F.explode(F.sequence(F.lit(1), F.col(own))).alias(copy))
    return taken.drop(copy)
