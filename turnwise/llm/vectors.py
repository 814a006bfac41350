"""Searches of a stated query set against all rows, in cells of rows that lie together.

Pivots picked from a bounded sample divide all rows into cells (a row belongs to its nearest
pivot); a large cell is dealt into blocks by a hash of the id. Each block's index is built by one
task for all the queries that come to it (more tasks only where QUERY_BLOCK queries don't hold
them). A query first visits one block of its own cell, which gives a score that its k best reach.
Then it goes only to the blocks of those cells that the pivot and the covering radius don't rule
out. No side is broadcast, and no task holds more than one block of each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

QUERY_EVERY = 20
TOP = 20
#: Pivots at most, rows that they are picked from (both bound what the driver holds), rows that a pivot stands for.
PIVOTS, SAMPLE, CELL = 1024, 8192, 4096
#: Rows of a block, and as many queries for each time that its index is built. Blocks grow with the table, so that queries
#: without close neighbours, which visit all of them, aren't copied to ever more.
ROW_BLOCK, LARGEST_BLOCK, BLOCKS, QUERY_BLOCK = 8192, 65536, 64, 16384
#: Share by which upper bounds are raised, so that rounding never prunes.
ROUNDING = 1e-9

Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def usable(rows: DataFrame, zero_too: bool) -> DataFrame:
    """vec_id, v (doubles), dim of the rows that take part: no null id, no null or non-finite component."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))
    )
    if not zero_too:
        out = out.where(F.exists(v, lambda x: x != 0))
    return out.withColumn("dim", F.size("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.asarray(x.flatten(), dtype=np.float64) for x in chunks] or [np.empty(0)]).reshape(-1, dim)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distance of each row of ``x`` to each centre."""
    square = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * (x @ centres.T)
    return np.sqrt(np.maximum(square, 0))


def spread(x: np.ndarray, count: int) -> np.ndarray:
    """Positions of up to ``count`` rows, each the farthest from those before it."""
    picked, far = [0], distances(x, x[:1])[:, 0]
    while len(picked) < count and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, distances(x, x[picked[-1:]])[:, 0])
    return np.array(picked)


def upper(dot: np.ndarray, own: np.ndarray, norm: np.ndarray, radius: np.ndarray, largest: np.ndarray) -> np.ndarray:
    """No inner product of a query with a row of the ball exceeds this.

    dot: query with centre; own, norm: their lengths; radius: of the ball; largest: length of its
    longest row. Two bounds, the lower one counts: dot + radius * own, and half of own^2 + largest^2
    less the square of the least distance that a row of the ball can have.
    """
    gap = np.sqrt(np.maximum(own * own + norm * norm - 2 * dot, 0)) * (1 - ROUNDING) - radius * (1 + ROUNDING)
    near = np.maximum(gap, 0)
    far = own * np.maximum(norm, largest)
    return np.minimum(np.minimum(dot + radius * own, (own * own + largest * largest - near * near) / 2), own * largest) + ROUNDING * (far + own * own + largest * largest + 1e-3)


def _pivots(rows: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Pivots by length of vector. At most SAMPLE rows come to the driver; lengths that none of them has get no pivot."""
    every = max(1, n // (SAMPLE // 2))
    picked = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(every)) == 0).select("dim", "v").limit(SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for row in sorted(picked):
        by_dim.setdefault(row.dim, []).append(row.v)
    want = max(1, min(PIVOTS, math.ceil(n / CELL)))
    out = {}
    for dim, vectors in by_dim.items():
        x = np.array(vectors)
        out[dim] = x[spread(x, max(1, want * len(x) // len(picked)))]
    return out


def _placed(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rows with cell (number of the nearest pivot of their length; -1 if there is none), gap to it, and norm."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = _matrix(part.column("v"), int(dim))
                cell, gap = np.full(len(x), -1, np.int32), np.zeros(len(x))
                if int(dim) in pivots:
                    d = distances(x, pivots[int(dim)])
                    cell = d.argmin(axis=1).astype(np.int32)
                    gap = np.sqrt(((x - pivots[int(dim)][cell]) ** 2).sum(axis=1))
                norm = np.sqrt((x * x).sum(axis=1))
                columns = [part.column("vec_id"), part.column("v"), part.column("dim"), pa.array(cell), pa.array(gap), pa.array(norm)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "dim", "cell", "gap", "norm"])

    return rows.mapInArrow(work, "vec_id long, v array<double>, dim int, cell int, gap double, norm double")


def _routed(queries: DataFrame, pivots: dict[int, np.ndarray], cells: dict[tuple[int, int], tuple[float, float]]) -> DataFrame:
    """queries with cells: those of their length that may hold a row that reaches ``floor``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in map(int, np.unique(dims)):
                part = batch.filter(pa.array(dims == dim))
                known = sorted(c for d, c in cells if d == dim)
                if not known:
                    to = [[-1]] * part.num_rows
                else:
                    q, c = _matrix(part.column("v"), dim), pivots[dim][known]
                    radius, largest = (np.array([cells[dim, i][j] for i in known]) for j in (0, 1))
                    bound = upper(q @ c.T, np.sqrt((q * q).sum(axis=1))[:, None], np.sqrt((c * c).sum(axis=1)), radius, largest)
                    open_ = bound >= part.column("floor").to_numpy()[:, None]
                    to = [[known[i] for i in np.flatnonzero(row)] for row in open_]
                columns = [*(part.column(x) for x in ("vec_id", "v", "dim", "seen", "floor")), pa.array(to, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "dim", "seen", "floor", "cells"])

    return queries.select("vec_id", "v", "dim", "seen", "floor").mapInArrow(work, "vec_id long, v array<double>, dim int, seen string, floor double, cells array<int>")


def _visited(visits: DataFrame, blocks: DataFrame, kernel: Kernel, score: str, k: int) -> DataFrame:
    """query_id, vec_id, score of the best rows of each block for the queries that visit it.

    visits: vec_id, v, dim, cell, block, floor; blocks: vec_id, v, dim, cell, block.
    """
    kind = pa.int64() if score == "long" else pa.float64()
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", kind)])

    def work(queries: pa.Table, data: pa.Table) -> pa.Table:
        if not queries.num_rows or not data.num_rows:
            return schema.empty_table()
        dim = data["dim"][0].as_py()
        q, x = _matrix(queries["v"], dim), _matrix(data["v"], dim)
        q_ids, ids = queries["vec_id"].to_numpy(), data["vec_id"].to_numpy()
        if len(np.unique(ids)) < len(ids):  # rows that repeat id and vector are one candidate
            _, first = np.unique(np.column_stack([ids, x]), axis=0, return_index=True)
            ids, x = ids[first], x[first]
        at, of, scores = kernel(ids, x, q_ids, q, queries["floor"].to_numpy(), k)
        return pa.table([pa.array(q_ids[at], pa.int64()), pa.array(ids[of], pa.int64()), pa.array(scores, kind)], schema=schema)

    keys = ["dim", "cell", "block"]
    # As many index builds of a block as its queries need; nearly always one.
    chunks = cut(visits.groupBy(*keys).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("chunks")))
    left = visits.join(chunks, keys).withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("chunks")).cast("int"))
    right = blocks.join(chunks, keys).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    both = [*keys, "chunk"]
    # Renamed to themselves: blocks and visits come from one table, and their columns would be ambiguous.
    left = left.select(*[F.col(c).alias(c) for c in ("vec_id", "v", "floor", *both)]).groupBy(*both)
    return left.cogroup(right.select("vec_id", "v", *both).groupBy(*both)).applyInArrow(work, f"query_id long, vec_id long, score {score}")


def search(rows: DataFrame, kernel: Kernel, score: str, k: int = TOP, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id ``every`` divides, its ``k`` best others.

    ``rows``: vec_id, v, dim. Vectors are compared with those of their own length only.
    ``kernel(ids, matrix, query ids, query matrix, floors, k)`` finds the best of one block: positions
    of queries, positions of rows, scores. Only rows that reach a query's floor are asked for, and a
    row whose id is the query's never counts. Rows that repeat an id with equal vectors are one
    candidate, and so are queries; an id with different vectors is a row for each of them.
    """
    n = rows.count()
    pivots = _pivots(rows, n)
    placed = cut(_placed(rows, pivots))
    cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("rows"), F.max("gap").alias("radius"), F.max("norm").alias("largest"))
    cells = cut(cells.withColumn("parts", F.ceil(F.col("rows") / min(LARGEST_BLOCK, max(ROW_BLOCK, n // BLOCKS))).cast("int")))
    # One row a pivot: bounded.
    known = {(r.dim, r.cell): (r.radius, r.largest) for r in cells.where("cell >= 0").collect()}
    dealt = placed.join(cells.select("dim", "cell", "parts"), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts")).cast("int"))
    blocks = dealt.select("vec_id", "v", "dim", "cell", "block")
    queries = blocks.where(F.col("vec_id") % every == 0)
    first = cut(_visited(queries.withColumn("floor", F.lit(float("-inf"))), blocks, kernel, score, k))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.distinct().withColumn("place", F.row_number().over(place)).where(F.col("place") == k)
    kth = kth.select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("kth"))
    # An id with different vectors has several queries; none of them may be cut short by another's scores.
    again = queries.groupBy("vec_id").agg(F.count_distinct("v").alias("vectors")).where("vectors = 1").select("vec_id")
    seen = F.concat_ws(":", "cell", "block")
    floored = queries.withColumn("seen", seen).join(kth.join(again, "vec_id"), "vec_id", "left").withColumn("floor", F.coalesce("kth", F.lit(float("-inf"))))
    routed = _routed(floored, pivots, known).withColumn("cell", F.explode("cells"))
    visits = routed.join(cells.select("dim", "cell", "parts"), ["dim", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    visits = visits.where(F.concat_ws(":", "cell", "block") != F.col("seen")).select("vec_id", "v", "dim", "cell", "block", "floor")
    found = first.unionByName(_visited(visits, blocks, kernel, score, k)).distinct()
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
