"""Merkle manifest of a table of documents, with a proof for every row.

Leaves of a source are numbered by ranges of their order and reduced in blocks of BLOCK consecutive
ones, each by one task (three levels at once). Rounds of that go on until no more than TOP nodes are
left; these come to the driver, which builds the upper tree and broadcasts, for every block of the
last round, the path from it to the root. Executors then go over the blocks again, round by round
downwards, put each node's siblings before what they were given, and finish the proofs of the rows.

H is the lowercase hexadecimal SHA-256 of its inputs' concatenation, digests as text. While a level
has several nodes, every FAN consecutive ones, however few are left of the last run, become their H.
Texts are hashed where they are read; only digests are shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS
#: Nodes that come to the driver at most; a path has a few kilobytes, so all of them have some 20 MB.
TOP = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Of so many rows one is tampered with, by its id's checksum.
TAMPERED = 5
TOGETHER = 2048


def digest(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def climbed(nodes: list[str], full: bool) -> list[list[str]]:
    """Levels from ``nodes`` up to a single one; ``full``: all LEVELS of a block, of which there are others beside it."""
    out = [nodes]
    while len(out) <= LEVELS if full else len(out[-1]) > 1:
        last = out[-1]
        out.append([digest("".join(last[i : i + FAN])) for i in range(0, len(last), FAN)])
    return out


def siblings(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """Of the i-th node of the lowest level, for each level up: what stands before and after in its run."""
    out = []
    for level in levels[:-1]:
        start = i - i % FAN
        out.append(("".join(level[start:i]), "".join(level[i + 1 : start + FAN])))
        i //= FAN
    return out


def _part(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[_part(f) for f in fields]), 256)


def _leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, h, altered (null where the row isn't tampered with)."""
    own = [F.col(c) for c in FIELDS]
    chosen = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    altered = F.when(chosen, leaf([*own[:-1], ascii_lower(F.col("text"))]))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf(own).alias("h"), altered.alias("altered"))


def _ordered(leaves: DataFrame) -> DataFrame:
    """sid (number of the source in order), b, pos, h, doc_id, altered: the leaves by number within their source.

    Parts are ranges of (source, doc_id, digest). Each is numbered on its own; the driver gets one
    row a part, with which only the first source of a part, begun in earlier ones, goes on.
    """
    order = ["source", "doc_id", "h", "altered"]
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = F.coalesce(F.sha2("source", 256), F.lit("")).alias("name")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, i, now = TaskContext.get().partitionId(), -1, 0, None
        for batch in batches:
            runs, places = [], []
            for x in batch.column("name").to_pylist():
                run, i, now = (run, i + 1, now) if x == now else (run + 1, 0, x)
                runs.append(run)
                places.append(i)
            columns = [pa.array([part] * len(runs), pa.int32()), pa.array(runs, pa.int64()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns], ["part", "run", "i", *batch.schema.names])

    ranged = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(name, "doc_id", "h", "altered")
    ranged = cut(ranged.mapInArrow(number, "part int, run long, i long, name string, doc_id long, h string, altered string"))
    ends = ranged.groupBy("part").agg(F.max("run").alias("runs"), F.min_by("name", "run").alias("first"), F.max_by("name", "run").alias("last"), F.max(F.struct("run", "i")).alias("end"))
    rows, before, sources, held = [], None, 0, 0
    for part, runs, first, last, end in sorted(ends.collect()):
        goes_on = first == before
        offset, base = (held, sources - 1) if goes_on else (0, sources)
        rows.append((part, offset, base))
        sources = base + runs + 1
        held = end["i"] + 1 + (offset if runs == 0 else 0)
        before = last
    begun = leaves.sparkSession.createDataFrame(rows, "part int, offset long, base long")
    pos = F.col("i") + F.when(F.col("run") == 0, F.col("offset")).otherwise(0)
    placed = ranged.join(F.broadcast(begun), "part").select((F.col("base") + F.col("run")).alias("sid"), pos.alias("pos"), "h", "doc_id", "altered")
    return placed.select("sid", F.floor(F.col("pos") / BLOCK).alias("b"), "pos", "h", "doc_id", "altered")


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("sid", "b").sortWithinPartitions("sid", "b", "pos")


def _blocks(each: Callable[..., Iterator[tuple]], kinds: pa.Schema):
    """A function for ``mapInArrow`` over sorted rows: ``each(sid, b, rows)`` gives tuples for a block's rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, schema=kinds)

        def done() -> Iterator[pa.RecordBatch]:
            for x in each(*key, rows):
                out.append(x)
                if len(out) >= TOGETHER:
                    yield batch()
                    out.clear()

        for part in batches:
            for sid, b, *row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (sid, b) != key:
                    if key is not None:
                        yield from done()
                    key, rows = (sid, b), []
                rows.append(row)
        if key is not None:
            yield from done()
        if out:
            yield batch()

    return work


def _reduced(dealt: DataFrame) -> DataFrame:
    """sid, pos, h: the node of each block, numbered within its source by the block."""

    def each(sid: int, b: int, rows: list) -> Iterator[tuple]:
        yield sid, b, climbed([r[1] for r in rows], b > 0)[-1][0]

    kinds = pa.schema([("sid", pa.int64()), ("pos", pa.int64()), ("h", pa.string())])
    return dealt.select("sid", "b", "pos", "h").mapInArrow(_blocks(each, kinds), "sid long, pos long, h string")


def _top(nodes: list, joined: bool) -> dict[tuple[int, int], str]:
    """(sid, pos) of each node that is left: its path to the root, as JSON of (subroot, root, pairs). On the driver.

    ``joined``: the nodes are of the tree over all subroots already, and their subroots are known below.
    """
    by_source: dict[int, list[str]] = {}
    for sid, _, h in sorted(nodes):
        by_source.setdefault(sid, []).append(h)
    trees = {sid: climbed(hs, False) for sid, hs in by_source.items()}
    over = climbed([t[-1][0] for t in trees.values()], False)
    out = {}
    for i, (sid, tree) in enumerate(trees.items()):
        upper = siblings(over, i)
        for pos in range(len(tree[0])):
            out[sid, pos] = json.dumps([None if joined else tree[-1][0], over[-1][0], siblings(tree, pos) + upper])
    return out


def manifest(docs: DataFrame, block_top: int = TOP) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    ``docs``: doc_id, source, lang, n_chars, text; nulls are leaves' parts like any value, a null source
    is a source and the first, rows with a null doc_id are their source's first. Rows of one id and
    source follow by digest; equal rows have equal leaves, each with a proof of its own place. Other
    columns take no part. ``block_top`` bounds the nodes that come to the driver. Of an empty table the
    result is empty. Blocks hold BLOCK rows at most, whatever a source has.
    """
    spark = docs.sparkSession
    rounds = [cut(_dealt(_ordered(cut(_leaves(docs)))))]
    nodes = cut(_reduced(rounds[0]))
    joined_at = None  # the round from which on the nodes are of the tree over all sources
    while (n := nodes.count()) > block_top:
        if joined_at is None and nodes.select("sid").distinct().count() == n:
            joined_at = len(rounds)
            nodes = nodes.select(F.lit(-1).cast("long").alias("sid"), F.col("sid").alias("pos"), "h")
        rounds.append(cut(_dealt(nodes.withColumn("b", F.floor(F.col("pos") / BLOCK)))))
        nodes = cut(_reduced(rounds[-1]))
    top = spark.sparkContext.broadcast(_top([tuple(r) for r in nodes.select("sid", "pos", "h").collect()], joined_at is not None))
    paths = None
    for i in range(len(rounds) - 1, 0, -1):
        paths = _handed_down(rounds[i], paths, top, i == joined_at)
    return _proved(rounds[0], paths, top)


def _with_paths(rows: DataFrame, paths: DataFrame | None) -> DataFrame:
    """Sorted blocks, each led by its path if the paths are rows."""
    names = ["sid", "b", "pos", "h", *(c for c in ("doc_id", "altered") if c in rows.columns)]
    if paths is None:
        return rows.select(*names)
    led = paths.select("sid", "b", F.lit(-1).cast("long").alias("pos"), F.col("path").alias("h"))
    return _dealt(rows.select(*names).unionByName(led, allowMissingColumns=True)).select(*names)


def _path(key: tuple[int, int], rows: list, top) -> tuple[list, list]:
    if rows[0][0] == -1:
        return json.loads(rows[0][1]), rows[1:]
    return json.loads(top.value[key]), rows


def _handed_down(dealt: DataFrame, paths: DataFrame | None, top, first_joined: bool) -> DataFrame:
    """sid, b, path of the blocks of the round below, of which ``dealt`` holds the nodes."""

    def each(sid: int, b: int, rows: list) -> Iterator[tuple]:
        (subroot, root, pairs), rows = _path((sid, b), rows, top)
        levels = climbed([r[1] for r in rows], b > 0)
        for i, (pos, h) in enumerate(rows):
            path = json.dumps([h if first_joined else subroot, root, siblings(levels, i) + pairs])
            yield (pos, 0, path) if first_joined else (sid, pos, path)

    kinds = pa.schema([("sid", pa.int64()), ("b", pa.int64()), ("path", pa.string())])
    return cut(_with_paths(dealt, paths).mapInArrow(_blocks(each, kinds), "sid long, b long, path string"))


def _proved(dealt: DataFrame, paths: DataFrame | None, top) -> DataFrame:
    def each(sid: int, b: int, rows: list) -> Iterator[tuple]:
        (subroot, root, pairs), rows = _path((sid, b), rows, top)
        levels = climbed([r[1] for r in rows], b > 0)
        # Rows of a run share all that is above it.
        above, rest = [], ""
        for i, (_, own, doc_id, altered) in enumerate(rows):
            if i % FAN == 0:
                above = siblings(levels[1:], i // FAN) + pairs
                rest = "".join(x + y for x, y in above)
            run = siblings(levels[:2], i)
            proof = "".join(x + y for x, y in run) + rest
            folded = own if altered is None else altered
            for before, after in run + above:
                folded = digest(before + folded + after)
            yield doc_id, own, subroot, root, digest(proof), folded, folded == root

    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    kinds = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in names[1:]), ("verified", pa.bool_())])
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _with_paths(dealt, paths).mapInArrow(_blocks(each, kinds), schema)
