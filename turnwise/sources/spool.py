"""Audio spools as Spark data sources: packets that come in as files, and segments that leave as pairs of files.

``spool`` reads a folder of packets, in batch or as a stream whose offset is the number of the last
packet; packets are published by renaming, so whatever is listed is whole. ``audio_pairs`` writes each
segment as samples and as a WAV file. Tasks write into a folder of their own attempt; the driver's
commit publishes what the successful attempts have written by one manifest, which is the only thing
that readers look at. So of a task that dies there is no half pair, and what it left is found by
``leftovers``. The folder must be seen under one path by the driver and all executors.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from ..functions.audio import wav_bytes

PACKET = "packet_no long, client_id string, received_ms long, pcm binary"
#: A packet's name: its number, when it came, and whose it is.
_NAME = re.compile(r"(\d{12})-(\d+)-([\w.-]*)\.pcm")
#: Packets that a task reads at most.
TOGETHER = 1000
MANIFESTS, ATTEMPTS, PREVIEWS = "_manifests", "_attempts", "_previews"


def publish_packet(folder: str, number: int, received_ms: int, client: str, pcm: bytes) -> str:
    """Writes one packet so that it is seen whole or not at all."""
    path = os.path.join(folder, f"{number:012d}-{received_ms}-{client}.pcm")
    _published(path, pcm)
    return path


def _published(path: str, data: bytes) -> None:
    part = f"{path}.{uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


@dataclass
class Packets(InputPartition):
    names: list[str]

    def __post_init__(self) -> None:
        super().__init__(self.names)


def _listed(folder: str, after: int = -1, until: int | None = None) -> list[tuple[int, str]]:
    found = ((_NAME.fullmatch(n), n) for n in os.listdir(folder))
    numbered = sorted((int(m[1]), n) for m, n in found if m)
    return [(i, n) for i, n in numbered if i > after and (until is None or i <= until)]


def _parts(packets: list[tuple[int, str]]) -> list[Packets]:
    return [Packets([n for _, n in packets[i : i + TOGETHER]]) for i in range(0, len(packets), TOGETHER)]


def _read(folder: str, part: Packets) -> Iterator[tuple]:
    for name in part.names:
        number, received, client = _NAME.fullmatch(name).groups()
        with open(os.path.join(folder, name), "rb") as f:
            yield int(number), client, int(received), f.read()


class _Batch(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Packets]:
        return _parts(_listed(self.folder)) or [Packets([])]

    def read(self, partition: Packets) -> Iterator[tuple]:
        return _read(self.folder, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"packet": -1}

    def latestOffset(self) -> dict:
        return {"packet": max((i for i, _ in _listed(self.folder)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Packets]:
        return _parts(_listed(self.folder, start["packet"], end["packet"])) or [Packets([])]

    def read(self, partition: Packets) -> Iterator[tuple]:
        return _read(self.folder, partition)


class Spool(DataSource):
    """``spark.read.format("spool").load(folder)`` or ``readStream``: packets by number."""

    @classmethod
    def name(cls) -> str:
        return "spool"

    def schema(self) -> str:
        return PACKET

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options["path"])


@dataclass
class Pairs(WriterCommitMessage):
    attempt: str
    segments: list[dict]


class _PairWriter(DataSourceWriter):
    def __init__(self, folder: str, job: str, schema: StructType):
        self.folder, self.job = folder, job
        self.names = schema.names

    def write(self, iterator: Iterator[Row]) -> Pairs:
        context = TaskContext.get()
        attempt = f"{self.job}-{context.partitionId()}-{context.taskAttemptId()}"
        place = os.path.join(self.folder, ATTEMPTS, attempt)
        os.makedirs(place, exist_ok=True)
        done = []
        for row in iterator:
            values = dict(zip(self.names, row, strict=True))
            pcm, own = bytes(values["pcm"]), uuid4().hex
            for ending, data in (("pcm", pcm), ("wav", wav_bytes(pcm))):
                _published(os.path.join(place, f"{own}.{ending}"), data)
            done.append({"segment_id": str(values["segment_id"]), "file": f"{attempt}/{own}", "bytes": len(pcm)})
        return Pairs(attempt, done)

    def commit(self, messages: list[Pairs | None]) -> None:
        os.makedirs(os.path.join(self.folder, MANIFESTS), exist_ok=True)
        segments = [s for m in messages if m for s in m.segments]
        _published(os.path.join(self.folder, MANIFESTS, f"{self.job}.json"), "\n".join(map(json.dumps, segments)).encode())

    def abort(self, messages: list[Pairs | None]) -> None:
        """Nothing was published; what attempts have written is left to ``leftovers``."""


class AudioPairs(DataSource):
    """``df.write.format("audio_pairs").mode("append").save(folder)`` of segment_id and pcm; reads what was committed."""

    @classmethod
    def name(cls) -> str:
        return "audio_pairs"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("audio pairs are only appended")
        return _PairWriter(self.options["path"], uuid4().hex, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Spool)
    spark.dataSource.register(AudioPairs)


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """segment_id, file, bytes of what has been committed: the files are ``file``.pcm and ``file``.wav below the attempts."""
    schema = "segment_id string, file string, bytes long"
    return spark.read.schema(schema).json(f"{folder}/{MANIFESTS}") if os.path.isdir(os.path.join(folder, MANIFESTS)) else spark.createDataFrame([], schema)


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """segment_id, pcm, wav of what has been committed; a segment that was written again has a row for each time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/{ATTEMPTS}")
    named = files.select(F.regexp_extract("path", r"([^/]+/[0-9a-f]+)\.(pcm|wav)$", 1).alias("file"), F.regexp_extract("path", r"\.(pcm|wav)$", 1).alias("kind"), "content")
    both = named.groupBy("file").agg(*[F.max(F.when(F.col("kind") == k, F.col("content"))).alias(k) for k in ("pcm", "wav")])
    return committed(spark, folder).select("segment_id", "file").join(both, "file").select("segment_id", "pcm", "wav")


def leftovers(spark: SparkSession, folder: str) -> DataFrame:
    """path, length of files below the attempts that no manifest names: what recovery after a crash looks at."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/{ATTEMPTS}").select("path", "length")
    named = files.withColumn("file", F.regexp_extract("path", r"([^/]+/[0-9a-f]+)\.(?:pcm|wav)$", 1))
    return named.join(committed(spark, folder).select("file").distinct(), "file", "left_anti").select("path", "length")


def recover(spark: SparkSession, folder: str, rejects: str) -> int:
    """After a crash: samples that were not committed go to ``rejects`` with a reason, previews of calls that are over are
    deleted, and the number of uncommitted samples is returned. Run it while nobody writes."""
    lost = leftovers(spark, folder)
    samples = lost.where(F.col("path").endswith(".pcm"))
    n = samples.count()
    samples.withColumn("reason", F.lit("uncommitted")).write.mode("append").partitionBy("reason").parquet(rejects)
    previews = os.path.join(folder, PREVIEWS)
    for name in os.listdir(previews) if os.path.isdir(previews) else ():
        os.remove(os.path.join(previews, name))
    return n
