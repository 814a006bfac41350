"""Sources and sinks: audio files, JSON lines, configuration, request tables, dead letters, atomic pairs."""

from __future__ import annotations

import tarfile
import tomllib
from collections.abc import Callable, Iterator
from io import BytesIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import audio
from ..functions.hashing import sha256

#: Largest packet of a socket message, and limits of an upload.
PACKET_BYTES, MAX_SECONDS, MAX_BYTES = 262_144, 4 * 3600.0, 512 << 20


def audio_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, content, length, is_wav, facts of the audio files below ``path``; read in parallel, one row a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", "length", audio.is_wav("content").alias("is_wav"), audio.probe_audio("content").alias("facts"))


def decoded(files: DataFrame) -> DataFrame:
    """Mono 16 kHz samples of ``audio_files``; rows that can't be decoded go to ``rejects`` instead (see ``undecodable``)."""
    return files.withColumn("pcm", audio.decode_audio("content")).where("pcm is not null")


def undecodable(files: DataFrame) -> DataFrame:
    """Dead letters of ``decoded``, with the class of error a client would see."""
    bad = files.withColumn("pcm", audio.decode_audio("content")).where("pcm is null")
    return bad.select(F.lit("undecodable-audio").alias("reason"), F.col("path").alias("payload"), F.lit(None).cast("bigint").alias("at_ms"))


def normalised(files: DataFrame, max_seconds: float = MAX_SECONDS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """WAV files within the limits of length and size, as mono 16 kHz WAV; the result is checked again."""
    fits = files.where((F.col("facts.duration") <= max_seconds) & (audio.wav_estimate(F.col("facts.duration"), F.lit(audio.RATE), F.lit(1)) <= max_bytes))
    out = decoded(fits).withColumn("wav", audio.to_wav("pcm"))
    return out.where(audio.is_wav("wav"))


def frames_of(packets: DataFrame) -> DataFrame:
    """Frames of 640 bytes of each client's packets (client_id, ts, packet_no, pcm) in order; the rest of a capture is its own last row.

    Packets of odd length or over the limit are no frames (``invalid_packets`` has them). Each packet
    is cut where frames begin, at its place in the client's bytes, and a frame is put together from the
    few pieces that it has; no client's bytes are ever one value.
    """
    order = Window.partitionBy("client_id").orderBy("ts", "packet_no").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("pcm").cast("bigint")
    placed = packets.where(valid_packet(F.col("pcm")) & (size > 0)).withColumn("at", F.coalesce(F.sum(size).over(order), F.lit(0)))
    whole = F.lit(audio.FRAME_BYTES)
    frames = F.sequence(F.floor(F.col("at") / whole), F.floor((F.col("at") + size - 1) / whole))
    rows = placed.select("client_id", "at", "pcm", F.explode(frames).alias("frame_no"))
    start, end = F.greatest(F.col("at"), F.col("frame_no") * whole), F.least(F.col("at") + size, (F.col("frame_no") + 1) * whole)
    piece = F.substring("pcm", (start - F.col("at") + 1).cast("int"), (end - start).cast("int"))
    pieces = rows.select("client_id", "frame_no", F.struct(start.alias("at"), piece.alias("pcm")).alias("piece"))
    joined = pieces.groupBy("client_id", "frame_no").agg(F.array_sort(F.collect_list("piece")).alias("p"))
    pcm = F.aggregate("p", F.unhex(F.lit("")), lambda acc, x: F.concat(acc, x["pcm"]))
    return joined.select("client_id", "frame_no", pcm.alias("pcm")).withColumn("partial", F.octet_length("pcm") < audio.FRAME_BYTES)


def valid_packet(pcm: Column) -> Column:
    return (F.octet_length(pcm) <= PACKET_BYTES) & (F.octet_length(pcm) % 2 == 0)


def invalid_packets(packets: DataFrame) -> DataFrame:
    reason = F.when(F.octet_length("pcm") > PACKET_BYTES, "pcm-message-too-large").otherwise("pcm16-odd-byte-count")
    return packets.where(~valid_packet(F.col("pcm"))).select(reason.alias("reason"), F.hex("pcm").alias("payload"), F.lit(None).cast("bigint").alias("at_ms"))


#: A nested report of cases.
REPORT = "assets array<struct<asset:string,cases:array<struct<label:string,char_count:int,text:string>>>>"


def golden_snippets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.GOLDEN_SNIPPET).json(path)


def nested_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a nested JSON report (assets → cases), those whose label ends in a length."""
    return cases_of(spark.read.schema(REPORT).json(path, multiLine=True))


def cases_of(report: DataFrame) -> DataFrame:
    """Rows (asset, label, char_count, text) of nested reports, those whose label ends in a length."""
    cases = report.select(F.explode("assets").alias("a")).select("a.asset", F.explode("a.cases").alias("c"))
    return cases.select("asset", "c.label", "c.char_count", "c.text").where(F.col("label").rlike("/(30s|2m|4m)$"))


def config(spark: SparkSession, path: str) -> DataFrame:
    """A TOML file's sections as rows (section, key, value); raises if it is empty. One file, read by the driver through Spark."""
    files = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(files) > 1:
        raise ValueError(f"{path} is not one file")
    settings = tomllib.loads(files[0].value) if files else {}
    top = {k: v for k, v in settings.items() if not isinstance(v, dict)}
    sections = {"": top} | {k: v for k, v in settings.items() if isinstance(v, dict)}
    rows = [(section, k, str(v)) for section, part in sections.items() for k, v in part.items()]
    if not rows:
        raise ValueError(f"no settings in {path}")
    return spark.createDataFrame(rows, "section string, key string, value string")


def requests(rows: DataFrame) -> DataFrame:
    """Request table with defaults; a request without a file is refused, unknown columns are ignored."""
    known = {"file": "binary", "model": "string", "language": "string", "response_format": "string"}
    cols = [(F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in known.items()]
    out = rows.select("request_id", *cols)
    return out.withColumn("response_format", F.coalesce("response_format", F.lit("json"))).where(F.coalesce(F.octet_length("file"), F.lit(0)) > 0)


def archive_members(files: DataFrame) -> DataFrame:
    """archive, member, content of the regular files in tar archives (path, content), compressed or not; an archive that
    can't be read is one row with ``error``. One archive at a time is unpacked by a task."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                try:
                    with tarfile.open(fileobj=BytesIO(bytes(content))) as archive:
                        for member in archive:
                            if member.isfile():
                                rows.append((path, member.name, archive.extractfile(member).read(), None))
                except (tarfile.TarError, EOFError, OSError, TypeError) as e:
                    rows.append((path, None, None, type(e).__name__))
                yield pd.DataFrame(rows, columns=["archive", "member", "content", "error"])

    return files.select("path", "content").mapInPandas(work, "archive string, member string, content binary, error string")


def extracted(wanted: DataFrame, members: DataFrame) -> DataFrame:
    """Each wanted member (archive, member, sha256) with what the archives hold: found, missing or corrupted, and its content if it is right."""
    held = members.where("member is not null").select("archive", "member", "content", sha256(F.col("content")).alias("_actual"))
    state = F.when(F.col("_actual").isNull(), "missing").when(F.col("_actual") == F.col("sha256"), "found").otherwise("corrupted")
    both = wanted.join(held, ["archive", "member"], "left").withColumn("state", state)
    return both.withColumn("content", F.when(F.col("state") == "found", F.col("content"))).drop("_actual")


def verb_map(lines: DataFrame) -> DataFrame:
    """key, verb of lines ``w1_w2:t1_t2`` (columns: line_no, value): key ``w1_t1_t2``, verb w2; the first line of a key wins.

    Lines of another form are left out.
    """
    found = lambda n: F.regexp_extract("value", r"^([^:_]*)_([^:]*):([^_]*)_(.*)$", n)
    rows = lines.where(F.col("value").rlike(r"^[^:_]*_[^:]*:[^_]*_")).select("line_no", F.concat_ws("_", found(1), found(3), F.trim(found(4))).alias("key"), found(2).alias("verb"))
    return rows.groupBy("key").agg(F.min_by("verb", "line_no").alias("verb"))


def verb_decode_map(spark: SparkSession, path: str) -> dict[str, str]:
    """A verb file as a dictionary for ``align.apply_edits``: a vocabulary, which its language bounds."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return {r.key: r.verb for r in verb_map(lines).collect()}


def asset_status(lock: DataFrame, files: DataFrame) -> DataFrame:
    """Each entry of the lock with its file: missing, valid or corrupted (then with the hash that was found)."""
    actual = files.select(F.col("path"), sha256(F.col("content")).alias("actual_sha256"))
    status = F.when(F.col("actual_sha256").isNull(), "missing").when(F.col("actual_sha256") == F.col("sha256"), "valid").otherwise("corrupted")
    return lock.join(actual, "path", "left").select("id", "path", F.struct(status.alias("kind"), F.when(status == "corrupted", F.col("actual_sha256")).alias("actual_sha256")).alias("status"))


def write_rejects(rejects: DataFrame, path: str) -> None:
    """Dead letters, by reason: what was captured is never dropped."""
    rejects.write.mode("append").partitionBy("reason").parquet(path)


def write_segments(segments: DataFrame, path: str) -> None:
    """Samples and WAV file of each segment in one row, so that both are committed or neither."""
    segments.withColumn("wav", audio.to_wav("pcm")).write.mode("append").parquet(path)


def orphans(spool: DataFrame, committed: DataFrame) -> DataFrame:
    """Files of the spool that no committed segment names: what recovery after a crash must look at."""
    return spool.join(committed.select("segment_id"), "segment_id", "left_anti")


def publish(events: DataFrame, clients: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str):
    """A stream of events (room, type, payload) to each client of its room, batch by batch."""

    def batch(rows: DataFrame, number: int) -> None:
        send(rows.join(clients.where("not closing"), "room").select("client_id", "room", "type", "payload"), number)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
