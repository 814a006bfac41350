"""PCM bytes: framing, levels, WAV headers, slices, resampling. Audio stays binary; samples are never exploded to rows."""

from __future__ import annotations

from collections.abc import Sequence

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATE, SAMPLE_BYTES = 16_000, 2
BYTES_PER_SECOND = RATE * SAMPLE_BYTES
FRAME_MS, FRAME_BYTES = 20, 640


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bytes_to_ms(n: Column) -> Column:
    """Whole milliseconds of so many bytes."""
    return F.floor(n * 1000 / BYTES_PER_SECOND).cast("bigint")


def levels(pcm: bytes | None) -> tuple[float, float]:
    """Root mean square and peak of 16-bit samples, as shares of full scale; 0 for nothing."""
    samples = np.frombuffer((pcm or b"")[: len(pcm or b"") // 2 * 2], "<i2").astype(np.float64) / 32768.0
    return (float(np.sqrt(np.mean(samples * samples))), float(np.abs(samples).max())) if len(samples) else (0.0, 0.0)


def pcm_stats(pcm: Column | str) -> Column:
    """(rms, peak) of a binary column."""

    @F.pandas_udf("struct<rms:double,peak:double>")
    def run(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([levels(x) for x in column], columns=["rms", "peak"])

    return run(_col(pcm))


def wav_bytes(pcm: bytes) -> bytes:
    """A mono 16 kHz WAV file of the samples; an odd last byte is dropped."""
    data = pcm[: len(pcm) // 2 * 2]
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, RATE, BYTES_PER_SECOND, 2, 16, b"data", len(data))
    return head + data


def to_wav(pcm: Column | str) -> Column:
    """As ``wav_bytes``, from column functions alone."""
    data = F.substring(_col(pcm), F.lit(1), (F.floor(F.octet_length(_col(pcm)) / 2) * 2).cast("int"))
    size = F.octet_length(data)

    def little(n: Column) -> Column:
        digits = F.lpad(F.hex(n.cast("bigint")), 8, "0")
        return F.unhex(F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)]))

    fixed = lambda b: F.unhex(F.lit(b.hex()))
    middle = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, BYTES_PER_SECOND, 2, 16) + b"data"
    return F.concat(fixed(b"RIFF"), little(size + 36), fixed(middle), little(size), data)


def is_wav(content: Column | str) -> Column:
    c = _col(content)
    return (F.octet_length(c) >= 44) & (F.hex(F.substring(c, 1, 4)) == "52494646") & (F.hex(F.substring(c, 9, 4)) == "57415645")


def probe(data: bytes | None) -> dict | None:
    """Container facts of a WAV file: duration, codec, rate, channels, data offset; None if it isn't one."""
    data = data or b""
    if len(data) < 44 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, facts = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = at + 8
        if name == b"fmt " and size >= 16:
            tag, channels, rate, _, align, bits = struct.unpack("<HHIIHH", data[body : body + 16])
            facts = {"codec": {1: f"pcm_s{bits}le", 3: f"pcm_f{bits}le"}.get(tag, f"tag_{tag}"), "sample_rate": rate, "channels": channels, "align": align}
        elif name == b"data" and facts and facts["align"] and facts["sample_rate"]:
            size = min(size, len(data) - body)
            frames = size // facts.pop("align")
            return facts | {"duration": frames / facts["sample_rate"], "data_offset": body, "data_bytes": size}
        at = body + size + size % 2
    return None


PROBE = "struct<duration:double,codec:string,sample_rate:int,channels:int,data_offset:int,data_bytes:int>"


def probe_audio(content: Column | str) -> Column:
    @F.pandas_udf(PROBE)
    def run(column: pd.Series) -> pd.DataFrame:
        names = ["duration", "codec", "sample_rate", "channels", "data_offset", "data_bytes"]
        return pd.DataFrame([probe(x) or dict.fromkeys(names) for x in column], columns=names)

    return run(_col(content))


def _samples(data: bytes, codec: str) -> np.ndarray | None:
    """Samples of a WAV file's data on the scale of 16-bit ones; None for a codec that isn't known."""
    whole = lambda size: data[: len(data) // size * size]
    if codec == "pcm_s16le":
        return np.frombuffer(whole(2), "<i2").astype(np.float64)
    if codec == "pcm_s8le":  # 8-bit WAV samples are unsigned
        return (np.frombuffer(data, np.uint8).astype(np.float64) - 128) * 256
    if codec == "pcm_s24le":
        b = np.frombuffer(whole(3), np.uint8).reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float64) / 256
    if codec == "pcm_s32le":
        return np.frombuffer(whole(4), "<i4").astype(np.float64) / 65536
    if codec in ("pcm_f32le", "pcm_f64le"):
        kind = "<f4" if codec == "pcm_f32le" else "<f8"
        return np.nan_to_num(np.frombuffer(whole(int(kind[-1])), kind).astype(np.float64)) * 32768
    if codec in ("tag_6", "tag_7"):  # logarithmic telephone codecs, A-law and mu-law
        x = np.frombuffer(data, np.uint8).astype(np.int32)
        if codec == "tag_7":
            x = ~x & 0xFF
            size = (((x & 15) << 3) + 132 << (x >> 4 & 7)) - 132
            return np.where(x & 0x80, -size, size).astype(np.float64)
        x = x ^ 0x55
        power = x >> 4 & 7
        size = np.where(power == 0, (x & 15) << 4 | 8, ((x & 15) << 4 | 0x108) << np.maximum(power - 1, 0))
        return np.where(x & 0x80, size, -size).astype(np.float64)
    return None


def decode_wav(data: bytes | None) -> bytes | None:
    """Mono 16 kHz samples of a WAV file (channels averaged, linear resampling): integer samples of 8 to 32 bits,
    floating point, A-law and mu-law; None for other codecs."""
    facts = probe(data)
    raw = facts and _samples(data[facts["data_offset"] : facts["data_offset"] + facts["data_bytes"]], facts["codec"])
    if raw is None:
        return None
    raw = raw[: len(raw) // facts["channels"] * facts["channels"]].reshape(-1, facts["channels"]).mean(axis=1)
    if facts["sample_rate"] != RATE and len(raw):
        raw = resample(raw, facts["sample_rate"], RATE)
    return np.clip(np.floor(raw + 0.5), -32768, 32767).astype("<i2").tobytes()


def decode_audio(content: Column | str) -> Column:
    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        return column.map(decode_wav)

    return run(_col(content))


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation at fractional read positions."""
    at = np.arange(0, len(x) * to // rate) * (rate / to)
    return np.interp(at, np.arange(len(x)), x)


def resample_pcm(samples: Column | str, rate: int, to: int = RATE) -> Column:
    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: resample(np.asarray(x, float), rate, to).tolist())

    return run(_col(samples))


def resampled_packets(packets: DataFrame, keys: Sequence[str], order: str, rate: int, to: int = RATE) -> DataFrame:
    """``packets`` (keys, ``order``, samples array<double>) with ``out``: the samples at the rate ``to`` that each packet completes.

    The result is that of one resampler that carries its read position over all packets of a key: the
    position of output k is k * rate / to, so a packet needs only how many samples came before it and the
    last of them. Output k belongs to the packet that holds the sample after that position.
    """
    n = F.size("samples")
    w = Window.partitionBy(*keys).orderBy(order)
    some = packets.where(n > 0).withColumn("_before", F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    some = some.withColumn("_last", F.lag(F.element_at("samples", -1)).over(w))
    # Samples from the one before the packet on; its place among all is _from.
    some = some.withColumn("_seen", F.when(F.col("_before") > 0, F.concat(F.array("_last"), F.col("samples"))).otherwise(F.col("samples")))
    some = some.withColumn("_from", F.greatest(F.lit(0), F.col("_before") - 1))
    first = F.ceil(F.col("_from") * to / rate)
    last = F.ceil((F.col("_before") + n - 1) * to / rate) - 1

    def sample(k: Column) -> Column:
        at = F.floor(k * rate / to)
        i = (at - F.col("_from") + 1).cast("int")
        a, b = F.element_at("_seen", i), F.element_at("_seen", i + 1)
        return a + (b - a) * ((k * rate) % to / to)

    ks = F.when(last >= first, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<bigint>"))
    done = some.withColumn("out", F.transform(ks, sample)).drop("_before", "_last", "_seen", "_from")
    return done.unionByName(packets.where(n == 0).withColumn("out", F.array().cast("array<double>")))


def quantise(x: Column) -> Column:
    """A float sample as 16-bit integer: clamped to 1, scaled by 32768 below zero and 32767 above, halves up."""
    x = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    return F.floor(F.when(x < 0, x * 32768).otherwise(x * 32767) + 0.5).cast("int")


def slice_pcm(pcm: Column, start_s: Column, seconds: Column) -> Column:
    """The samples from ``start_s`` on, ``seconds`` long."""
    at = (F.floor(start_s * RATE) * 2 + 1).cast("int")
    return F.substring(pcm, at, (F.floor(seconds * RATE) * 2).cast("int"))


#: Most of a voice that an embedding looks at (fixed value).
MOST_S = 8


def collect_samples(pcm: Column | str, ranges: Column | str, most: int = MOST_S * RATE) -> Column:
    """The samples of ``ranges`` (array of (start, end) in samples) one after the other: each held to what there is, ``most`` in all."""
    data, n = _col(pcm), F.floor(F.octet_length(_col(pcm)) / 2)
    zero = F.unhex(F.lit(""))

    def add(acc: Column, r: Column) -> Column:
        start = F.greatest(F.lit(0), F.least(r["start"], n))
        count = F.least(F.greatest(start, F.least(r["end"], n)) - start, F.lit(most) - F.floor(F.octet_length(acc) / 2))
        return F.when(count <= 0, acc).otherwise(F.concat(acc, F.substring(data, (start * 2 + 1).cast("int"), (count * 2).cast("int"))))

    return F.aggregate(_col(ranges), zero, add)


def pad_for_decoder(samples: Column, least: int = RATE) -> Column:
    """Zeros on both sides, the one more on the right, up to one second."""
    missing = F.greatest(F.lit(0), F.lit(least) - F.size(samples))
    left = F.floor(missing / 2).cast("int")
    zero = F.lit(0.0)
    return F.concat(F.array_repeat(zero, left), samples, F.array_repeat(zero, missing.cast("int") - left))


def wav_estimate(duration: Column, rate: Column, channels: Column) -> Column:
    """Bytes of a 16-bit WAV file of so long; null if that isn't finite."""
    size = F.ceil(duration * rate * channels * 2) + 44
    return F.when(duration.isNull() | F.isnan(duration) | (F.abs(duration) == float("inf")), None).otherwise(size)


def parse_seconds(text: Column) -> Column:
    """A finite, non-negative number, else null."""
    x = F.expr(f"try_cast({text} as double)") if isinstance(text, str) else text.try_cast("double")
    return F.when((x >= 0) & ~F.isnan(x) & (x < float("inf")), x)


def frames_after(remainder: int, packet: int) -> tuple[int, int]:
    """Whole frames and the bytes left over once a packet has come."""
    return divmod(remainder + packet, FRAME_BYTES)
