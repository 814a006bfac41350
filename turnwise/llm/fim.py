"""Fill-in-the-middle by bit-parallelism on big integers.

``bytes.translate`` turns a text's bytes into the digits of a class mask, one bit a byte. Shifted
boolean operations on whole masks mark where units begin, ``bit_count`` gives their number, and the
byte at which a unit begins is found by halving the mask until one bit is left. Code points are
counted in the same way, as the bytes that begin one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What the draws of a document are hashed with, documents of 100 that are transformed, and those of them with the suffix first.
SEED, RATE, SUFFIX_FIRST = 7, 100, 50
#: Bytes of output that a task hands on together.
BATCH = 4 << 20

_LINE_ENDS = bytes(49 if b == 10 else 48 for b in range(256))
_FIRST_BYTES = bytes(48 if 0x80 <= b < 0xC0 else 49 for b in range(256))


def mask(data: bytes, table: bytes) -> int:
    """A bit for each byte, the first one lowest: 1 where ``table`` has the digit 1."""
    return int(data.translate(table)[::-1], 2) if data else 0


def unit_starts(data: bytes) -> int:
    """Bits of the bytes at which a line begins: the first one, and each after a line feed."""
    return (mask(data, _LINE_ENDS) << 1 | 1) & ((1 << len(data)) - 1)


def select(bits: int, size: int, k: int) -> int:
    """Place of the k-th (from 0) of the bits that are set, of which there must be more than k."""
    at = 0
    while size > 1:
        half = size >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if k < below:
            bits, size = low, half
        else:
            bits, size, k, at = bits >> half, size - half, k - below, at + half
    return at


def cuts(data: bytes, draws: tuple[int, int]) -> tuple[int, int, int]:
    """(n units, byte after the prefix, byte after the middle) of a text, for two draws."""
    starts = unit_starts(data)
    n = starts.bit_count()
    first, second = sorted(d % (n + 1) for d in draws)
    return n, *(len(data) if k == n else select(starts, len(data), k) for k in (first, second))


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def transformed(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row.

    ``n``: lines of the whole text; ``form``: plain, psm (prefix, suffix, middle) or spm (suffix,
    prefix, middle). ``rate`` of 100 documents are transformed, ``suffix_first`` of 100 of those as
    spm; the draws depend on ``seed`` and the id only, so rows that repeat an id draw alike, and
    a null id draws as one without digits. Null texts count as empty; empty texts, and those that
    hold a marker, are plain, and the counts of code points are null for them. Other columns are left
    out, whatever their names; an empty table gives an empty result. Nothing is shuffled, and a task
    holds one batch of texts at a time.
    """
    markers = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
    p, s, m = markers

    def one(doc_id: int | None, data: bytes) -> tuple:
        h1, h2, h3, h4 = draws(doc_id, seed)
        n, left, right = cuts(data, (h1, h2))
        if not data or h3 % 100 >= rate or any(x in data for x in markers):
            return n, "plain", None, None, data
        first = mask(data, _FIRST_BYTES)
        before = (first & ((1 << left) - 1)).bit_count()
        middle = (first & ((1 << right) - 1)).bit_count() - before
        if h4 % 100 < suffix_first:
            return n, "spm", before, middle, b"".join((s, data[right:], p, data[:left], m, data[left:right]))
        return n, "psm", before, middle, b"".join((p, data[:left], s, data[right:], m, data[left:right]))

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.binary())
            start, size, out = 0, 0, []
            for i in range(batch.num_rows):
                out.append(one(ids[i].as_py(), texts[i].as_py() or b""))
                size += len(out[-1][-1])
                if size >= BATCH or i + 1 == batch.num_rows:
                    columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.slice(start, len(out)), *columns], names)
                    start, size, out = i + 1, 0, []
            give_back()

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = made.mapInArrow(work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; its markers occur once each, as no text with one is transformed."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )
