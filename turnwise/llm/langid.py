"""Language identification by compression with one zstandard dictionary for each language.

A language's dictionary is raw content: training texts of that language, end to end. A text is
compressed with each dictionary, and the language of the smallest result wins. The score is the
margin to the second smallest as a share of it; a text whose margin is narrow is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, give_back

#: Training documents looked at for each language (one of each hash bucket), and bytes of its dictionary.
SAMPLE, DICTIONARY = 400, 48 << 10
LEVEL = 12
#: Bytes as they are compressed: lower case, and spaces for ASCII characters that aren't letters.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Least score that isn't rejected.
NARROW = 0.02
#: Languages whose dictionaries are collected, or whose compressors a task holds, together. All are learned and tried.
TOGETHER = 64


def plain(text: str) -> bytes:
    """The whole text without case, digits and punctuation, which tell nothing of its language."""
    return b" ".join(text.lower().encode("utf-8").translate(_LETTERS).split())


def dictionaries(training: DataFrame) -> dict[str, bytes]:
    """A dictionary for each language of ``training`` (doc_id, text, lang).

    At most ``SAMPLE`` documents of a language are looked at, one of each bucket of a hash of
    the id, so what comes to the driver is bounded. Whole texts are taken as long as they fit; only
    where not one fits does the beginning of the first serve.
    """
    named = training.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    # One document of each language and bucket: summed up before the shuffle, so no language is one task's work.
    at = F.xxhash64("doc_id")
    sample = named.groupBy("lang", F.pmod(at, F.lit(SAMPLE)).alias("place")).agg(F.min_by("doc_id", F.struct(F.xxhash64(at), "doc_id")).alias("doc_id"), F.count("*").alias("n"))
    sample = cut(sample)
    upto = Window.partitionBy("lang").orderBy("place", "text").rowsBetween(Window.unboundedPreceding, -1)
    out: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    first: dict[str, bytes] = {}
    langs = sorted(r.lang for r in sample.select("lang").distinct().collect())
    for at in range(0, len(langs), TOGETHER):
        # SAMPLE ids of each of TOGETHER languages at most: few enough to broadcast, so no text is shuffled to find them.
        ids = sample.where(F.col("lang").isin(langs[at : at + TOGETHER])).select("lang", "doc_id", "place")
        texts = named.join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "place", F.substring("text", 1, DICTIONARY).alias("text"), (F.length("text") <= DICTIONARY).alias("whole"))
        # Of those, as many as fill a dictionary a few times over.
        texts = texts.withColumn("before", F.coalesce(F.sum(F.length("text")).over(upto), F.lit(0))).where(F.col("before") <= 4 * DICTIONARY)
        for row in sorted(texts.collect(), key=lambda r: (r.lang, r.place, r.text)):
            data = plain(row.text) + b"\n"
            first.setdefault(row.lang, data[:DICTIONARY])
            if row.whole and sizes.get(row.lang, 0) + len(data) <= DICTIONARY:
                sizes[row.lang] = sizes.get(row.lang, 0) + len(data)
                out.setdefault(row.lang, []).append(data)
    return {lang: b"".join(out.get(lang, [first[lang]])) for lang in sorted(first)}


def predicted(docs: DataFrame, learned: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), rejected of each row, from its text alone.

    ``und`` with score 0 for texts that are null or have no letter, or if nothing was learned.
    With a single language learned the score is 1. Ties go to the first language by code point.
    Texts are read whole, however long; null ids stay; repeated rows are judged alike; other columns
    are left out. Of an empty table the result is empty.
    """

    names = sorted(learned)

    def compressors(part: list[str]) -> list[zstandard.ZstdCompressor]:
        out = []
        for lang in part:
            content = zstandard.ZstdCompressionDict(learned[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = compressors(names[:TOGETHER])
        for batch in batches:
            texts = [None if not any(map(str.isalpha, text)) else plain(text) for item in batch.column("text") for text in [item.as_py() or ""]]
            best: list[list[tuple[int, int]]] = [[] for _ in texts]
            for at in range(0, len(names), TOGETHER):
                tools = kept if at == 0 else compressors(names[at : at + TOGETHER])
                for found, data in zip(best, texts, strict=True):
                    if data is not None:
                        found[:] = sorted([*found, *((len(tool.compress(data)), at + i) for i, tool in enumerate(tools))])[:2]
            langs = [names[found[0][1]] if found else "und" for found in best]
            scores = [0.0 if not found else 1.0 if len(found) == 1 else (found[1][0] - found[0][0]) / found[1][0] for found in best]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )
            del texts
            give_back()

    out = docs.select("doc_id", "text").mapInArrow(work, "doc_id long, lang_pred string, score double")
    return out.withColumn("rejected", F.col("score") < NARROW)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4 (null ids: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of documents; learned from those not held out."""
    learned = dictionaries(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    out = predicted(docs, learned)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
