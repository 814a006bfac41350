"""A corpus from raw documents to tokens, in stages that each work on all that the one before kept."""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import bpe, mixing, pii, quality, simhash
from turnwise.llm.common import shared_folder, table


# What holds for every stage: of an empty table the result is empty; all columns stay under their names, whatever others
# there are; texts are read whole, however long; a null doc_id or source is a value like any other.


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps.

    Null and blank texts go. Repeated rows are judged alike, as the draw depends on id and text only.
    """
    return quality.selected(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the least id, a null id last.

    Copies are told by the rule of the SimHash operator: fingerprints of four-word shingles that differ in at most
    four bits (README has how alike two texts then are). Of repeated rows one stays; null and blank texts are one class.
    """
    return simhash.survivors(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked; n_chars counts the new text. Null texts stay null (and n_chars with them); rows stay as many as they are."""
    return pii.masked(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: sources near their target numbers of words.

    Null sources are one source; texts without a word are not taken. Ties are drawn by a hash of the id, so reruns agree.
    """
    return mixing.copied(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 32-bit little-endian), and digests of the ids and of what they decode to.

    A null text has no ids. Repeated rows are encoded as often as they come.
    """
    coded = bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: Bigram hashing, connected components and merge tables are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. Each result but the last is written as Parquet and read again.

    The files are in the session's ``spark.checkpoint.dir``, in a folder of the run. Each goes as
    soon as the next stage is written; those that the result is computed from stay.
    """
    docs, here = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{here}/{i}-{name}")
        docs = spark.read.parquet(f"{here}/{i}-{name}")
        if i:
            _remove(spark, f"{here}/{i - 1}-{STAGES[i - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
