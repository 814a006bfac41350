"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the session's ``spark.checkpoint.dir``, which all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. A folder of our own stands in for it only where all runs on one
    machine, as in tests; elsewhere executors would not see it."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="turnwise-checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def give_back() -> None:
    """Returns the memory of Arrow batches that are done with; an idle worker would keep it."""
    pa.default_memory_pool().release_unused()


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer parts than there are cores, dealt out over all of them.

    A file of one row group is one task, however many cores wait. Tables of more parts, as all large
    ones are, stay as they are and aren't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def unused(names: list[str], name: str) -> str:
    """``name``, or the first of its numbered forms that no column has."""
    taken = {n.lower() for n in names}
    return next(n for i in range(len(taken) + 1) if (n := f"{name}_{i}" if i else name).lower() not in taken)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` also changes letters beyond ASCII.

    ``lower`` is several times faster than ``translate``, so it serves wherever both agree:
    texts without a letter or symbol beyond ASCII that has a lower-case form.
    """
    beyond = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^\x00-\x7F]]"
    return F.when(text.rlike(beyond), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def word_count(text: Column) -> Column:
    """Number of runs of anything but white space; null counts 0."""
    inner = trimmed(text)
    return F.when(text.isNull() | (inner == ""), F.lit(0).cast("long")).otherwise(
        F.size(F.split(inner, SPACES, -1)).cast("long")
    )
