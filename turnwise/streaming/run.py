"""Streams over tables that are there: all that is there goes through, and what comes out is a table."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the session's ``spark.checkpoint.dir``, which all executors see; a folder of our own only where all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        return tempfile.mkdtemp(prefix="turnwise-stream-")
    return f"{named}/stream-{uuid4().hex}"


def as_stream(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream; the table may be a folder or a single file, which only a pattern names for a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def finished(out: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows that an appending stream gives for all that its source holds now.

    Rows that wait for the watermark to pass them stay in the state, as the source may go on.
    """
    folder = folder or shared_folder(out.sparkSession)
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return out.sparkSession.read.schema(out.schema).parquet(f"{folder}/out")
