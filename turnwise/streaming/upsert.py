"""A table of the newest row of each key, kept by a stream, that survives batches which are run again.

Keys are dealt to buckets; a batch rewrites only the buckets that its rows touch, each as a new
version, and then publishes one manifest that names the version of every bucket. A batch that is run
again starts from the manifests of batches before it, so it writes the same once more. Rows of
versions that no manifest names are never seen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BUCKETS = 64
_MANIFEST = "bucket int, version long, batch long"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The version of each bucket after the last batch, or after the last one before ``before``: BUCKETS rows at most."""
    if not _exists(spark, f"{path}/manifests"):
        return {}
    rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifests")
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    last = rows.agg(F.max("batch")).first()[0]
    return {} if last is None else {r.bucket: r.version for r in rows.where(F.col("batch") == last).collect()}


def _bucket(keys: Sequence[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _rows(spark: SparkSession, path: str, schema, versions: dict[int, int]) -> DataFrame | None:
    folders = [f"{path}/rows/bucket={b}/version={v}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else None


def table(spark: SparkSession, path: str, schema) -> DataFrame:
    """What the table holds now."""
    rows = _rows(spark, path, schema, _versions(spark, path))
    return spark.createDataFrame([], schema) if rows is None else rows


def merge(batch: DataFrame, number: int, path: str, keys: Sequence[str], revision: str, buckets: int = BUCKETS) -> None:
    """One batch: rows with a higher ``revision`` than their key's take its place, of equal revisions the one that was there stays."""
    spark, schema = batch.sparkSession, batch.schema
    new = batch.withColumn("_bucket", _bucket(keys, buckets)).persist()
    touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())
    before = _versions(spark, path, number)
    old = _rows(spark, path, schema, {b: before[b] for b in touched if b in before})
    both = new.withColumn("_age", F.lit(1))
    if old is not None:
        both = both.unionByName(old.withColumn("_bucket", _bucket(keys, buckets)).withColumn("_age", F.lit(0)))
    newest = Window.partitionBy(*keys).orderBy(F.desc(revision), "_age", *[c for c in schema.names if c not in (*keys, revision)])
    kept = both.withColumn("_place", F.row_number().over(newest)).where("_place = 1").drop("_place", "_age").persist()
    for b in touched:
        kept.where(F.col("_bucket") == b).drop("_bucket").write.mode("overwrite").parquet(f"{path}/rows/bucket={b}/version={number}")
    after = before | dict.fromkeys(touched, number)
    spark.createDataFrame([(b, v) for b, v in after.items()], "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/batch={number}")
    new.unpersist()
    kept.unpersist()


def upsert(stream: DataFrame, path: str, keys: Sequence[str], revision: str, buckets: int = BUCKETS, **trigger) -> StreamingQuery:
    """``merge`` for each batch of a stream; ``path`` must be seen by all executors and holds the checkpoint too."""

    def each(batch: DataFrame, number: int) -> None:
        merge(batch, number, path, keys, revision, buckets)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(**trigger) if trigger else writer).start()
