"""Keyed state of a stream as a table in hash buckets, of which a batch rewrites only those it touches.

    <path>/data/<batch>/bucket=<b>/...   rows of a bucket as that batch left them
    <path>/pointers/<batch>/...          for each bucket, the batch whose rows are current

A pointer is written last and whole, so a batch takes effect at once or not at all; one that is repeated finds its pointer
and changes nothing. Buckets that a batch doesn't touch are neither read nor written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcast.plans.staging import delete


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, target = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def committed(spark: SparkSession, path: str) -> list[int]:
    """Batches whose pointers are whole, in order."""
    found = [int(n) for n in _children(spark, f"{path}/pointers") if n.isdigit()]
    return sorted(n for n in found if "_SUCCESS" in _children(spark, f"{path}/pointers/{n}"))


def pointer(spark: SparkSession, path: str, epoch: int) -> dict[int, int]:
    """Bucket to the batch that holds its rows; as many entries as buckets at most."""
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version long, buckets int").parquet(f"{path}/pointers/{epoch}").where("bucket >= 0").collect()}


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def merge_into_buckets(path: str, keys: list[str], combine: list[Column], buckets: int = 64, bucket_by: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each batch into the table at ``path``.

    ``combine``: aggregates over both the batch's rows and the stored ones, each named as the column that it reads (a least
    value, a union of sketches), so that merging is the same whatever batches the rows came in. ``bucket_by``: the keys that
    choose the bucket (all of them by default); keys that arrive together, such as a period, keep the touched buckets few.
    A bucket is one task, so ``buckets`` should grow with the state. Null keys are keys like others. An empty batch
    moves the pointer and touches nothing.
    """
    bucket = bucket_of(bucket_by or keys, buckets)

    def merged(rows: DataFrame) -> DataFrame:
        # Bucket is among the grouping keys, so one shuffle by it serves the aggregation and the files; it names its task, so no task has two.
        return rows.withColumn("bucket", bucket).repartitionById(buckets, "bucket").groupBy("bucket", *keys).agg(*combine)

    def write(batch: DataFrame, epoch: int) -> None:
        spark, done = batch.sparkSession, committed(batch.sparkSession, path)
        if epoch in done:
            return
        before = pointer(spark, path, max(done)) if done else {}
        incoming = f"{path}/incoming/{epoch}"
        # In each task first, then by key; written, as it is read twice and the batch's source should be read once.
        batch.groupBy(*keys).agg(*combine).withColumn("bucket", bucket).write.mode("overwrite").parquet(incoming)
        came = spark.read.parquet(incoming)
        touched = sorted(r["bucket"] for r in came.select("bucket").distinct().collect())
        rows = came.drop("bucket")
        old = [f"{path}/data/{before[b]}/bucket={b}" for b in touched if b in before]
        if old:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(*old))
        merged(rows).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{epoch}")
        now = before | dict.fromkeys(touched, epoch)
        entries = [(b, v, buckets) for b, v in now.items()] or [(-1, epoch, buckets)]
        spark.createDataFrame(entries, "bucket int, version long, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/pointers/{epoch}")
        delete(spark, incoming)
        _clean(spark, path, epoch, now, before)

    return write


def _clean(spark: SparkSession, path: str, epoch: int, now: dict[int, int], before: dict[int, int]) -> None:
    """What neither this batch's pointer nor the one before needs is deleted: readers of the last state may still be at work."""
    for old in committed(spark, path)[:-2]:
        delete(spark, f"{path}/pointers/{old}")
    for version in _children(spark, f"{path}/data"):
        held = {b for b, v in [*now.items(), *before.items()] if v == int(version)}
        for name in _children(spark, f"{path}/data/{version}"):
            if name.startswith("bucket=") and int(name.split("=")[1]) not in held:
                delete(spark, f"{path}/data/{version}/{name}")
        if not held and int(version) != epoch:
            delete(spark, f"{path}/data/{version}")


def read_buckets(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table as the last whole batch left it: each bucket from its current version."""
    done = committed(spark, path)
    current = pointer(spark, path, max(done)) if done else {}
    folders = [f"{path}/data/{v}/bucket={b}" for b, v in current.items()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
