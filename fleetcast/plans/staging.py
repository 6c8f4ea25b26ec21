"""Cutting lineage through the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Part files up to so many are broadcast; more join by a shuffle.
BROADCAST_FILES = 100_000
#: Folders written by ``materialize``, one list for each open ``scratch``.
_OPEN: list[list[str]] = []
#: With it a query's shuffle files go as it ends; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where the session names none and runs on one machine (tests)."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="fleetcast-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def write(df: DataFrame, path: str) -> None:
    """``df`` as Parquet. What its plan shuffled is deleted then, so a chain of writes holds the shuffles of one of them."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    Later reads don't run its plan again, prune columns, and survive the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    write(df, path)
    if _OPEN:
        _OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what ``materialize`` wrote inside; results must have been written elsewhere by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            delete(spark, path)


def table_positions(table: DataFrame, name: str = "position") -> DataFrame:
    """``table``, read from Parquet, with each row's place in it (gapless from 0): by number of the part file, then by row.

    So an order that a sorted write left in a table can be read back, which plain reads don't promise.
    """
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    part = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"part-(\d+)", 1).try_cast("long")
    rows = table.select("*", F.struct(part.alias("part"), path.alias("path")).alias("_file"), row.alias("_at"))
    # A row for each file, so one task can sum them up.
    files = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = files.select(F.col("_file").alias("_f"), before.alias("_before"))
    if files.count() <= BROADCAST_FILES:
        files = F.broadcast(files)
    return rows.join(files, F.col("_file") == F.col("_f")).select(*table.columns, (F.col("_before") + F.col("_at")).cast("long").alias(name))
