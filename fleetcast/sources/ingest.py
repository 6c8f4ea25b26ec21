"""Registration files staged to Parquet, each once, so that later jobs prune columns and never parse text again."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcast.sources.readers import REGISTRATION_FIELDS, flag_short_rows, read_registrations

STAGED = T.StructType([*(T.StructField(c, T.StringType()) for c in REGISTRATION_FIELDS), T.StructField("short_row", T.BooleanType()), T.StructField("file", T.StringType())])


def read_staged(spark: SparkSession, target: str) -> DataFrame:
    """All rows staged at ``target``: the nine fields, ``short_row`` and the ``file`` they came from."""
    return spark.read.schema(STAGED).parquet(target)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _name(uri: str) -> str:
    """One spelling of a file's address: Spark writes local ones with one slash or with three, and escapes both."""
    return unquote(re.sub(r"^file:/+", "file:/", uri))


def ingest_registrations(spark: SparkSession, paths: str | list[str], target: str) -> int:
    """Appends the rows of all files at ``paths`` (folders, files, globs) that ``target`` doesn't hold yet; returns how many files were new.

    Fields are counted here, once, which is why this scan reads all columns. A file counts as held if any row of it is, so a
    file must not grow after it was taken; an empty one is looked at each time. File names meet on the driver, as they do for any
    scan; which are held is read from one pruned column of the staged table.
    """
    listed = read_registrations(spark, paths).inputFiles()
    held: set[str] = set()
    if _exists(spark, target):
        held = {_name(r["file"]) for r in read_staged(spark, target).select("file").distinct().collect()}
    new = sorted({_name(f) for f in listed} - held)
    if new:
        flag_short_rows(read_registrations(spark, new)).select(*REGISTRATION_FIELDS, "short_row", "file").write.mode("append").parquet(target)
    return len(new)


def rows_by_file(staged: DataFrame) -> DataFrame:
    """(file, rows, short_rows) of a staged table, from two of its columns."""
    return staged.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.count_if("short_row").alias("short_rows"))
