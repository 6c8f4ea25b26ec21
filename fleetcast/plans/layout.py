"""Enriched registrations laid out for everything that groups by vehicle: buckets of the VIN, partitions of the period.

First-seen counts, EV flags and exact stock group by the VIN or by keys that contain it. Read from buckets of the VIN they
are aggregated where they lie, and a join of two of them needs no shuffle either; a filter on periods reads only their folders.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcast.plans.staging import shared_dir


def write_by_vehicle(enriched: DataFrame, buckets: int, name: str | None = None) -> str:
    """Writes ``enriched`` (region, vin, period, vin_key, is_ev) as a table with ``buckets`` buckets of ``vin`` by ``period``; returns its name.

    One shuffle brings each bucket's rows together, so a period has one file for each bucket and no more. A bucket is a task
    of every later job: take as many as the largest period set needs tasks. The files lie in the shared folder; the name is
    known to this session's catalog, and dropping it leaves them. Null VINs (there are none after enriching) are a bucket's rows
    like others.
    """
    spark = enriched.sparkSession
    name = name or f"by_vehicle_{uuid.uuid4().hex}"
    # The hash that buckets use, so that a task writes into one bucket only.
    dealt = enriched.repartition(buckets, "vin")
    dealt.write.partitionBy("period").bucketBy(buckets, "vin").sortBy("vin").option("path", f"{shared_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    return name


def read_by_vehicle(spark: SparkSession, name: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The table, or its periods from ``first`` to ``last``; others' folders are not read."""
    rows = spark.table(name)
    if first is not None:
        rows = rows.where(F.col("period") >= first)
    return rows.where(F.col("period") <= last) if last is not None else rows
