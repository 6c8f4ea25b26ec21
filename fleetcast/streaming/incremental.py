"""Incremental forms of stock and flow: new files are added to running state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcast.operators.stock import KEYS, RSD_16, merge_sketches, stock_sketches
from fleetcast.streaming.buckets import merge_into_buckets, read_buckets


def stream_stock(rows: DataFrame, keys: list[str], vin: str, rsd: float = RSD_16) -> DataFrame:
    """Approximate distinct vehicles by ``keys`` of a stream (or a table)."""
    return rows.groupBy(*keys).agg(F.approx_count_distinct(vin, rsd).alias("approx_unique_vins"))


def stream_first_seen(rows: DataFrame, region: str = "region", vin: str = "vin", period: str = "period") -> DataFrame:
    """First snapshot of each (region, vehicle); the minimum doesn't depend on the order of arrival."""
    return rows.groupBy(region, vin).agg(F.min(period).alias("snapshot_id"))


def stream_first_arrival(rows: DataFrame, keys: list[str], watermark: tuple[str, str] | None = None) -> DataFrame:
    """The first arrival of each key. With a watermark (column, delay) keys are forgotten after it, which bounds the state; without, it
    holds every key, as a table of first arrivals does."""
    if watermark:
        return rows.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys)
    return rows.dropDuplicates(keys)


def upsert_min(path: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the least snapshot by (region, vin) in the buckets at ``path``.

    The stream needs no state of its own: its rows (region, vin, snapshot_id) go in as they come, in any order and number of
    batches.
    """
    return merge_into_buckets(path, ["region", "vin"], [F.min("snapshot_id").alias("snapshot_id")], buckets)


def merge_stock_sketches(path: str, lg_k: int = 16, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps one sketch of vehicles by (region, group, metric) in the buckets at ``path``.

    A batch of enriched rows is sketched in its tasks, and its few sketches are united with the stored ones of the same keys.
    Buckets go by period, since a batch brings few of them: all others' sketches stay as they are. Unions don't depend on
    order or batches, and a vehicle that comes again changes nothing.
    """
    merge = merge_into_buckets(path, KEYS, [F.hll_union_agg("sketch").alias("sketch")], buckets, ["group"])

    def write(batch: DataFrame, epoch: int) -> None:
        merge(stock_sketches(batch, lg_k), epoch)

    return write


def read_stock_sketches(spark: SparkSession, path: str, group: str = "int") -> DataFrame:
    """(region, group, metric, approx_unique_vins) of the stored sketches."""
    return merge_sketches(read_buckets(spark, path, f"region string, `group` {group}, metric string, sketch binary"), KEYS)


def write_versions(path: str, columns: list[str]):
    """A foreachBatch function that writes each batch as a version of its own; one that runs again replaces its version."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.select(*columns).write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return write


def run_available(df: DataFrame, write: Callable[[DataFrame, int], None], mode: str, checkpoint: str, seen: list | None = None) -> list[int]:
    """Runs all that is available, batch by batch through ``write`` on the executors, and returns the batches' numbers.

    ``seen`` gets the progress reports of the run, with rows read and rows held as state.
    """
    epochs: list[int] = []

    def noted(batch: DataFrame, epoch: int) -> None:
        write(batch, epoch)
        epochs.append(epoch)

    run = df.writeStream.foreachBatch(noted).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    if seen is not None:
        seen.extend(run.recentProgress)
    return epochs


def read_arrivals(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """The Parquet files below ``path`` as a stream, oldest first, at most ``files`` in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(path)
