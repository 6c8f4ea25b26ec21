"""Streams over several batches: state in buckets, sketches united batch by batch, bounded state with late and repeated rows."""

import datetime as dt
import pathlib

import pytest
from fleetcast.operators.stock import stock_counts
from fleetcast.streaming import incremental as T
from fleetcast.streaming.buckets import committed, merge_into_buckets, pointer, read_buckets
from pyspark.sql import functions as F

SEEN = "region string, vin string, snapshot_id int"


def files_of(path):
    """Data files with their times, by bucket."""
    found = {}
    for f in pathlib.Path(path, "data").glob("*/bucket=*/part-*"):
        found.setdefault(int(f.parent.name.split("=")[1]), set()).add((str(f), f.stat().st_mtime_ns))
    return found


def state(spark, path):
    return sorted((str(r.region), str(r.vin), r.snapshot_id) for r in read_buckets(spark, path, SEEN).collect())


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "state")
    write = T.upsert_min(path, buckets=8)
    write(spark.createDataFrame([("a", str(i), 5) for i in range(40)] + [(None, None, 3)], SEEN), 0)
    before, at = files_of(path), pointer(spark, path, 0)
    write(spark.createDataFrame([("a", "7", 2), ("a", "7", 9), ("b", "new", 4)], SEEN), 1)
    after, now = files_of(path), pointer(spark, path, 1)
    touched = {b for b in now if now[b] == 1}
    assert 1 <= len(touched) <= 2 and len(at) > 4
    for b in set(at) - touched:
        assert after[b] == before[b]
    assert state(spark, path) == sorted([("a", str(i), 2 if i == 7 else 5) for i in range(40)] + [("None", "None", 3), ("b", "new", 4)])


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "state")
    write = T.upsert_min(path, buckets=4)
    for n in range(4):
        write(spark.createDataFrame([("a", str(i), 10 - n) for i in range(n, n + 5)], SEEN), n)
    files, want = files_of(path), state(spark, path)
    write(spark.createDataFrame([("a", "0", -99)], SEEN), 3)
    assert files_of(path) == files and state(spark, path) == want
    assert committed(spark, path)[-1] == 3 and len(committed(spark, path)) <= 3


def test_a_batch_that_broke_off_is_redone(spark, tmp_path):
    """Rows of a batch without a pointer are not seen, and its second run replaces them."""
    path = str(tmp_path / "state")
    write = T.upsert_min(path, buckets=2)
    write(spark.createDataFrame([("a", "1", 5)], SEEN), 0)
    spark.createDataFrame([("a", "1", 1, 0)], SEEN + ", bucket int").write.partitionBy("bucket").parquet(f"{path}/data/1")
    assert state(spark, path) == [("a", "1", 5)]
    write(spark.createDataFrame([("a", "1", 4)], SEEN), 1)
    assert state(spark, path) == [("a", "1", 4)]


def test_empty_batches(spark, tmp_path):
    path = str(tmp_path / "state")
    write = merge_into_buckets(path, ["region", "vin"], [F.min("snapshot_id").alias("snapshot_id")], 4)
    assert read_buckets(spark, path, SEEN).collect() == []
    write(spark.createDataFrame([], SEEN), 0)
    write(spark.createDataFrame([("a", "1", 5)], SEEN), 1)
    write(spark.createDataFrame([], SEEN), 2)
    assert state(spark, path) == [("a", "1", 5)]


def test_stream_of_several_batches(spark, tmp_path):
    rows = spark.range(600).select(F.concat(F.lit("r"), F.col("id") % 3).alias("region"), (F.col("id") % 50).cast("string").alias("vin"), (700 - F.col("id")).cast("int").alias("snapshot_id"))
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    path = str(tmp_path / "state")
    epochs = T.run_available(T.read_arrivals(spark, str(tmp_path / "in"), rows.schema), T.upsert_min(path, 4), "append", str(tmp_path / "check"))
    assert len(epochs) == 5
    assert state(spark, path) == sorted((r.region, r.vin, r.s) for r in rows.groupBy("region", "vin").agg(F.min("snapshot_id").alias("s")).collect())
    # The same checkpoint has nothing new to do.
    files = files_of(path)
    assert T.run_available(T.read_arrivals(spark, str(tmp_path / "in"), rows.schema), T.upsert_min(path, 4), "append", str(tmp_path / "check")) == []
    assert files_of(path) == files


ENRICHED = "region string, vin string, period int, vin_key string, is_ev boolean"


def test_sketches_of_three_batches_are_those_of_one(spark, tmp_path):
    """United sketches estimate what one sketch does; a batch of one period leaves the sketches of others as they are."""
    rows = [(f"r{i % 2}", str(i * 7 % 9000), p, "", i % 4 == 0) for p in (1, 2, 3) for i in range(6000)]
    frame = spark.createDataFrame(rows, ENRICHED)
    path = str(tmp_path / "state")
    write = T.merge_stock_sketches(path, lg_k=12, buckets=8)
    snapshots = []
    for n, part in enumerate((frame.where("period = 1"), frame.where("period = 2 and vin < '5'"), frame.where("period = 3 or (period = 2 and vin >= '4')"))):
        write(part, n)
        snapshots.append((files_of(path), pointer(spark, path, n)))
    kept = lambda d: sorted((r.region, r.group, r.metric, r.approx_unique_vins) for r in d.collect())
    one = str(tmp_path / "one")
    T.merge_stock_sketches(one, lg_k=12, buckets=8)(frame, 0)
    got = kept(T.read_stock_sketches(spark, path))
    assert got == kept(T.read_stock_sketches(spark, one)) and len(got) == 9
    exact = {(r.region, r.group, r.metric): r.approx_unique_vins for r in stock_counts(frame, exact=True).collect()}
    assert all(abs(n - exact[r, g, m]) <= 0.1 * exact[r, g, m] for r, g, m, n in got)
    (first, _), _, (last, now) = snapshots
    alone = [b for b, v in now.items() if v == 0]
    assert alone and all(last[b] == first[b] for b in alone)


@pytest.mark.parametrize("delay,days", [("2 days", 12)])
def test_state_is_bounded_by_the_watermark(spark, tmp_path, delay, days):
    """Twelve days of thirty events each, every event sent twice; late rows go, and old keys are forgotten."""
    schema = "id string, ts timestamp"
    start = dt.datetime(2024, 1, 1)
    for d in range(days):
        rows = [(f"{d}-{i}", start + dt.timedelta(days=d, minutes=i)) for i in range(30)]
        rows += [(f"{d - 1}-{i}", start + dt.timedelta(days=d - 1, minutes=i)) for i in range(30)] if d else []
        rows += [(f"late-{d}", start - dt.timedelta(days=5))] if d >= 6 else []
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{d:03d}"))
    seen = []
    first = T.stream_first_arrival(T.read_arrivals(spark, str(tmp_path / "in"), schema), ["id"], ("ts", delay))
    epochs = T.run_available(first, T.write_versions(str(tmp_path / "out"), ["id"]), "append", str(tmp_path / "check"), seen)
    got = sorted(r.id for r in spark.read.schema("id string").parquet(*[str(tmp_path / "out" / f"v{n}") for n in epochs]).collect())
    assert len(epochs) >= days and got == sorted(f"{d}-{i}" for d in range(days) for i in range(30))
    held = [s["numRowsTotal"] for p in seen for s in p["stateOperators"]]
    assert max(held) <= 5 * 30 < days * 30


def test_files_and_buckets_follow_the_rows(spark, tmp_path, monkeypatch):
    """Arriving files and buckets hold a task's rows each, so that more rows are more tasks; one period is several files, and batches stay four."""
    from fleetcast import queries as Q
    from fleetcast.streaming.incremental import upsert_min

    d, found = str(tmp_path), {}
    row = "cast(id % 7000 as long) as l_orderkey, id % 500 as l_partkey, id % 40 as l_suppkey, date_add(date '1995-01-01', cast(id % 300 as int)) as l_shipdate"
    spark.range(20_000).selectExpr(*row.split(", ", 3)).write.parquet(f"{d}/lineitem.parquet")
    monkeypatch.setattr(Q, "TASK_ROWS", 500)
    monkeypatch.setattr(Q.T, "upsert_min", lambda path, buckets: found.update(path=path, buckets=buckets) or upsert_min(path, buckets))
    seen = Q.stream_first_seen(spark, d)
    assert found["buckets"] == 40 and committed(spark, found["path"])[-1] == 3
    files = [f.name for f in pathlib.Path(found["path"].removeprefix("file:")).glob("../in/part-*")]
    assert len(files) == 40
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    month = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")).cast("long")
    want = line.groupBy(F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")).agg(F.min(month))
    assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, want.collect()))
    one = spark.range(4_000).select(F.lit("5").alias("dmv_id"), F.col("id").alias("l_orderkey"))
    path, each = Q._arrivals(one, 4, 4_000, ["dmv_id", "l_orderkey"])
    counts = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert each == 2 and len(counts) == 8 and max(counts) < 1_000


def test_a_bucket_is_a_task(spark, tmp_path):
    """No task of a batch has two buckets, and so none is idle beside one that has several."""
    path = str(tmp_path / "state")
    T.upsert_min(path, buckets=16)(spark.createDataFrame([(f"r{i}", str(i), 5) for i in range(400)], SEEN), 0)
    parts = [int(f.name.split("-")[1]) for f in pathlib.Path(path, "data").glob("0/bucket=*/part-*.parquet")]
    assert len(parts) == len(set(parts)) == 16
