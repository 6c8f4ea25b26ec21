from fleetcast.operators.flow import new_registrations

ROWS = [("a", "1", 3, "k", True), ("a", "1", 2, "z", False), ("b", "1", 2, "k", True), ("b", "2", 5, None, False), ("c", "2", 1, "x", True), ("c", None, 1, "x", True)]


def test_registrations_are_read_once(spark):
    """Flags and first snapshots come from one scan and without a join; of two rows of a vehicle's first snapshot the smaller key counts."""
    found = new_registrations(spark.createDataFrame(ROWS, "region string, vin string, period int, vin_key string, is_ev boolean"))
    assert sorted(map(tuple, found.collect())) == [("a", 2, 1, 1, 100.0), ("b", 2, 1, 1, 100.0), ("b", 5, 1, 1, 100.0), ("c", 1, 1, 1, 100.0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") == 1


def test_buckets_of_vehicles_follow_the_rows(spark, monkeypatch):
    """A bucket has a file for each period, so buckets don't grow with the session's shuffle partitions; the counts are those of plain rows."""
    from fleetcast import queries as Q

    d, taken, write = "/root/testdata/sf0.001", [], Q.layout.write_by_vehicle
    monkeypatch.setattr(Q.layout, "write_by_vehicle", lambda rows, buckets: taken.append(buckets) or write(rows, buckets))
    monkeypatch.setattr(Q, "TASK_ROWS", 100)
    found = Q.QUERIES["new_registrations_by_vehicle"](spark, d)
    assert taken == [max(8, -(-spark.read.parquet(f"{d}/lineitem.parquet").count() // 400))]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, Q.QUERIES["new_registrations"](spark, d).collect()))
