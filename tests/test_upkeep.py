"""The ledger of a table, compaction, retention and changes of columns."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sensorlake.operators import rollups
from sensorlake.sinks import evolve, ledger, upkeep
from sensorlake.sinks import tables as sinks
from sensorlake.sources import tables as sources

NOW = timedelta(0)


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def dated(spark, low, high):
    """Ids as hours from 2024-01-01."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600)
    return spark.range(low, high).select("id", at.alias("at"), F.to_date(at).alias("date"))


def ids(spark, path):
    return sorted(r["id"] for r in sources.lake_scan(spark, path).collect())


def files(spark, path):
    return {r["path"]: r["rows"] for r in upkeep.table_files(spark, path).collect()}


def test_compaction_of_closed_dates(spark, path):
    for number in range(4):
        sinks.write_batch(dated(spark, number * 12, number * 12 + 40), path, "q", number, partition_by=["date"])
    rows, before = ids(spark, path), files(spark, path)
    assert upkeep.compact(spark, path, closed=date(2024, 1, 2)) == 1
    assert ids(spark, path) == rows
    after = files(spark, path)
    assert len(after) < len(before)
    open_dates = {p for p in before if "date=2024-01-01" not in p and "date=2024-01-02" not in p}
    assert open_dates and open_dates <= set(after)
    # a replay of an old batch, marked or not, changes nothing
    sinks.write_batch(dated(spark, 0, 999), path, "q", 0, partition_by=["date"])
    sinks.write_files(dated(spark, 0, 40), path, "q", 0, partition_by=["date"])
    assert ids(spark, path) == rows
    # late rows of a closed date are seen, and merged by the next call
    sinks.write_batch(dated(spark, 5, 7), path, "q", 4, partition_by=["date"])
    assert ids(spark, path) == sorted([*rows, 5, 6])
    assert upkeep.vacuum(spark, path, keep=timedelta(hours=1)) == 0
    assert upkeep.vacuum(spark, path, keep=NOW) > 0
    assert ids(spark, path) == sorted([*rows, 5, 6])
    assert upkeep.compact(spark, path, full=True) == 2
    assert upkeep.vacuum(spark, path, keep=NOW) > 0
    assert ids(spark, path) == sorted([*rows, 5, 6])
    assert len(files(spark, path)) == sources.lake_scan(spark, path).select("date").distinct().count()
    assert upkeep.compact(spark, path) == 0


def test_a_batch_that_was_not_written_whole_is_left_alone(spark, path):
    sinks.write_batch(dated(spark, 0, 10), path, "q", 0, partition_by=["date"])
    sinks.write_files(dated(spark, 10, 20), path, "q", 1, partition_by=["date"])  # no mark yet
    assert upkeep.compact(spark, path) == 1
    assert sinks.write_batch(dated(spark, 10, 24), path, "q", 1, partition_by=["date"]) == 14
    upkeep.vacuum(spark, path, keep=NOW)
    assert ids(spark, path) == list(range(24))


def test_compaction_without_dates_and_with_null_dates(spark, path, tmp_path):
    for k in range(3):
        sinks.append(spark.range(k, k + 1), path)
    assert upkeep.compact(spark, path) == 3
    upkeep.vacuum(spark, path, keep=NOW)
    sinks.append(spark.range(7, 8), path)
    assert ids(spark, path) == [0, 1, 2, 7] and len(ledger.read(spark, path).covered) == 0
    with pytest.raises(ValueError, match="not partitioned by date"):
        upkeep.compact(spark, path, closed=date(2024, 1, 1))
    other = str(tmp_path / "nulls")
    rows = dated(spark, 0, 48).withColumn("date", F.when(F.col("id") % 5 > 0, F.col("date")))
    sinks.append(rows, other, partition_by=["date"])
    assert upkeep.compact(spark, other, closed=date(2024, 1, 1)) == 1
    assert ids(spark, other) == list(range(48))
    upkeep.vacuum(spark, other, keep=NOW)
    assert ids(spark, other) == list(range(48))


def test_an_output_that_nobody_named_is_not_seen(spark, path):
    sinks.append(spark.range(5), path)
    state = ledger.read(spark, path)
    sinks.write_files(spark.range(5), path, f"{ledger.OUTPUT}lost", 0)
    ledger.commit(spark, path, state, state)
    assert ids(spark, path) == list(range(5))
    with pytest.raises(ledger.Conflict):
        ledger.commit(spark, path, state, state)
    upkeep.vacuum(spark, path, keep=NOW)
    assert spark.read.parquet(path).count() == 5


def test_retention(spark, path):
    for low in (0, 30):
        sinks.append(dated(spark, low, low + 70), path, partition_by=["date"])
    rows, before = ids(spark, path), files(spark, path)
    limit = datetime(2024, 1, 2, 6)
    assert upkeep.drop_before(spark, path, limit, time_column="at")
    assert ids(spark, path) == [i for i in rows if i >= 30]
    assert upkeep.vacuum(spark, path, keep=NOW) > 0
    assert ids(spark, path) == [i for i in rows if i >= 30]
    later = {p for p in before if "date=2024-01-01" not in p and "date=2024-01-02" not in p}
    assert later <= set(files(spark, path))
    kept = files(spark, path)
    assert not upkeep.drop_before(spark, path, limit, time_column="at")
    assert not upkeep.drop_before(spark, path, limit - timedelta(days=3), time_column="at")
    assert files(spark, path) == kept
    assert upkeep.drop_before(spark, path, datetime(2024, 1, 4), time_column="at")
    upkeep.vacuum(spark, path, keep=NOW)
    assert ids(spark, path) == [i for i in rows if i >= 72]


def test_points_keep_the_last_write_whatever_the_clock(spark, path, monkeypatch):
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id"))
    rows = spark.range(50).select(at.alias("_time"), F.lit("m").alias("_measurement"), F.lit("f").alias("_field"), (F.col("id") % 5).cast("string").alias("metric"))
    read = lambda: sorted(r["_value"] for r in sources.points_scan(spark, path, start=datetime(2024, 1, 1), stop=datetime(2024, 1, 2)).collect())
    for clock, value in ((2e18, 1.0), (1e18, 2.0), (5e17, 3.0)):
        monkeypatch.setattr("time.time_ns", lambda clock=clock: int(clock))
        sinks.append_points(rows.filter(f"id >= {int(value) * 10}").withColumn("_value", F.lit(value)), path)
    wanted = [1.0] * 10 + [2.0] * 10 + [3.0] * 20
    assert read() == wanted
    assert upkeep.compact(spark, path) == 1
    assert read() == wanted and sum(files(spark, path).values()) == 40
    sinks.append_points(rows.filter("id < 12").withColumn("_value", F.lit(9.0)), path)
    upkeep.vacuum(spark, path, keep=NOW)
    assert read() == sorted([9.0] * 12 + [1.0] * 8 + [2.0] * 10 + [3.0] * 20)


def test_a_rare_tag_is_found_without_reading_the_date(spark, path):
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 86400)
    rows = spark.range(0, 400_000, 1, 4).select(
        at.alias("_time"), F.lit("m").alias("_measurement"), F.lit("f").alias("_field"),
        F.concat(F.lit("host-"), F.col("id") % 997).alias("host"), F.md5((F.col("id") % 50_000).cast("string")).alias("device"),
        F.col("id").cast("double").alias("_value"),
    )
    spark.conf.set("parquet.block.size", str(1 << 19))
    try:
        sinks.append_points(rows, path, tags=["host"], distinct={"host": 1000, "device": 50_000})
    finally:
        spark.conf.unset("parquet.block.size")

    def scanned(**tags):
        found = sources.points_scan(spark, path, start=datetime(2024, 1, 1), stop=datetime(2024, 1, 2), tags=tags)
        count = len(found.collect())
        scan = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return count, scan.metrics().apply("numOutputRows").value()

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan shown is the one that ran
    count, read = scanned(host="host-17")
    assert count == 402 or count == 401
    assert read < 40_000
    count, read = scanned(host="host-17x")
    assert count == 0 and read == 0
    count, read = scanned(device="0" * 32)  # within the range of every row group, so only the bloom filter tells
    assert count == 0 and read < 40_000
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_changes_of_columns(spark, path):
    def offer(sql):
        return spark.sql(f"SELECT {sql}")

    sinks.append(offer("1 AS a, 'x' AS b, 1.5f AS c"), path)
    assert [tuple(r) for r in evolve.changes(spark, path, offer("2.5D AS a, 1 AS b, 'n' AS d, 1L AS B").schema).collect()] == [
        ("a", "int", "double", "widen", "int is read as double"),
        ("b", "string", "int", "refuse", "int does not go into string"),
        ("d", None, "string", "add", "new column"),
        ("B", "string", "bigint", "refuse", "the table has b"),
    ]
    sinks.append(offer("2.5D AS a, 'n' AS d"), path)
    sinks.append(offer("7 AS a, 2.5D AS c"), path)  # int goes into double, float is read as double
    with pytest.raises(evolve.SchemaRefused, match="a: string does not go into double") as refused:
        sinks.append(offer("'8' AS a"), path)
    assert [c[3] for c in refused.value.changes] == ["refuse"]
    found = sources.lake_scan(spark, path)
    assert dict(found.dtypes) == {"a": "double", "b": "string", "c": "double", "d": "string"}
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(
        map(str, [(1.0, "x", 1.5, None), (2.5, None, None, "n"), (7.0, None, 2.5, None)])
    )
    upkeep.compact(spark, path)
    upkeep.vacuum(spark, path, keep=NOW)
    assert sources.lake_scan(spark, path).count() == 3


def test_states_of_any_batches_merge_to_one_pass(spark, path):
    rows = spark.range(3000).select(
        F.concat(F.lit("s"), F.col("id") % 4).alias("s"),
        F.timestamp_seconds(F.lit(1704067200) + (F.col("id") * 7919) % 500_000).alias("t"),
        F.when(F.col("id") % 4 == 3, None).when(F.col("id") % 11 == 0, F.lit(float("nan"))).otherwise(1e9 + F.sin("id")).alias("v"),
    )
    for k in range(5):
        found = rollups.states(rows.filter(F.pmod(F.xxhash64("t", "s"), F.lit(5)) == k), ["s"], value="v", time="t")
        for _ in range(2):  # the second time is a repeated batch
            sinks.write_batch(found, path, "q", k, partition_by=["date"])
    got = {r["s"]: r for r in rollups.merged(sources.lake_scan(spark, path), ["s"]).collect()}
    clean = rows.withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    wanted = clean.groupBy("s").agg(
        F.count("*").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.min("t").alias("first_time"), F.max("t").alias("last_time"),
        F.min_by("v", F.when(F.col("v").isNotNull(), F.struct("t", "v"))).alias("first_value"),
        F.max_by("v", F.when(F.col("v").isNotNull(), F.struct("t", "v"))).alias("last_value"),
    )
    for r in wanted.collect():
        mine = got[r["s"]]
        for name in r.asDict():
            if name in ("mean", "std") and r[name] is not None:
                assert mine[name] == pytest.approx(r[name], rel=1e-7)
            else:
                assert mine[name] == r[name], (r["s"], name)
        values = sorted(x["v"] for x in clean.filter(F.col("s") == r["s"]).collect() if x["v"] is not None)
        for name, share in rollups.QUANTILES.items():
            if not values:
                assert mine[name] is None
            else:
                rank = sum(v <= mine[name] for v in values) / len(values)
                assert abs(rank - share) <= rollups.RANK_ERROR + 1 / len(values)
    part = rollups.merged(sources.lake_scan(spark, path).filter("date = '2024-01-02'"), ["s"])
    assert sum(r["count"] for r in part.collect()) == rows.filter("to_date(t) = '2024-01-02'").count()
