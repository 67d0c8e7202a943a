"""Rollups that are refreshed, retention by partition, and streams with buffers, timers and expiry, over several triggers."""

import datetime as dt
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelark.operators import rollups
from tidelark.plans import registry
from tidelark.sources import fixtures, tables
from tidelark.streaming import operators as so
from tidelark.streaming import runner

NOW = dt.datetime(2024, 1, 29, 12)


@pytest.fixture(scope="module")
def events(spark, sf):
    return fixtures.sensor_events(spark, sf).cache()


def rows(df):
    return sorted(map(str, df.collect()))


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def local(path):
    return path.removeprefix("file://").removeprefix("file:")


@pytest.mark.parametrize("steps", [(24,), (30, 12), (60, 40, 20)])
def test_refreshes_equal_one_rollup(spark, events, steps):
    at, whole = tables.folder(spark), tables.folder(spark)
    rollups.refresh_rollup(events, at, NOW - dt.timedelta(hours=steps[0]), lookback=None)
    before = files(local(at))
    for back in (*steps[1:], 0):
        rollups.refresh_rollup(events, at, NOW - dt.timedelta(hours=back))
    rollups.refresh_rollup(events, whole, NOW, lookback=None)
    got = rollups.rollup_view(spark, at)
    assert rows(got.select("hour", "room", "sensor_type", "n", F.round("mean_value", 9))) == rows(rollups.rollup_view(spark, whole).select("hour", "room", "sensor_type", "n", F.round("mean_value", 9)))
    due = events.where(F.col("ts") < F.lit(dt.datetime(2024, 1, 29, 11)).cast("timestamp_ntz"))
    assert got.agg(F.max("hour"), F.sum("n")).first() == due.agg(F.max(F.date_trunc("hour", "ts").cast("timestamp_ntz")), F.count("*")).first()
    touched = {str((NOW - dt.timedelta(hours=h)).date()) for h in range(0, steps[0] + 25)}
    after = files(local(at))
    kept = {f: t for f, t in before.items() if not any(f"day={d}" in f for d in touched)}
    assert len(kept) > 20 and all(after.get(f) == t for f, t in kept.items())


def test_late_rows_are_merged(spark, events):
    at, whole = tables.folder(spark), tables.folder(spark)
    late = events.where("event_id % 17 = 0 and day(ts) in (3, 4, 11)")
    rollups.refresh_rollup(events.join(late.select("event_id"), "event_id", "left_anti"), at, NOW, lookback=None)
    before = files(local(at))
    rollups.merge_late(late, at)
    rollups.merge_late(late.limit(0), at)
    rollups.refresh_rollup(events, whole, NOW, lookback=None)
    pick = lambda p: rollups.rollup_view(spark, p).select("hour", "room", "sensor_type", "n", F.round("mean_value", 9))
    assert rows(pick(at)) == rows(pick(whole))
    assert {f.split("day=")[1][:10] for f in set(files(local(at))) ^ set(before)} <= {"2024-01-03", "2024-01-04", "2024-01-11"}


def test_expiry_drops_folders_and_rewrites_the_border(spark, events):
    named = {"events": events, "occupancy": fixtures.room_occupancy(events), "none": events.where("false")}
    paths = {}
    for name, df in named.items():
        paths[name] = tables.folder(spark)
        tables.write_events(df, paths[name])
    before = {n: files(local(p)) for n, p in paths.items()}
    counts = {r.table: (r.expired, r.kept) for r in tables.expire(spark, {n: paths[n] for n in ("events", "occupancy")}, NOW, 14).collect()}
    border = NOW - dt.timedelta(days=14)
    for name in ("events", "occupancy"):
        old = named[name].where(F.col("ts") < F.lit(border).cast("timestamp_ntz")).count()
        assert counts[name] == (old, named[name].count() - old)
        left = spark.read.parquet(paths[name])
        assert left.count() == counts[name][1] and left.agg(F.min("ts")).first()[0] >= border
        after = files(local(paths[name]))
        late = {f: t for f, t in before[name].items() if f.split("event_date=")[1][:10] > border.date().isoformat()}
        assert late and all(after.get(f) == t for f, t in late.items())
        assert not any(f.split("event_date=")[1][:10] < border.date().isoformat() for f in after)


@pytest.mark.parametrize("days, together", [(7, 1), (7, 4), (3, 2)])
def test_an_import_goes_on_where_it_stopped(spark, events, days, together):
    at, finished = tables.folder(spark), tables.folder(spark)
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    until = last + dt.timedelta(microseconds=1)
    how = {"days": days, "together": together}
    assert tables.import_chunks(events, at, finished, first, until, at_most=2, **how) == 2
    two = files(local(at))
    assert len({os.path.dirname(f) for f in two}) == 2
    rest = tables.import_chunks(events, at, finished, first, until, **how)
    assert rest == len(tables.chunks(first, until, days)) - 2 and tables.import_chunks(events, at, finished, first, until, **how) == 0
    after = files(local(at))
    assert all(after.get(f) == t for f, t in two.items())
    got = spark.read.parquet(at)
    assert rows(got.select("event_id", "ts")) == rows(events.select("event_id", "ts"))
    log = {r.chunk: r.n for r in spark.read.parquet(finished).collect()}
    assert log == {r.chunk: r["count"] for r in got.groupBy("chunk").count().collect()}


def test_an_import_replaces_what_was_cut_off_and_widens_chunks(spark, events):
    at, finished = tables.folder(spark), tables.folder(spark)
    cut = [dt.datetime(2024, 1, d, h) for d, h in ((3, 5), (10, 7), (17, 0))]
    # a run that was stopped after a chunk's data and before its row in the log
    tables.import_chunks(events, at, tables.folder(spark), cut[0], cut[1])
    assert tables.import_chunks(events, at, finished, cut[0], cut[1]) == 2
    assert tables.import_chunks(events, at, finished, cut[1], cut[2]) == 2  # the second chunk is widened, a third is new
    inside = events.where((F.col("ts") >= F.lit(cut[0]).cast("timestamp_ntz")) & (F.col("ts") < F.lit(cut[2]).cast("timestamp_ntz")))
    assert rows(spark.read.parquet(at).select("event_id")) == rows(inside.select("event_id"))
    nothing = tables.folder(spark)
    assert tables.import_chunks(events, at, nothing, cut[0], cut[0]) == 0 and spark.read.parquet(nothing).count() == 0


def test_states_are_read_from_a_database_in_ranges(spark, events):
    """An embedded database in memory, that Spark brings along."""
    url = "jdbc:derby:memory:states;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = events.select("event_id", "entity_id", F.col("ts").cast("timestamp").alias("last_changed"))
    df.write.format("jdbc").options(url=url, dbtable="states", **driver).mode("overwrite").save()
    got = tables.database_states(spark, url, "states", partitions=5, lower="2024-01-01 00:00:00", upper="2024-01-31 00:00:00", **driver)
    assert got.rdd.getNumPartitions() == 5 and rows(got) == rows(df)
    at, finished = tables.folder(spark), tables.folder(spark)
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    states = got.withColumn("ts", F.col("last_changed").cast("timestamp_ntz"))
    assert tables.import_chunks(states, at, finished, first, last + dt.timedelta(microseconds=1), at_most=2) == 2
    tables.import_chunks(states, at, finished, first, last + dt.timedelta(microseconds=1))
    assert spark.read.parquet(at).count() == events.count()


@pytest.mark.parametrize("size, step", [(20, 10), (7, 3)])
def test_counted_windows_over_triggers(spark, events, size, step):
    df = events.withColumn("ts", F.col("ts").cast("timestamp")).select("room", "event_id", "ts")
    day = F.dayofmonth("ts")
    got = runner.in_turns([df.where(day <= 5), df.where((day > 5) & (day <= 6)), df.where(day > 6)], lambda s: so.overlapping_blocks(s, size, step))
    want = []
    by_room = {}
    for r in df.orderBy("ts", "event_id").collect():
        by_room.setdefault(r.room, []).append(r.event_id)
    for room, ids in by_room.items():
        want += [(room, b, size, min(ids[b * step : b * step + size])) for b in range(len(ids)) if b * step + size <= len(ids)]
    assert sorted((r.room, r.block, r.n, r.first_id) for r in got.collect()) == sorted(want)


def test_buffers_fire_when_full_or_late(spark, events):
    df = events.select("room", "event_id")
    got = runner.in_turns([df.where("event_id % 3 > 0"), df.where("event_id % 3 = 0")], lambda s: so.micro_batches(s, 60, 3_000), rows=df.count()).collect()
    assert sorted(r.event_id for r in got) == sorted(r.event_id for r in df.collect())
    sizes = {}
    for r in got:
        sizes.setdefault((r.room, r.batch, r.reason), []).append(r.event_id)
    assert all(len(ids) == 60 if reason == "full" else 0 < len(ids) < 60 for (_, _, reason), ids in sizes.items())
    assert {reason for _, _, reason in sizes} == {"full", "timeout"}
    for room in {room for room, _, _ in sizes}:
        assert sorted(b for r, b, _ in sizes if r == room) == list(range(sum(r == room for r, _, _ in sizes)))


def test_entries_expire(spark, events):
    df = events.select("room", "event_id").where("room is not null")
    kept = {ttl: runner.in_turns([df, df], lambda s, t=ttl: so.once_per(s, "room", t), pause_s=2.5).groupBy("key").count().collect() for ttl in (3_600_000, 1_000)}
    assert {r["count"] for r in kept[3_600_000]} == {1} and {r["count"] for r in kept[1_000]} == {2}


def test_blocks_of_long_rooms_and_months(spark, tmp_path):
    """More blocks than 5,000 in one room, and events of two months: both queries give the rows of their SQL."""
    n = 251_000
    duckdb.sql(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-15' + (i * 20) * INTERVAL 1 SECOND AS ts, CAST(0 AS BIGINT) AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{{\"k\": 1}}' AS props FROM range({n}) t(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name in ("t15_overlapping_blocks", "t15_stream_blocks"):
        got = registry.QUERIES[name](spark, str(tmp_path))
        want = con.execute(registry.ORACLE_SQL[name])
        at = [c[0] for c in want.description]
        assert sorted(map(tuple, got.select(*at).collect())) == sorted(want.fetchall()) and got.count() > 5_000


def test_folds_of_a_stream_take_slices(spark, sf, tmp_path):
    """A trigger with all of a key's rows reaches the fold slice by slice, in order, and the next trigger goes on from its state (F8)."""
    df = spark.createDataFrame([(f"r{i % 2}" if i % 5 else None, i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i)) for i in range(1000)], "room string, event_id long, ts timestamp")
    at = str(tmp_path)
    df.where("event_id < 600").orderBy(F.desc("event_id")).coalesce(1).write.parquet(f"{at}/a")
    df.where("event_id >= 600").coalesce(1).write.parquet(f"{at}/b")

    def fold(kept, rows):
        n, last = kept.get("n", 0) + len(rows), kept.get("last", -1)
        ids = rows["event_id"]
        fine = bool(ids.is_monotonic_increasing and ids.iloc[0] > last)
        return {"n": n, "last": int(ids.iloc[-1])}, pd.DataFrame({"slice": [len(rows)], "n": [n], "fine": [fine], "room": [rows["room"].iloc[0]]})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        put = so.fold_batches(f"{at}/out", ["room"], ["ts", "event_id"], fold, "slice long, n long, fine boolean, room string")
        for number, part in enumerate(("a", "b")):
            put(spark.read.parquet(f"{at}/{part}"), number)
        put(spark.read.parquet(f"{at}/b"), 1)  # a trigger that is run again replaces what it wrote
        got = spark.read.parquet(f"{at}/out/n=*").where("_k is null").collect()
        same = registry.QUERIES["t08_bathroom_machine"](spark, sf)
        want = registry.QUERIES["w15_bathroom_machine"](spark, sf)
        assert sorted(map(str, same.collect())) == sorted(map(str, want.select(*same.columns).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert max(r.slice for r in got) <= 64 and all(r.fine for r in got)
    assert {room: max(r.n for r in got if r.room == room) for room in ("r0", "r1", None)} == {"r0": 400, "r1": 400, None: 200}
    assert sum(r.slice for r in got) == 1000
