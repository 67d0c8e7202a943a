"""Scans, frames, as-of joins and folds by bucket or chunk against the plain window over the key, with one hot key."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelark.operators import bathroom, drift, patterns, segments, series, temporal
from tidelark.plans import registry
from tidelark.sources import fixtures

ORDER = ["ts", "event_id"]


def same(got, want):
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.fixture(scope="module")
def hot(spark):
    """Most rows in one room, ties in time, empty days, a null room and null values."""
    rng = np.random.default_rng(5)
    n = 1_500
    at = np.sort(rng.integers(0, 20, n) * 86_400 + np.where(rng.random(n) < 0.5, 3_600, rng.integers(0, 80_000, n)))
    room = rng.choice(["hot", "b", None], n, p=[0.85, 0.1, 0.05])
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(a)), None if r is None else str(r), None if i % 11 == 0 else int(rng.integers(0, 100)), str(rng.choice(["on", "off", "reading"]))) for i, (a, r) in enumerate(zip(at, room, strict=True))]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, room string, v long, state string").cache()


@pytest.mark.parametrize("bucket_s", [3_600, 86_400, 90 * 86_400])
@pytest.mark.parametrize("upto", [0, -1])
def test_running_is_a_plain_window(hot, bucket_s, upto):
    scans = {"n": segments.count(), "c": segments.count(F.col("v")), "s": segments.total("v"), "lo": segments.least("v"), "hi": segments.greatest("v"), "la": segments.last(F.col("v"), ORDER), "fi": segments.first("v", ORDER)}
    w = W.partitionBy("room").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, upto)
    plain = {"n": F.count(F.lit(1)), "c": F.count("v"), "s": F.sum("v"), "lo": F.min("v"), "hi": F.max("v"), "la": F.last("v", ignorenulls=True), "fi": F.first("v")}
    same(segments.running(hot, ["room"], ORDER, scans, bucket_s=bucket_s, upto=upto), hot.select("*", *[c.over(w).alias(k) for k, c in plain.items()]))


@pytest.mark.parametrize("before, after", [(0, 0), (9, 0), (0, 4), (30, 25), (700, 0)])
@pytest.mark.parametrize("chunk", [1, 32, 4_096])
def test_row_frame_is_a_plain_window(hot, before, after, chunk):
    w = W.partitionBy("room").orderBy(*ORDER).rowsBetween(-before, after)
    out = {"s": F.sum("v"), "l": F.collect_list("event_id")}
    same(segments.row_frame(hot, ["room"], ORDER, before, after, out, chunk=chunk), hot.select("*", *[c.over(w).alias(k) for k, c in out.items()]))


def test_a_frame_of_its_own(hot):
    w = W.partitionBy("room").orderBy(*ORDER)
    got = segments.row_frame(hot, ["room"], ORDER, 49, 0, {"a": (F.sum("v"), -24, 0), "b": (F.sum("v"), -49, -25)}, chunk=50)
    same(got, hot.select("*", F.sum("v").over(w.rowsBetween(-24, 0)).alias("a"), F.sum("v").over(w.rowsBetween(-49, -25)).alias("b")))


def test_no_key_is_one_task(hot):
    """A hot room's rows are in as many windows as it has days; only a row for each day is in a window by room."""
    plan = segments.running(hot, ["room"], ORDER, {"n": segments.count()})._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition(" in line]
    assert len(windows) == 2 and sum("windowspecdefinition(_sk" in line and "_sb" in line.split("windowspecdefinition(")[1].split("ASC")[0].split(", ")[1] for line in windows) == 2


@pytest.mark.parametrize("keys", [(), ("room",)])
@pytest.mark.parametrize("ahead", [False, True])
def test_neighbour_by_key(hot, keys, ahead):
    for bucket in (1_800, 86_400):
        got = temporal.neighbour(hot, ["v", "event_id"], keys=keys, ahead=ahead, bucket_s=bucket, prefix="x_").select("event_id", "x_v", "x_event_id")
        w = W.partitionBy(*keys).orderBy(*ORDER)
        f = F.lead if ahead else F.lag
        same(got, hot.select("event_id", f("v").over(w).alias("x_v"), f("event_id").over(w).alias("x_event_id")))


@pytest.mark.parametrize("bucket_s", [600, 86_400, 400 * 86_400])
def test_periods_are_gaps_and_islands(hot, bucket_s):
    got = temporal.periods(hot, F.col("state") == "on", F.col("state") == "off", keys=["room"], least_min=0.1, bucket_s=bucket_s)
    want, open_at = [], {}
    for r in hot.orderBy(*ORDER).collect():
        if r.state == "on" and r.room not in open_at:
            open_at[r.room] = r.ts
        elif r.state == "off" and r.room in open_at:
            start = open_at.pop(r.room)
            if (r.ts - start).total_seconds() / 60 > 0.1:
                want.append((r.room or "", start, r.ts))
    assert sorted((r.room or "", r.start_ts, r.end_ts) for r in got.collect()) == sorted(want) and len(want) > 50


@pytest.mark.parametrize("bucket_s", [60, 86_400, 400 * 86_400])
def test_as_of_is_duckdbs(hot, bucket_s):
    """One hot room, empty buckets between readings, nulls and equal times; ties go to the greatest event_id."""
    left, right = hot.where("event_id % 3 = 0").select("event_id", "room", "ts"), hot.where("event_id % 7 = 0 and room is not null")
    got = {r.event_id: r.latest for r in temporal.latest_before(left, right, "room", "v", tie="event_id", bucket_s=bucket_s).collect()}
    b = right.where("v is not null").toPandas().sort_values(["room", "ts", "event_id"]).drop_duplicates(["room", "ts"], keep="last")
    con = duckdb.connect()
    con.register("a", left.toPandas())
    con.register("b", b)
    want = dict(con.execute("select a.event_id, b.v from a asof left join b on a.room = b.room and a.ts >= b.ts").fetchall())
    assert got == {k: None if v is None or v != v else int(v) for k, v in want.items()} and any(v is not None for v in got.values())


def test_counts_in_ranges_are_differences(spark, sf):
    """Counts equal plain frames', with ties and rows without a time, and no query's frame slides over the rows in it."""
    rng = np.random.default_rng(2)
    at = pd.Series(pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 40_000, 3_000), unit="s")).where(rng.random(3_000) > 0.01)
    df = spark.createDataFrame(pd.DataFrame({"event_id": np.arange(3_000), "ts": at, "room": rng.choice(["a", "b"], 3_000)}))
    odd, t = F.col("event_id") % 2 == 1, temporal.micros("ts")
    frame = lambda w, low, high: w.orderBy(t).rangeBetween(-low * 1_000_000, high * 1_000_000)
    for before, after, shorter in ((1_800, 0, 600), (5, 5, 0)):
        got = temporal.nearby(df, before, after, {"n": temporal.Counted(), "r": temporal.Counted(odd, ("room",)), "s": temporal.Counted(before_s=shorter)}, per_bucket=200).select("event_id", "n", "r", "s")
        same(got, df.select("event_id", F.count(F.lit(1)).over(frame(W.partitionBy(), before, after)).alias("n"), F.count(F.when(odd, 1)).over(frame(W.partitionBy("room"), before, after)).alias("r"), F.count(F.lit(1)).over(frame(W.partitionBy(), shorter, after)).alias("s")))
    for name in ("w02_trailing_counts", "w04_cross_room", "w05_lag_features"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "RangeFrame, unboundedpreceding" in plan and "RangeFrame, -" not in plan, name


def test_busy_hours_are_split(spark):
    """Half of all events in one hour: no bucket holds more than twice the median, and the counts are the plain ones."""
    rng = np.random.default_rng(1)
    at = np.concatenate([rng.integers(0, 240 * 3_600, 4_000), 100 * 3_600 + rng.integers(0, 3_600, 4_000)])
    df = spark.createDataFrame(pd.DataFrame({"event_id": np.arange(len(at)), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(at, unit="s"), "room": rng.choice(["a", "b"], len(at))}))
    cuts = temporal.time_cuts(df, 5, per_bucket=250)
    sizes = np.histogram(df.select(temporal.micros("ts")).toPandas().iloc[:, 0], bins=[-np.inf, *cuts, np.inf])[0]
    assert len(sizes) > 20 and sizes.max() <= 2 * np.median(sizes)
    one = lambda w: F.count(F.lit(1)).over(w)
    for before, after in ((1_800, 0), (5, 5)):
        got = temporal.nearby(df, before, after, {"n": one, "r": (one, ("room",))}, per_bucket=250).select("event_id", "n", "r")
        w = W.orderBy(temporal.micros("ts")).rangeBetween(-before * 1_000_000, after * 1_000_000)
        v = W.partitionBy("room").orderBy(temporal.micros("ts")).rangeBetween(-before * 1_000_000, after * 1_000_000)
        same(got, df.select("event_id", F.count(F.lit(1)).over(w).alias("n"), F.count(F.lit(1)).over(v).alias("r")))


@pytest.mark.parametrize("chunk", [40, 150])
@pytest.mark.parametrize("kind", [drift.PageHinkley, drift.KolmogorovSmirnov, drift.Cooldown])
def test_folds_by_chunk_are_the_whole_fold(spark, kind, chunk):
    """Several chunks of one hot key; the same answers as one object that takes every row."""
    rng = np.random.default_rng(2)
    x = np.where(np.arange(600) // 150 % 2, 3.0, 0.0) + rng.normal(0, 0.5, 600)
    if kind is drift.Cooldown:
        x = np.cumsum(rng.exponential(700, 600))
    rows = [("hot" if i % 8 else None, i, float(v)) for i, v in enumerate(x)]
    want, state = {}, {}
    for key, i, v in rows:
        want[i] = state.setdefault(key, kind()).add(v)
    made: list[int] = []
    df = spark.createDataFrame(rows, "room string, i long, x double")
    got = {r.i: r.alarm for r in drift.folded(df, ["room"], ["i"], "x", kind, chunk=chunk, bucket_s=100, rounds=made).collect()}
    assert got == want and made[0] > 2 and len(made) <= made[0] and any(got.values())


@pytest.mark.parametrize("chunk", [60, 10_000])
def test_bathroom_machine_by_chunk(spark, sf, chunk):
    events = fixtures.sensor_events(spark, sf)
    rows = events.where("sensor_type IN ('entrance', 'door')").select("event_id", "room", F.col("ts").cast("timestamp").alias("ts"), "sensor_type", "state").toPandas()
    want = pd.concat([bathroom.results(bathroom.Machine(), part) for _, part in rows.groupby("room")])
    made: list[int] = []
    got = bathroom.bathroom_states(events, chunk=chunk, rounds=made).toPandas()
    key = lambda d: sorted((r.event_id, r.occupied, r.confidence, r.reason, None if r.duration_s != r.duration_s else r.duration_s, r.door_probability) for r in d.itertuples())
    assert key(got) == key(want)
    assert len(made) == 1 if chunk == 10_000 else made[0] > 5


def test_sequences_across_chunks(spark, sf):
    events = fixtures.sensor_events(spark, sf)
    found = patterns.sequences(events, F.col("state"), 4).groupBy("room").agg(F.count("*").alias("n")).collect()
    sizes = {r.room: r["count"] for r in events.groupBy("room").count().collect()}
    assert {r.room: r.n for r in found} == {k: 3 * n - 6 for k, n in sizes.items()}
