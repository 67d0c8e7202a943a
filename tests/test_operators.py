"""Folds against plain loops, the scale helpers against plain windows, streams against batches, and invariants."""

import collections
import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelark.operators import bathroom, drift, learning, movement, occupancy, patterns, scoring, series, temporal
from tidelark.plans import base, registry
from tidelark.sources import fixtures, tables
from tidelark.streaming import operators as so


@pytest.fixture(scope="module")
def events(spark, sf):
    return fixtures.sensor_events(spark, sf).cache()


def test_neighbour_is_a_plain_lag(events):
    for ahead, f in ((False, F.lag), (True, F.lead)):
        for bucket in (3_600, 86_400, 40 * 86_400):
            got = temporal.neighbour(events, ["event_id", "room"], ahead=ahead, bucket_s=bucket, prefix="x_").select("event_id", "x_event_id", "x_room")
            w = W.orderBy("ts", "event_id")
            want = events.select("event_id", f("event_id").over(w).alias("x_event_id"), f("room").over(w).alias("x_room"))
            assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("before, after", [(300, 300), (1800, 0), (0, 3600)])
def test_nearby_is_a_plain_range(events, before, after):
    got = temporal.nearby(events, before, after, {"n": lambda w: F.count(F.lit(1)).over(w)}).select("event_id", "n")
    w = W.orderBy(temporal.micros("ts")).rangeBetween(-before * 1_000_000, after * 1_000_000)
    want = events.select("event_id", F.count(F.lit(1)).over(w).alias("n"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_interval_join_is_a_plain_theta_join(events):
    a = events.where("k < 50").select("event_id", "ts", "room")
    b = events.where("k >= 50").select(F.col("event_id").alias("other"), F.col("ts").alias("ots"), "room")
    got = temporal.interval_join(a, b, ["room"], "ts", "ots", -7200, 3600).select("event_id", "other")
    gap = temporal.micros("ots") - temporal.micros("ts")
    want = a.join(b, "room").where((gap >= -7200e6) & (gap <= 3600e6)).select("event_id", "other")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > 10
    semi = temporal.interval_join(a, b, ["room"], "ts", "ots", -7200, 3600, how="left_semi").select("event_id")
    anti = temporal.interval_join(a, b, ["room"], "ts", "ots", -7200, 3600, how="left_anti").select("event_id")
    assert {r[0] for r in semi.collect()} == {r[0] for r in want.select("event_id").distinct().collect()}
    assert semi.count() + anti.count() == a.count()


def series_frame(spark, n=700, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for room, x in (("step", np.where(np.arange(n) < 150, 0.0, 3.0) + rng.normal(0, 0.3, n)), ("flat", np.full(n, 0.2)), ("ramp", np.arange(n) / 100), ("noise", rng.normal(0, 1, n))):
        rows += [(room, i, float(v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "room string, i long, x double"), rows


def by_room(rows):
    out = {}
    for room, i, x in sorted(rows):
        out.setdefault(room, []).append((i, x))
    return out


def test_page_hinkley(spark):
    df, rows = series_frame(spark)
    want = set()
    for room, xs in by_room(rows).items():
        p = n = mn = mx = 0.0
        for i, x in xs[1:]:
            p, n = p + x - 0.05, n + x + 0.05
            mn, mx = min(mn, p), max(mx, n)
            if p - mn > 50 or mx - n > 50:
                want.add((room, i))
                p = n = mn = mx = 0.0
    got = {(r.room, r.i) for r in drift.folded(df, ["room"], ["i"], "x", drift.PageHinkley).where("alarm").collect()}
    assert got == want and want
    first = {(r.room, r.i) for r in drift.page_hinkley_first(df, ["room"], ["i"], "x").collect()}
    assert first == {min(w for w in want if w[0] == room) for room in {w[0] for w in want}}


def test_adwin_and_ks(spark):
    df, rows = series_frame(spark, 1800)
    got = {(r.room, r.i): (r.buffer, r.drift) for r in drift.adwin(df, ["room"], ["i"], "x").collect()}
    alarms = {(r.room, r.i) for r in drift.folded(df, ["room"], ["i"], "x", drift.KolmogorovSmirnov).where("alarm").collect()}
    for room, xs in by_room(rows).items():
        buffer, reference, current = [], [], []
        for i, x in xs:
            buffer.append(x)
            if len(buffer) > 1000:
                buffer = buffer[len(buffer) // 2 :]
            a, b = np.mean(buffer[-25:]), np.mean(buffer[-50:-25]) if len(buffer) >= 50 else 0
            assert got[room, i][0] == len(buffer)
            gap, spread = abs(a - b), 3 * np.sqrt(np.var(buffer))
            if len(buffer) >= 50 and abs(gap - spread) > 1e-6:
                assert got[room, i][1] == (gap > spread)
            alarm = False
            if len(reference) < 100:
                reference.append(x)
            else:
                current = (current + [x])[-100:]
                if len(current) == 100:
                    d = max(abs((j + 1) / 100 - np.mean(np.array(current) <= r)) for j, r in enumerate(sorted(reference)))
                    alarm = d > 1.36 * np.sqrt(0.02)
                    if alarm:
                        reference, current = current, []
            assert ((room, i) in alarms) == alarm


def test_cooldown():
    c = drift.Cooldown(1800)
    assert [c.add(t) for t in (0, 1799, 1800, 3599, 3600, 9000)] == [True, False, True, False, True, True]


def test_bathroom_trace(spark):
    t0 = dt.datetime(2024, 1, 1, 12, 0)
    trace = [(0, "entrance", "on"), (10, "door", "off"), (20, "entrance", "on"), (40, "door", "on"), (200, "door", "on"), (300, "entrance", "off"), (400, "entrance", "on"), (500, "entrance", "off")]
    rows = [(i, "bathroom", t0 + dt.timedelta(seconds=s), kind, state) for i, (s, kind, state) in enumerate(trace)]
    df = spark.createDataFrame(rows, "event_id long, room string, ts timestamp, sensor_type string, state string")
    got = [(r.event_id, r.occupied, r.confidence, r.reason) for r in bathroom.bathroom_states(df).orderBy("event_id").collect()]
    assert got == [
        (0, True, 0.6, "entrance_trigger"),
        (1, True, 0.95, "door_closed_after_entrance"),
        (2, True, 0.3, "already_occupied"),
        (3, True, 0.5, "state_maintained"),
        (4, False, 0.8, "door_opened_after_duration"),
        (6, True, 0.6, "entrance_trigger"),
        (7, False, 0.7, "entrance_clear"),
    ]


def test_streams_equal_batches(spark, sf):
    key = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert key(registry.QUERIES["t08_bathroom_machine"](spark, sf)) == key(registry.QUERIES["w15_bathroom_machine"](spark, sf))
    v = base.Views(spark, sf)
    x = v.se.select("room", "event_id", "ts", (F.col("k") / 100.0).alias("x"))
    want = []
    for _, rows in x.toPandas().sort_values(["ts", "event_id"]).groupby("room"):
        ph, ks, quiet = drift.PageHinkley(), drift.KolmogorovSmirnov(), drift.Cooldown()
        for r in rows.itertuples():
            a, b = ph.add(r.x), ks.add(r.x)
            if (a or b) and quiet.add(r.ts.value / 1e9):
                want.append(r.event_id)
    assert sorted(r.event_id for r in registry.QUERIES["t09_drift_alerts"](spark, sf).collect()) == sorted(want)


def test_upsert_and_bad_messages(spark):
    rows = [(dt.datetime(2024, 1, 1), "a", "x", 1), (dt.datetime(2024, 1, 1), "a", "y", 3), (dt.datetime(2024, 1, 1), "a", "z", 2), (dt.datetime(2024, 1, 2), "a", None, 1)]
    df = spark.createDataFrame(rows, "ts timestamp, entity_id string, state string, seq long")
    assert {(r.ts.day, r.state) for r in tables.last_write_wins(df, ["ts", "entity_id"], "seq", {"state": "none"}).collect()} == {(1, "y"), (2, "none")}
    raw = ['{"event_id":1,"ts":"2024-01-01 00:00:00","state":"on"}', '{"event_id":2,"ts":', '{"ts":"2024-01-01 00:00:00"}', '{"event_id":3,"ts":"never"}', '{"event_id":4,"ts":"2024-01-01T00:00:00","state":5}']
    parsed = so.parsed(spark.createDataFrame([(r,) for r in raw], "value string"), so.EVENT)
    assert sorted(r.event_id for r in so.good(parsed).collect()) == [1, 4]
    assert sorted(r.reason for r in so.dead_letters(parsed).collect()) == ["malformed", "missing event_id", "missing ts"]


def test_write_and_read_events(spark, events, tmp_path):
    tables.write_events(events, str(tmp_path / "e"))
    back = tables.between(spark.read.parquet(str(tmp_path / "e")), F.lit("2024-01-03").cast("timestamp_ntz"), F.lit("2024-01-05").cast("timestamp_ntz"))
    assert back.count() == events.where("ts between timestamp_ntz'2024-01-03' and timestamp_ntz'2024-01-05'").count()
    assert "PartitionFilters: [isnotnull(event_date" in back._jdf.queryExecution().toString()


def test_invariants(spark, sf, events):
    v = base.Views(spark, sf)
    from tidelark.plans.scoring_queries import scores

    sums = scoring.model_weights(scores(v)).groupBy("room").agg(F.sum("weight").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in sums)
    p = scoring.ensemble(scores(v), scoring.model_weights(scores(v)), ["event_id"])
    assert p.where("probability not between 0 and 1 or uncertainty not between 0 and 1 or agreement not between 0 and 1").isEmpty()
    stays = occupancy.presence_periods(events)
    w = W.partitionBy("room").orderBy("start_ts")
    assert stays.withColumn("p", F.lag("end_ts").over(w)).where("start_ts < p").isEmpty()
    assert patterns.WINDOWS[0] == 1 and len(patterns.WINDOWS) == 120


def test_breakpoints_and_votes(spark):
    rows = [("a", h, acc) for h, acc in ((10, 0.5), (20, 0.9), (30, 0.6), (40, 0.8), (50, 0.7), (300, 0.95), (310, 0.1))] + [("b", 10, 0.5), ("b", 20, 0.7), ("b", 30, 0.5), ("c", 10, 0.5)]
    curve = spark.createDataFrame(rows, "room string, horizon int, accuracy double")
    got = {}
    for r in series.breakpoints(curve, ["room"]).collect():
        got.setdefault(r.room, set()).add(r.horizon)
    assert got["a"] == {20, 40} and got["c"] == {15, 120}
    votes = spark.createDataFrame([("a", 60)] * 3 + [("a", 45), ("a", 50)], "room string, horizon int")
    assert {r.horizon for r in series.merged_votes(votes, ["room"]).collect()} == {15, 45, 60, 120}


def test_named_places(spark):
    from tidelark.functions import enrich

    ids = ["presence_livingroom_full", "kitchen_pressence_sink", "guest_bedroom_x", "small_bathroom_door_contact", "office_humidity", "attic"]
    df = spark.createDataFrame([(i,) for i in ids], "entity_id string").select(enrich.room_of().alias("room"), enrich.room_of(strict_reference=True).alias("strict"), enrich.sensor_type_of().alias("kind"), enrich.zone_info().alias("z"))
    got = df.collect()
    assert [r.room for r in got] == ["livingroom", "kitchen", "guest_bedroom", "small_bathroom", "office", "unknown"]
    assert got[2].strict == "bedroom"
    assert [r.kind for r in got] == ["presence", "presence", "unknown", "door", "humidity", "unknown"]
    assert got[0].z.related_subzones == ["livingroom_couch"] and got[1].z.specific_location == "sink" and got[5].z.zone == "main"


def test_registry_versions_and_retraining(spark):
    empty = spark.createDataFrame([], "model_id string, room string, model_type string, version long, parent string, metrics double, created_at timestamp")
    one = spark.createDataFrame([("r", "tree", 0.5, dt.datetime(2024, 1, 1)), ("r", "tree", 0.6, dt.datetime(2024, 1, 2))], "room string, model_type string, metrics double, created_at timestamp")
    got = {r.model_id: (r.parent, r.is_active) for r in learning.register(empty, one).collect()}
    assert got == {"r_tree_v1": (None, False), "r_tree_v2": ("r_tree_v1", True)}


def test_pet_rule(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=s), "p", f"r{i % 3}", "full") for i, s in enumerate((0, 0.2, 0.4, 20, 120, 121, 200))]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, person string, room string, zone_type string")
    got = [(r.length, r.simultaneous, r.fast, r.is_pet) for r in movement.sequence_features(df).orderBy("session").collect()]
    assert got == [(4, 2, 2, True), (2, 0, 1, False), (1, 0, 0, False)]


def test_interval_join_keeps_repeated_rows(spark):
    """Equal left rows stay, whatever the kind of join, and a row without a time has no match; against plain loops."""
    import itertools

    base = dt.datetime(2024, 1, 1)
    at = lambda s: base + dt.timedelta(seconds=s)
    left = [("a", at(s)) for s in (0, 0, 50, 100, 100, 400)] + [("b", at(10)), ("b", at(10)), ("a", None)]
    right = [("a", at(s)) for s in (20, 120, 121, 399)] + [("c", at(10)), ("b", None)]
    l, r = spark.createDataFrame(left, "k string, t timestamp"), spark.createDataFrame(right, "k string, u timestamp")
    near = lambda x, y: x[0] == y[0] and x[1] is not None and y[1] is not None and -1 <= (y[1] - x[1]).total_seconds() <= 70
    got = lambda how: collections.Counter(map(tuple, temporal.interval_join(l, r, ["k"], "t", "u", -1, 70, how).collect()))
    assert got("inner") == collections.Counter((*x, y[1]) for x, y in itertools.product(left, right) if near(x, y))
    assert got("left_semi") == collections.Counter(x for x in left if any(near(x, y) for y in right))
    assert got("left_anti") == collections.Counter(x for x in left if not any(near(x, y) for y in right))


def test_last_write_wins_breaks_ties_alike(spark):
    rows = [(1, 5, "a"), (1, 5, "b"), (1, 4, "c"), (2, None, "d"), (None, 1, "e"), (None, 2, None)]
    a = spark.createDataFrame(rows, "k int, seq int, x string")
    b = spark.createDataFrame(rows[::-1], "k int, seq int, x string")
    one, two = (sorted(map(tuple, tables.last_write_wins(d, ["k"], "seq", {"x": "none"}).collect()), key=str) for d in (a, b))
    assert one == two and [r[:2] for r in one] == [(1, 5), (2, None), (None, 2)] and one[2][2] == "none"


def test_the_statistic_is_looked_at_only_near_the_limit(monkeypatch):
    """Alarms are those of the statistic at every row, also with ties; it is worked out for a fraction of the rows."""
    rnd, looked = random.Random(4), []
    monkeypatch.setattr(drift, "accumulate", lambda xs: looked.append(1) or itertools.accumulate(xs))
    xs = [rnd.choice([rnd.gauss(0, 1), rnd.randrange(3)]) + (i // 900) % 2 for i in range(8_000)]
    fold, got, want, reference, current = drift.KolmogorovSmirnov(), [], [], [], []
    for x in xs:
        got.append(fold.add(x))
        alarm = False
        if len(reference) < 100:
            reference.append(x)
        else:
            current = [*current, x][-100:]
            if len(current) == 100:
                at = np.searchsorted(np.sort(current), np.sort(reference), "right")
                alarm = max(abs(np.arange(1, 101) / 100 - at / 100)) > 1.36 * np.sqrt(2 / 100)
                if alarm:
                    reference, current = current, []
        want.append(bool(alarm))
    assert got == want and sum(want) >= 8 and len(looked) < len(xs) / 3


def test_folds_carry_their_state_over_batches(spark):
    """Small Arrow batches, several keys in one task, null keys: against one fold for each key."""
    rng = np.random.default_rng(1)
    rows = [([None, "a", "b"][i % 3], i, float(rng.normal(0 if i < 400 else 2))) for i in range(900)]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        frame = spark.createDataFrame(rows, "k string, i int, x double")
        got = {r.i: r.alarm for r in drift.folded(frame, ["k"], ["i"], "x", drift.KolmogorovSmirnov).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want = {}
    for key in (None, "a", "b"):
        fold = drift.KolmogorovSmirnov()
        want |= {i: fold.add(x) for k, i, x in rows if k == key}
    assert got == want and sum(want.values()) >= 3


def test_refit_saves_and_registers_the_rooms_that_are_due(spark, tmp_path):
    now = dt.datetime(2024, 1, 29, 12)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(240):
        label = float(rng.integers(2))
        rows.append((i, now - dt.timedelta(hours=i), ["due", "fine"][i % 2], "door", label, label, *[0.0] * (len(learning.NUMERIC) - 1)))
    schema = "event_id long, ts timestamp_ntz, room string, sensor_type string, label double, " + ", ".join(f"{c} double" for c in learning.NUMERIC)
    frame = spark.createDataFrame(rows, schema)
    results = spark.createDataFrame([(room, now - dt.timedelta(minutes=m), score) for room, score in (("due", 0.2), ("fine", 0.9)) for m in range(8)], "room string, ts timestamp_ntz, accuracy_score double")
    none = spark.createDataFrame([], "model_id string, room string, model_type string, version long, parent string, metrics double, created_at timestamp_ntz")
    once = learning.refit(frame, results, none, now, str(tmp_path), "tree", more_than=5)
    assert [(r.model_id, r.metrics, r.is_active) for r in once.collect()] == [("due_tree_v1", float(sum(r[2] == "due" and r[1] > now - dt.timedelta(days=7) for r in rows)), True)]
    later = now + dt.timedelta(hours=1)
    twice = learning.refit(frame, results, once, later, str(tmp_path), "tree", more_than=5)
    assert {(r.model_id, r.is_active) for r in twice.collect()} == {("due_tree_v1", False), ("due_tree_v2", True)}
    scored = learning.score({"tree": learning.load_active(twice, str(tmp_path), "due", "tree")}, frame.where("room = 'due'"))
    assert learning.accuracy(scored, ["model_name"]).first().accuracy == 1.0
    with pytest.raises(LookupError):
        learning.load_active(twice, str(tmp_path), "fine", "tree")
    nothing = learning.refit(frame, results.where("room = 'fine'"), none, now, str(tmp_path), "tree", more_than=5)
    assert nothing.count() == 0


def test_stream_join_has_buckets_as_keys(spark):
    """Pairs at both ends of the range, at bucket edges and before 1970, each once; buckets are keys of the join."""
    at = [-700, -300, 0, 1, 299, 300, 301, 599, 600, 601, 900, 1_200, 7_000]
    rows = spark.createDataFrame([(i, r, t) for i, (r, t) in enumerate(itertools.product("ab", at))], "event_id long, room string, s long")
    p = rows.select("event_id", "room", F.timestamp_seconds("s").alias("predicted_for"), F.lit(0.5).alias("probability"))
    o = rows.select("room", F.timestamp_seconds("s").alias("ts"), (F.col("s") % 2 == 0).alias("occupied"))
    found = so.interval_matches(p, o)
    want = sorted((i, r, t % 2 == 0) for i, (r, u) in enumerate(itertools.product("ab", at)) for t in at if abs(t - u) <= 300)
    assert sorted((r.event_id, r.room, r.occupied) for r in found.collect()) == want
    assert "p_in" in found._jdf.queryExecution().optimizedPlan().toString()


def test_features_are_written_once(spark, sf):
    """What fits and scorings read is a table, not the windows and joins that made it."""
    v = base.Views(spark, sf)
    rows = learning.labelled(v.se, v.oc, [15])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and rows.count() > 100


def test_outcome_is_the_nearest_without_pairs(spark):
    """Ties in distance go to the earlier time, those in time to the least id; nothing beyond the tolerance; rows without a time or a room have none."""
    rnd = random.Random(5)
    seen = [(i, rnd.choice(["a", "b", None]), rnd.choice([None, *range(-900, 9_000, 50)]), rnd.random() < 0.5) for i in range(400)]
    asked = [(i % 250, rnd.choice(["a", "b", "c", None]), rnd.choice([None, *range(-1_500, 12_000, 25)]), rnd.random()) for i in range(300)]
    stamp = lambda df, c: df.withColumn(c, F.timestamp_seconds(c))
    oc = stamp(spark.createDataFrame(seen, "event_id long, room string, ts long, occupied boolean"), "ts")
    pr = stamp(spark.createDataFrame(asked, "event_id long, room string, predicted_for long, probability double"), "predicted_for")
    found = occupancy.with_outcome(pr, oc)

    def nearest(room, at):
        near = [(abs(t - at), t, i, o) for i, r, t, o in seen if None not in (at, t, room) and r == room and abs(t - at) <= 300]
        return min(near)[3] if near else None

    assert collections.Counter((r.event_id, r.room, r.probability, r.actual_outcome) for r in found.collect()) == collections.Counter((i, r, p, nearest(r, t)) for i, r, t, p in asked)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_outcome_sorts_numbers_only(spark):
    """Rows that are sorted for the nearest outcome carry an observation as a number (F16, F17); unknown states and times before 1970 come back from it."""
    oc = spark.createDataFrame([(0, "a", -7, True), (1, "a", -7, False), (2, "a", -1_000, False), (3, "a", 900, None), (4, "a", 1_500, True)], "event_id long, room string, ts long, occupied boolean")
    pr = spark.createDataFrame([(i, "a", t, 0.25) for i, t in enumerate((-1_001, -7, 0, 900, 1_200, 1_201))], "event_id long, room string, predicted_for long, probability double")
    found = occupancy.with_outcome(pr.withColumn("predicted_for", F.timestamp_seconds("predicted_for")), oc.withColumn("ts", F.timestamp_seconds("ts")))
    assert sorted((r.event_id, r.actual_outcome, r.prediction_error) for r in found.collect()) == [(0, False, 0.25), (1, True, 0.75), (2, True, 0.75), (3, None, None), (4, None, None), (5, True, 0.75)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "struct" not in plan[plan.index("Window ") :]


def test_outcome_takes_one_sort_and_all_partitions(spark):
    """A task sorts its rows once, and a small shuffle isn't merged into a few tasks whose sorts grow with it (F17); of many observations at one time the least id counts, before and after."""
    times, ids = (-200, 0, 90, 100), list(range(40))
    random.Random(3).shuffle(ids)
    oc = spark.createDataFrame([(i, r, times[i % 4], r == "a" if i < 4 else i % 3 == 0) for r in "ab" for i in ids], "event_id long, room string, ts long, occupied boolean")
    pr = spark.createDataFrame([(r, t, 0.25) for r in "ab" for t in (-200, -190, -101, -99, 40, 50, 95, 96, 400, 401)], "room string, predicted_for long, probability double")
    found = occupancy.with_outcome(pr.withColumn("predicted_for", F.timestamp_seconds("predicted_for")), oc.withColumn("ts", F.timestamp_seconds("ts")))
    assert found._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert sorted((r.room, r.actual_outcome) for r in found.collect() if r.actual_outcome is not None) == [("a", True)] * 9 + [("b", False)] * 9
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["e09_health", "e10_adaptation_triggers"])
def test_metrics_find_outcomes_once(spark, sf, name):
    """Rates and mean confidence come from one pass over the outcomes, not from two that are joined (F18, F19)."""
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 2 and "Join" not in plan  # the predictions and the occupancy


def test_triggers_sort_once(spark, sf):
    """The adaptation triggers' outcomes take one sort of rows dealt to a number of partitions that isn't merged (F19)."""
    plan = registry.QUERIES["e10_adaptation_triggers"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("REPARTITION_BY_NUM") == 1


def labelled_rows(spark, n=400, label=lambda a, b: float(a > 0.5 and b > 0.5)):
    """Rows an hour apart whose label is a rule over two values, which the features repeat, as a forest's node sees 5 of 25."""
    rng, rows, start = np.random.default_rng(4), [], dt.datetime(2024, 1, 1)
    for i in range(n):
        a, b = (float(rng.integers(2)) for _ in range(2))
        rows.append((i, start + dt.timedelta(hours=i), f"r{i % 2}", "door", 15, label(a, b), *[(a, b)[j % 2] for j in range(len(learning.NUMERIC))]))
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, room string, sensor_type string, horizon_minutes int, label double, " + ", ".join(f"{c} double" for c in learning.NUMERIC)), rows


def test_classifiers_learn_a_known_rule(spark):
    frame, rows = labelled_rows(spark)
    train, test = learning.split_by_time(frame)
    cut = rows[0][1] + 0.75 * (rows[-1][1] - rows[0][1])
    assert (train.count(), test.count()) == (sum(r[1] <= cut for r in rows), sum(r[1] > cut for r in rows))
    scored = learning.score(learning.fit_ensemble(train), test).cache()
    truth = {r[0]: r[5] for r in rows}
    assert all(r.p == truth[r.event_id] for r in scored.where("model_name = 'tree'").collect())
    assert all((r.p > 0.5) == (truth[r.event_id] > 0.5) for r in scored.where("model_name = 'forest'").collect())
    got = {r.model_name: (r.accuracy, r.n) for r in learning.accuracy(scored, ["horizon_minutes", "model_name"]).collect()}
    assert got["tree"] == got["forest"] == (1.0, test.count()) and got["logistic"][0] >= 0.9


def test_search_ranks_settings_by_what_they_can_express(spark):
    frame, rows = labelled_rows(spark)
    got = {r.params: r.perf for r in learning.search(frame, {"tree": [{"maxDepth": 0}, {"maxDepth": 1}, {"maxDepth": 2}, {"maxDepth": 2, "minInstancesPerNode": 1000}]}).collect()}
    late = [r for r in rows if r[1] > rows[0][1] + 0.75 * (rows[-1][1] - rows[0][1])]
    none = sum(r[5] == 0 for r in late) / len(late)  # what saying no gives: one half of the rule alone is no better
    assert got == {"maxDepth=0": none, "maxDepth=1": got["maxDepth=1"], "maxDepth=2": 1.0, "maxDepth=2,minInstancesPerNode=1000": none}
    assert none <= got["maxDepth=1"] < 1.0
    assert sum(len(x) for x in learning.GRID.values()) == 28


def test_prefix_span_against_all_subsequences(spark):
    import itertools
    import math

    rng = np.random.default_rng(8)
    sessions = [[str(x) for x in rng.choice(list("abc"), rng.integers(1, 7))] for _ in range(40)]
    frame = spark.createDataFrame([([[x] for x in s],) for s in sessions], "sequence array<array<string>>")
    want = {}
    for s in sessions:
        for p in {c for n in (1, 2, 3) for c in itertools.combinations(s, n)}:
            want["->".join(p)] = want.get("->".join(p), 0) + 1
    for least in (0.1, 0.35):
        got = {r.pattern: r.freq for r in patterns.prefix_span(frame, least, 3).collect()}
        assert got == {p: n for p, n in want.items() if n >= math.ceil(least * 40)} and got


def test_pruned_versions_take_their_pipelines_along(spark, tmp_path):
    now = dt.datetime(2024, 1, 29, 12)
    frame, _ = labelled_rows(spark, 700)
    none = spark.createDataFrame([], "model_id string, room string, model_type string, version long, parent string, metrics double, created_at timestamp_ntz")
    bad = lambda *rooms: spark.createDataFrame([(room, now - dt.timedelta(minutes=m), 0.1) for room in rooms for m in range(8)], "room string, ts timestamp_ntz, accuracy_score double")
    registry, times = none, [now + dt.timedelta(hours=h) for h in range(3)]
    for at, rooms in zip(times, (("r0", "r1"), ("r0",), ("r0",)), strict=True):
        registry = learning.refit(frame, bad(*rooms), registry, at, str(tmp_path), "tree", more_than=5)
    first = registry.where("version = 1 and room = 'r0'").first()
    mine = [r.ts for r in frame.where("room = 'r0'").collect() if now - dt.timedelta(days=7) < r.ts <= now]
    assert (first.train_start, first.train_end, first.metrics) == (min(mine), max(mine), float(len(mine)))
    left = learning.prune(registry, str(tmp_path), 1)
    assert {(r.model_id, r.is_active) for r in left.collect()} == {("r0_tree_v3", True), ("r1_tree_v1", True)}
    there = [(tmp_path / "tree" / f"{t:%Y%m%dT%H%M%S}").exists() for t in times]
    assert there == [True, False, True]  # the first is still r1's
    learning.load_active(left, str(tmp_path), "r1", "tree")


def test_last_errors_are_the_newest_with_a_running_count(spark):
    letters = spark.createDataFrame([(f"m{i}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i // 2), "malformed") for i in range(9)], "value string, arrived timestamp, reason string")
    assert sorted((r.failed, r.value) for r in so.last_errors(letters, 3).collect()) == [(7, "m6"), (8, "m7"), (9, "m8")]
    assert so.last_errors(letters.where("false"), 3).count() == 0


@pytest.mark.parametrize("kinds, lengths, least", [(3, [2, 3, 7, 40, 100], 1), (3, list(range(2, 20)), 3), (200, [1, 2, 5, 9], 2), (1, [4, 70], 1)])
def test_ngrams_are_counted_without_joins_of_places(spark, monkeypatch, kinds, lengths, least):
    """Equal to counting tuples, over null tokens and keys and many chunks; places aren't joined with places, nor written once for each length (F10, F22)."""
    draw = random.Random(kinds)
    rows = [(draw.choice(["a", "b", None]), i, f"x{min(draw.randrange(kinds), draw.randrange(kinds))}" if i % 97 else None) for i in range(900)]
    events = spark.createDataFrame(rows, "room string, event_id long, x string").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 100))
    written, keep = [], patterns.kept
    monkeypatch.setattr(patterns, "CHUNK", 16)
    monkeypatch.setattr(patterns, "kept", lambda df: written.append(df) or keep(df))
    tokens = patterns.numbered_tokens(events, F.col("x"))
    found = patterns.ngram_counts(tokens, lengths, least)
    plan = found._jdf.queryExecution().executedPlan().toString() + "".join(df._jdf.queryExecution().executedPlan().toString() for df in written[1:])
    want, first = collections.Counter(), {}
    for room in ("a", "b", None):
        line = [x for r, _, x in rows if r == room]
        for n in lengths:
            for i in range(len(line) - n + 1):
                gram = tuple(line[i : i + n])
                if None not in gram:
                    want[room, n, gram] += 1
                    first.setdefault((room, n, gram), i + 1)
    got = sorted(map(str, ((r._k["room"], r.n, r._n, r.frequency) for r in found.collect())))
    assert got == sorted(map(str, ((room, n, first[room, n, g], f) for (room, n, g), f in want.items() if f >= least)))
    assert len(written) <= 3 and "SortMergeJoin" not in plan


def test_long_ngrams_are_counted_by_windows_over_one_sort(spark):
    """No table of the long n-grams is held in memory: only the shorter ones are aggregated, twice (F22)."""
    rows = [("a", i, "xyz"[i * i % 7 % 3]) for i in range(400)]
    tokens = spark.createDataFrame(rows, "room string, _n long, x string").select(F.struct("room").alias("_k"), F.col("_n") + 1, "x").toDF("_k", "_n", "x")
    found = patterns.ngram_counts(tokens, [2, 5, 31, 32, 63, 90])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate(") == 4 and plan.count("Sort [") == 1
    line = [x for _, _, x in rows]
    want = collections.Counter((n, tuple(line[i : i + n])) for n in (2, 5, 31, 32, 63, 90) for i in range(len(line) - n + 1))
    assert sorted((r.n, r.frequency) for r in found.collect()) == sorted((n, f) for (n, _), f in want.items())
