"""W: window functions, sequences and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelark.operators import bathroom, drift, movement, occupancy, series, temporal
from tidelark.plans import fold_sql
from tidelark.plans.base import AS_OF, query, r6, when_is

T = f"TIMESTAMP '{AS_OF}'"
E = "PARTITION BY entity_id ORDER BY ts, event_id"
SECS = "(epoch_us({a}) - epoch_us({b}))/1e6"


@query("w01_time_delta", f"SELECT event_id, round({SECS.format(a='ts', b=f'lag(ts) OVER ({E})')}, 6) AS delta_s FROM se")
def _(v):
    return temporal.lagged(v.se, ["entity_id"], "ts", [1]).select("event_id", r6(temporal.seconds_between("ts", "ts_lag_1")).alias("delta_s"))


@query("w02_trailing_counts", "SELECT event_id, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW) AS all_30m, count(*) OVER (PARTITION BY room ORDER BY ts RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW) AS room_30m, count(*) OVER (PARTITION BY sensor_type ORDER BY ts RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW) AS type_30m FROM se")
def _(v):
    rows = v.se.select("event_id", "ts", "room", "sensor_type")
    out = temporal.nearby(rows, 1800, 0, {"all_30m": temporal.Counted(), "room_30m": temporal.Counted(keys=("room",)), "type_30m": temporal.Counted(keys=("sensor_type",))})
    return out.select("event_id", "all_30m", "room_30m", "type_30m")


@query("w03_since_previous", f"SELECT event_id, round({SECS.format(a='ts', b='lag(ts) OVER (ORDER BY ts, event_id)')}, 6) AS since_s FROM se")
def _(v):
    return temporal.neighbour(v.se.select("event_id", "ts"), ["ts"]).select("event_id", r6(temporal.seconds_between("ts", "prev_ts")).alias("since_s"))


@query("w04_cross_room", "SELECT a.event_id, count(*) FILTER (b.room <> a.room) AS cross_room FROM se a JOIN se b ON b.ts BETWEEN a.ts - INTERVAL 5 SECOND AND a.ts + INTERVAL 5 SECOND GROUP BY 1")
def _(v):
    return movement.concurrent_counts(v.se).select("event_id", "cross_room")


@query("w05_lag_features", f"SELECT event_id, lag(state, 1) OVER ({E}) AS s1, lag(state, 5) OVER ({E}) AS s5, lag(state, 15) OVER ({E}) AS s15, count(*) FILTER (state = 'on') OVER (PARTITION BY room ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS on_1h, count(*) FILTER (state = 'on') OVER (PARTITION BY room ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS on_6h FROM se")
def _(v):
    out = temporal.lagged(v.se, ["entity_id"], "state", [1, 5, 15])
    on = F.col("state") == "on"
    out = temporal.nearby(out, 6 * 3600, 0, {"on_1h": temporal.Counted(on, before_s=3600), "on_6h": temporal.Counted(on)}, keys=("room",))
    return out.select("event_id", F.col("state_lag_1").alias("s1"), F.col("state_lag_5").alias("s5"), F.col("state_lag_15").alias("s15"), "on_1h", "on_6h")


@query("w06_subzone_transitions", f", x AS (SELECT *, lead(zone) OVER w AS nz, lead(state) OVER w AS ns, lead(ts) OVER w AS nt FROM se WHERE zone_type = 'subzone' AND person IS NOT NULL WINDOW w AS (PARTITION BY person ORDER BY ts, event_id)) SELECT event_id, zone AS from_zone, nz AS to_zone, round({SECS.format(a='nt', b='ts')}, 6) AS dt_s FROM x WHERE state = 'on' AND ns = 'on' AND zone <> nz")
def _(v):
    return movement.subzone_transitions(v.se.where("person is not null"), "person").select("event_id", "from_zone", "to_zone", r6("dt_s").alias("dt_s"))


@query("w07_granularity", ", x AS (SELECT event_id, zone_type AS a, lead(zone_type) OVER (ORDER BY ts, event_id) AS b FROM se) SELECT event_id, CASE WHEN a = 'subzone' AND b = 'subzone' THEN 'precise' WHEN a = 'full' AND b = 'full' THEN 'general' WHEN a IN ('full','subzone') AND b IN ('full','subzone') THEN 'hybrid' END AS granularity FROM x")
def _(v):
    return movement.granularity(v.se.select("event_id", "ts", "zone_type")).select("event_id", "granularity")


@query("w08_sequential_activations", f", x AS (SELECT event_id, ts, entity_id, lead(entity_id) OVER w AS next_entity, lead(ts) OVER w AS nt FROM se WINDOW w AS (PARTITION BY epoch_us(ts) // 60000000 ORDER BY ts, event_id)) SELECT event_id, entity_id, next_entity, round({SECS.format(a='nt', b='ts')}, 6) AS dt_s FROM x WHERE nt > ts AND {SECS.format(a='nt', b='ts')} <= 30")
def _(v):
    return movement.sequential_activations(v.se).select("event_id", "entity_id", "next_entity", r6("dt_s").alias("dt_s"))


@query("w09_quiet_periods", f", x AS (SELECT entity_id, ts, lead(ts) OVER ({E}) AS nt FROM se) SELECT entity_id, ts AS start_ts, nt AS end_ts, round({SECS.format(a='nt', b='ts')}, 6) AS gap_s FROM x WHERE {SECS.format(a='nt', b='ts')} > 3600")
def _(v):
    return movement.quiet_periods(v.se, keys=("entity_id",)).withColumn("gap_s", r6("gap_s"))


@query("w09_quiet_periods_global", f", x AS (SELECT ts, lead(ts) OVER (ORDER BY ts, event_id) AS nt FROM se) SELECT ts AS start_ts, nt AS end_ts, round({SECS.format(a='nt', b='ts')}, 6) AS gap_s FROM x WHERE {SECS.format(a='nt', b='ts')} > 900")
def _(v):
    return movement.quiet_periods(v.se.select("event_id", "ts"), 900).withColumn("gap_s", r6("gap_s"))


@query("w10_velocities", f", x AS (SELECT event_id, {SECS.format(a='ts', b='lag(ts) OVER (PARTITION BY person ORDER BY ts, event_id)')} AS dt FROM se WHERE person IS NOT NULL) SELECT event_id, round(CASE WHEN dt > 0 THEN 1/dt END, 6) AS velocity FROM x")
def _(v):
    return movement.velocities(v.se.where("person is not null"), ("person",)).select("event_id", r6("velocity").alias("velocity"))


def periods_sql(opens, closes, least):
    return f""", m AS (SELECT room, ts, event_id, {opens} AS o FROM se WHERE ({opens}) OR ({closes})), t AS (SELECT * FROM (SELECT *, coalesce(lag(o) OVER (PARTITION BY room ORDER BY ts, event_id), false) AS was FROM m) q WHERE o <> was),
 p AS (SELECT room, o, ts AS start_ts, lead(ts) OVER (PARTITION BY room ORDER BY ts, event_id) AS end_ts FROM t) SELECT room, start_ts, end_ts, round({SECS.format(a='end_ts', b='start_ts')}/60, 6) AS duration_min FROM p WHERE o AND {SECS.format(a='end_ts', b='start_ts')}/60 > {least}"""


BATH = ("(sensor_type = 'entrance' AND state = 'on')", "(sensor_type = 'door' AND state = 'off')", 0.5)


@query("w11_presence_periods", periods_sql("sensor_type = 'presence' AND state = 'on'", "sensor_type = 'presence' AND state = 'off'", 0.1))
def _(v):
    return occupancy.presence_periods(v.se).select("room", "start_ts", "end_ts", r6("duration_min").alias("duration_min"))


@query("w12_bathroom_periods", periods_sql(*BATH))
def _(v):
    return occupancy.bathroom_periods(v.se).select("room", "start_ts", "end_ts", r6("duration_min").alias("duration_min"))


@query("w13_impossible_moves", f""", x AS (SELECT event_id, room, zone, zone_type, ts, lag(room) OVER w AS pr_, lag(zone) OVER w AS pz, lag(zone_type) OVER w AS pt, lag(ts) OVER w AS pts FROM se WINDOW w AS (ORDER BY ts, event_id)), y AS (SELECT *, {SECS.format(a='ts', b='pts')} AS dt FROM x)
SELECT event_id, CASE WHEN room <> pr_ THEN CASE WHEN dt < CASE WHEN (least(room, pr_), greatest(room, pr_)) IN (('bedroom','kitchen')) THEN 4 WHEN (least(room, pr_), greatest(room, pr_)) IN (('bedroom','office'),('kitchen','office')) THEN 3 ELSE 2 END THEN 'inter_room_speed' END
 WHEN zone <> pz AND zone_type = 'subzone' AND pt = 'subzone' THEN CASE WHEN dt < 0.5 OR (dt < 60 AND least(zone, pz) = 'zone_1' AND greatest(zone, pz) = 'zone_4') THEN 'subzone_speed' END WHEN zone_type <> pt THEN 'normal_precision_change' END AS reason FROM y""")
def _(v):
    return movement.impossible_moves(v.se, zone_pairs=[("zone_1", "zone_4", 60.0)]).select("event_id", "reason")


@query("w14_sequence_features", f""", x AS (SELECT *, {SECS.format(a='ts', b='lag(ts) OVER w')} AS dt FROM se WHERE person IS NOT NULL WINDOW w AS (PARTITION BY person ORDER BY ts, event_id)), y AS (SELECT *, sum(CASE WHEN dt > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY person ORDER BY ts, event_id) AS s FROM x)
SELECT person, CAST(s AS BIGINT) AS session, count(*) AS length, round({SECS.format(a='max(ts)', b='min(ts)')}, 6) AS duration_s, count(DISTINCT room) AS rooms, count(*) FILTER (dt <= 600 AND dt < 0.5) AS simultaneous, count(*) FILTER (dt <= 600 AND dt < 2) AS fast FROM y GROUP BY 1, 2""")
def _(v):
    return movement.sequence_features(v.se.where("person is not null"), gap_s=600).select("person", "session", "length", r6("duration_s").alias("duration_s"), "rooms", "simultaneous", "fast")


def bathroom_rows(states):
    return states.withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "confidence": r6("confidence"), "duration_s": F.round("duration_s", 3), "door_probability": r6("door_probability")})


@query("w15_bathroom_machine", fold_sql.BATHROOM + " SELECT * FROM br")
def _(v):
    return bathroom_rows(bathroom.bathroom_states(v.se))


@query("w16_door_probability", ", d AS (SELECT room, state = 'off' AS x, row_number() OVER (PARTITION BY room ORDER BY ts DESC, event_id DESC) - 1 AS age, count(*) OVER (PARTITION BY room) AS n FROM se WHERE sensor_type = 'door') SELECT room, any_value(n) AS n, round(sum(0.1*pow(0.9, age)*CAST(x AS INT)) + 0.5*pow(0.9, any_value(n)), 6) AS ewma FROM d GROUP BY room")
def _(v):
    return series.ewma(v.se.where("sensor_type = 'door'"), ["room"], ["ts", "event_id"], F.col("state") == "off").withColumn("ewma", r6("ewma"))


@query("w17_rolling_accuracy", "SELECT event_id, round(avg(accuracy_score) OVER (PARTITION BY room ORDER BY ts, event_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW), 6) AS room_accuracy, count(*) OVER (PARTITION BY room ORDER BY ts, event_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW) AS n FROM res")
def _(v):
    out = series.rolling(v.res, ["room"], ["ts", "event_id"], 500, {"room_accuracy": F.avg("accuracy_score"), "n": F.count(F.lit(1))})
    return out.select("event_id", r6("room_accuracy").alias("room_accuracy"), "n")


@query("w18_rolling_stats", "SELECT event_id, round(avg(probability) OVER w, 6) AS mean, round(var_pop(probability) OVER w, 6) AS var, round(stddev_pop(probability) OVER w, 6) AS std FROM pr WINDOW w AS (PARTITION BY room ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)")
def _(v):
    out = series.rolling(v.pr, ["room"], ["ts", "event_id"], 1000, {"mean": F.avg("probability"), "var": F.var_pop("probability"), "std": F.stddev_pop("probability")})
    return out.select("event_id", *[r6(c).alias(c) for c in ("mean", "var", "std")])


NEW = ", r AS (SELECT room, accuracy_score AS x, row_number() OVER (PARTITION BY room ORDER BY ts DESC, event_id DESC) AS rn FROM res)"
RES = (["room"], ["ts", "event_id"], "accuracy_score")


@query("w19_trend", NEW + "SELECT room, round(CASE WHEN count(*) < 10 OR avg(x) FILTER (rn > 10) IS NULL THEN 0 ELSE avg(x) FILTER (rn <= 10) - avg(x) FILTER (rn > 10) END, 6)::DOUBLE AS trend FROM r WHERE rn <= 20 GROUP BY room")
def _(v):
    return series.trend(v.res, *RES).withColumn("trend", r6("trend"))


@query("w20_degradation", NEW + "SELECT room, round(avg(x) FILTER (rn <= 5), 6) AS recent, round(avg(x) FILTER (rn BETWEEN 6 AND 10), 6) AS older, (count(*) > 10 AND avg(x) FILTER (rn <= 5) < avg(x) FILTER (rn BETWEEN 6 AND 10) - 0.02) OR avg(x) FILTER (rn <= 10) < 0.75 AS optimize FROM r WHERE rn <= 11 GROUP BY room")
def _(v):
    return series.needs_optimization(v.res, *RES).select("room", r6("recent").alias("recent"), r6("older").alias("older"), "optimize")


@query("w21_relevance_degradation", NEW + ", g AS (SELECT room, count(*) AS n, avg(x) FILTER (rn <= 10) AS a, avg(x) FILTER (rn > 10) AS b FROM r WHERE rn <= 20 GROUP BY room) SELECT room, round((b - a)/b, 6) AS degradation, (b - a)/b > 0.1 AS degraded FROM g WHERE n >= 20 AND b <> 0")
def _(v):
    return series.relevance_degraded(v.res, *RES).withColumn("degradation", r6("degradation"))


@query("w22_stagnation", NEW + "SELECT room, round(stddev_pop(x), 6) AS std, count(*) >= 10 AND stddev_pop(x) < 0.01 AS stagnant FROM r WHERE rn <= 10 GROUP BY room")
def _(v):
    return series.stagnant(v.res, *RES).withColumn("std", r6("std"))


@query("w23_recent_degradation", NEW + "SELECT room, round(avg(x), 6) AS recent, avg(x) < 0.6 AS degraded FROM r WHERE rn <= 5 GROUP BY room")
def _(v):
    return series.recently_bad(v.res, *RES).withColumn("recent", r6("recent"))


@query("w24_z_outliers", ", x AS (SELECT event_id, probability AS p, avg(probability) OVER w AS m, stddev_pop(probability) OVER w AS s, count(*) OVER (PARTITION BY room ORDER BY ts, event_id) AS n FROM pr WINDOW w AS (PARTITION BY room ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT event_id, n < 3 OR abs(CASE WHEN s > 0 THEN (p - m)/s ELSE 0 END) > 2 AS outlier FROM x")
def _(v):
    return series.z_outliers(v.pr, ["room"], ["ts", "event_id"], "probability").select("event_id", "outlier")


@query("w25_prior_deviation", ", x AS (SELECT event_id, k, avg(k) OVER w AS m, count(*) OVER w AS n FROM se WINDOW w AS (PARTITION BY entity_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT event_id, round(m, 6) AS prior_mean, coalesce(n >= 10 AND abs(k - m)/20 > 2, false) AS anomalous FROM x")
def _(v):
    out = series.prior_deviation(v.se, ["entity_id"], ["ts", "event_id"], "k", std=20.0)
    return out.select("event_id", r6("prior_mean").alias("prior_mean"), F.coalesce("anomalous", F.lit(False)).alias("anomalous"))


@query("w26_page_hinkley_first", """, n AS (SELECT room, event_id, ts, k/100.0::DOUBLE AS x, row_number() OVER (PARTITION BY room ORDER BY ts, event_id) AS n FROM se), s AS (SELECT *, sum(x - 0.05) OVER w AS p, sum(x + 0.05) OVER w AS q FROM n WHERE n > 1 WINDOW w AS (PARTITION BY room ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
 m AS (SELECT *, least(0, min(p) OVER w) AS mn, greatest(0, max(q) OVER w) AS mx FROM s WINDOW w AS (PARTITION BY room ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT room, min(event_id) AS event_id FROM m WHERE p - mn > 50 OR mx - q > 50 GROUP BY room""")
def _(v):
    x = v.se.select("room", "event_id", "ts", (F.col("k") / 100.0).alias("x"))
    return drift.page_hinkley_first(x, ["room"], ["ts", "event_id"], "x").select("room", "event_id")


@query("w26_page_hinkley_alarms", fold_sql.ROWS.format(x="k/100.0", where="") + fold_sql.PAGE_HINKLEY + " SELECT room, event_id FROM ph WHERE alarm")
def _(v):
    x = v.se.select("room", "event_id", "ts", (F.col("k") / 100.0).alias("x"))
    return drift.folded(x, ["room"], ["ts", "event_id"], "x", drift.PageHinkley).where("alarm").select("room", "event_id")


@query("w27_adwin", """, n AS (SELECT room, event_id, k::DOUBLE AS x, row_number() OVER (PARTITION BY room ORDER BY ts, event_id) AS n, avg(k) OVER (PARTITION BY room ORDER BY ts, event_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS a, avg(k) OVER (PARTITION BY room ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND 25 PRECEDING) AS b FROM se),
 l AS (SELECT *, CASE WHEN n <= 1000 THEN n ELSE 501 + (n - 1001) % 500 END AS len FROM n), c AS (SELECT *, sum(x) OVER w AS s, sum(x*x) OVER w AS q FROM l WINDOW w AS (PARTITION BY room ORDER BY n)), j AS (SELECT c.*, coalesce(o.s, 0) AS s0, coalesce(o.q, 0) AS q0 FROM c LEFT JOIN c o ON o.room = c.room AND o.n = c.n - c.len)
 SELECT event_id, len AS buffer, coalesce(len >= 50 AND abs(a - b) > 1.0*sqrt(greatest(0, (q - q0)/len - ((s - s0)/len)*((s - s0)/len))), false) AS drift FROM j""")
def _(v):
    x = v.se.select("room", "event_id", "ts", F.col("k").cast("double").alias("x"))
    return drift.adwin(x, ["room"], ["ts", "event_id"], "x", spread=1.0).select("event_id", "buffer", "drift")


@query("w28_ks_blocks", """, n AS (SELECT room, k::DOUBLE AS x, (row_number() OVER (PARTITION BY room ORDER BY ts, event_id) - 1)//100 AS b FROM se), f AS (SELECT room, b FROM n GROUP BY 1, 2 HAVING count(*) = 100), r AS (SELECT n.room, n.b, x, row_number() OVER (PARTITION BY n.room, n.b ORDER BY x) AS i FROM n JOIN f USING (room, b)),
 d AS (SELECT r.room, r.b + 1 AS b, r.i, r.x, (SELECT count(*) FROM r c WHERE c.room = r.room AND c.b = r.b + 1 AND c.x <= r.x) AS c FROM r JOIN f g ON g.room = r.room AND g.b = r.b + 1) SELECT room, CAST(b AS BIGINT) AS block, round(max(abs(i/100.0 - c/100.0)), 6)::DOUBLE AS statistic FROM d GROUP BY 1, 2""")
def _(v):
    x = v.se.select("room", "event_id", "ts", F.col("k").cast("double").alias("x"))
    return drift.ks_blocks(x, ["room"], ["ts", "event_id"], "x").select("room", "block", r6("statistic").alias("statistic"))


@query("w28_ks_alarms", fold_sql.ROWS.format(x="k + 30*((day(ts) - 1)//7)", where="") + fold_sql.KOLMOGOROV + " SELECT room, event_id FROM ks WHERE alarm")
def _(v):
    x = v.se.select("room", "event_id", "ts", (F.col("k") + 30 * F.floor((F.dayofmonth("ts") - 1) / 7)).cast("double").alias("x"))
    return drift.folded(x, ["room"], ["ts", "event_id"], "x", drift.KolmogorovSmirnov).where("alarm").select("room", "event_id")


COMBINED = ", al3 AS (SELECT p.room, p.event_id, p.i, p.alarm AS page_hinkley, k.alarm AS ks, a.alarm AS adwin FROM ph p JOIN ks k ON k.room = p.room AND k.i = p.i JOIN ad a ON a.room = p.room AND a.i = p.i), dr AS (SELECT *, CAST(sum(CAST(page_hinkley OR ks OR adwin AS INT)) OVER (PARTITION BY room ORDER BY i) AS BIGINT) AS drift_count FROM al3) SELECT room, event_id, page_hinkley, ks, adwin, drift_count FROM dr WHERE page_hinkley OR ks OR adwin"


@query("w29_combined_drift", fold_sql.ROWS.format(x="k/100.0", where="") + fold_sql.PAGE_HINKLEY + fold_sql.KOLMOGOROV + fold_sql.ADWIN + COMBINED)
def _(v):
    x = v.se.select("room", "event_id", "ts", (F.col("k") / 100.0).alias("x"))
    return drift.combined(x, ["room"], ["ts", "event_id"], "x").where("drift").select("room", "event_id", "page_hinkley", "ks", "adwin", "drift_count")


@query("w30_alert_cooldown", fold_sql.ROWS.format(x="k", where="WHERE k > 90") + fold_sql.COOLDOWN.format(rows="nx") + " SELECT room, event_id FROM cd WHERE kept")
def _(v):
    a = v.se.where("k > 90").select("room", "event_id", "ts", (temporal.micros("ts") / 1e6).alias("at"))
    return drift.folded(a, ["room"], ["at", "event_id"], "at", drift.Cooldown, "kept").where("kept").select("room", "event_id")


@query("w31_system_drift", ", a AS (SELECT * FROM se WHERE k > 90), x AS (SELECT a.event_id, count(*) AS n_alerts, string_agg(DISTINCT b.room, ',' ORDER BY b.room) AS rooms FROM a JOIN a b ON b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts GROUP BY 1) SELECT * FROM x WHERE n_alerts > 2")
def _(v):
    a = v.se.where("k > 90").select("event_id", "ts", "room")
    return drift.system_alerts(a, more_than=2).select("event_id", "n_alerts", F.array_join("rooms", ",").alias("rooms"))


CURVE = ", cv AS (SELECT room, (k % 24)*10 + 5 AS horizon, avg(numeric_value)/100 AS accuracy FROM se WHERE numeric_value IS NOT NULL GROUP BY 1, 2)"


def curve(v):
    return v.se.where("numeric_value is not null").groupBy("room", ((F.col("k") % 24) * 10 + 5).alias("horizon")).agg((F.avg("numeric_value") / 100).alias("accuracy"))


@query("w32_local_maxima", CURVE + "SELECT room, horizon, round(accuracy, 6) AS accuracy FROM (SELECT *, lag(accuracy) OVER w AS a, lead(accuracy) OVER w AS b FROM cv WINDOW w AS (PARTITION BY room ORDER BY horizon)) q WHERE accuracy > a AND accuracy > b AND accuracy > 0.5")
def _(v):
    return series.local_maxima(curve(v), ["room"], least=0.5).withColumn("accuracy", r6("accuracy"))


BREAKPOINTS = CURVE + """, a AS (SELECT room, unnest(range(1, 240)) AS h FROM (SELECT DISTINCT room FROM cv) q), ip AS (SELECT a.room, a.h AS h, coalesce(max(accuracy) FILTER (cv.horizon = a.h), avg(accuracy) FILTER (abs(cv.horizon - a.h) <= 30), arg_min(accuracy*greatest(0.1, 1 - 0.2*abs(cv.horizon - a.h)/60), (abs(cv.horizon - a.h), cv.horizon)), 0.5) AS a FROM a JOIN cv USING (room) GROUP BY 1, 2),
 b AS (SELECT *, lag(a) OVER w AS b1, lag(a, 2) OVER w AS b2, lead(a) OVER w AS f1 FROM ip WINDOW w AS (PARTITION BY room ORDER BY h)), m AS (SELECT *, coalesce(a > b1 AND a > f1 AND a > 0.6, false) AS peak, coalesce(abs((a - b1) - (b1 - b2)) > 0.1 AND a > 0.5, false) AS bend FROM b), p AS (SELECT *, count(*) FILTER (peak) OVER (PARTITION BY room) AS np FROM m),
 c AS (SELECT room, h, a FROM p WHERE CASE WHEN np >= 2 THEN peak ELSE bend END), n AS (SELECT r.room, count(c.h) AS k, any_value(c.h) AS one FROM (SELECT DISTINCT room FROM m) r LEFT JOIN c USING (room) GROUP BY 1), d AS (SELECT m.room, m.h, m.a FROM m JOIN n USING (room) WHERE (k = 0 AND h IN (15, 120)) OR (k = 1 AND h = CASE WHEN one < 60 THEN 120 ELSE 15 END)),
 u AS (SELECT DISTINCT room, h, a FROM (SELECT * FROM c UNION ALL SELECT * FROM d) q WHERE h BETWEEN 5 AND 240) SELECT room, CAST(h AS INT) AS horizon FROM (SELECT *, row_number() OVER (PARTITION BY room ORDER BY a DESC, h) AS rn FROM u) q WHERE rn <= 3"""


@query("w32_breakpoints", BREAKPOINTS)
def _(v):
    return series.breakpoints(series.interpolated(curve(v), ["room"]), ["room"])


@query("w33_gradient_breaks", CURVE + "SELECT room, nh AS horizon, round(na, 6) AS accuracy FROM (SELECT room, lead(horizon) OVER w AS nh, lead(accuracy) OVER w AS na, abs((lead(accuracy) OVER w - accuracy) - (accuracy - lag(accuracy) OVER w)) AS d FROM cv WINDOW w AS (PARTITION BY room ORDER BY horizon)) q WHERE d > 0.05 AND na > 0.3")
def _(v):
    return series.gradient_breaks(curve(v), ["room"], least_change=0.05, least=0.3).withColumn("accuracy", r6("accuracy"))


INTERPOLATED = CURVE + ", kn AS (SELECT * FROM cv WHERE horizon < 60 OR horizon > 150), a AS (SELECT room, unnest(range(1, 240)) AS h FROM (SELECT DISTINCT room FROM kn) q), ip AS (SELECT a.room, a.h AS horizon, coalesce(max(accuracy) FILTER (kn.horizon = a.h), avg(accuracy) FILTER (abs(kn.horizon - a.h) <= 30), arg_min(accuracy*greatest(0.1, 1 - 0.2*abs(kn.horizon - a.h)/60), (abs(kn.horizon - a.h), kn.horizon)), 0.5) AS accuracy FROM a JOIN kn USING (room) GROUP BY 1, 2)"


@query("w34_interpolated", INTERPOLATED + "SELECT room, CAST(horizon AS INT) AS horizon, round(accuracy, 9) AS accuracy FROM ip")
def _(v):
    return series.interpolated(curve(v).where("horizon < 60 or horizon > 150"), ["room"]).withColumn("accuracy", F.round("accuracy", 9))


@query("w35_stable_horizons", CURVE + ", i AS (SELECT *, accuracy + 0.4 AS acc, row_number() OVER (PARTITION BY room ORDER BY horizon) - 1 AS i FROM cv), w AS (SELECT room, unnest(range(0, 24)) AS w FROM (SELECT DISTINCT room FROM cv) q), g AS (SELECT w.room, w.w, count(*) AS n, var_pop(acc) AS v, avg(acc) AS m, max(horizon) FILTER (i = w.w*5 + 5) AS horizon FROM w JOIN i ON i.room = w.room AND i.i BETWEEN w.w*5 AND w.w*5 + 9 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY w) AS rn FROM g WHERE n = 10 AND v < 0.01 AND m > 0.6) SELECT room, horizon FROM r WHERE rn <= 3")
def _(v):
    return series.stable_horizons(curve(v).withColumn("accuracy", F.col("accuracy") + 0.4), ["room"])


@query("w36_recent_of_entity", f"SELECT event_id, ts, state FROM se WHERE entity_id = 'sensor_3' AND ts BETWEEN {T} - INTERVAL 3 DAY AND {T}")
def _(v):
    start = when_is() - F.make_dt_interval(days=F.lit(3))
    return v.se.where((F.col("entity_id") == "sensor_3") & F.col("ts").between(start, when_is())).select("event_id", "ts", "state")
