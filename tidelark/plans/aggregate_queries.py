"""A: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelark.operators import movement, occupancy, rollups, series
from tidelark.plans.base import AS_OF, query, r6, when_is
from tidelark.plans.window_queries import BATH, periods_sql

T = f"TIMESTAMP '{AS_OF}'"


def rounded(df, *names):
    return df.withColumns({n: r6(n) for n in names})


@query("a01_sensor_hourly", "SELECT date_trunc('hour', ts) AS hour, entity_id, room, sensor_type, count(*) AS n, count(DISTINCT entity_id) AS entities, round(avg(CAST(k > 90 AS INT)), 6) AS anomaly_rate FROM se GROUP BY ALL")
def _(v):
    return rounded(rollups.sensor_hourly(v.se, F.col("k") > 90), "anomaly_rate")


EV = ", m AS (SELECT p.event_id, arg_min(o.occupied, (abs(epoch_us(o.ts) - epoch_us(p.predicted_for)), epoch_us(o.ts), o.event_id)) AS y FROM pr p JOIN oc o ON o.room = p.room AND o.ts BETWEEN p.predicted_for - INTERVAL 5 MINUTE AND p.predicted_for + INTERVAL 5 MINUTE GROUP BY 1), ev AS (SELECT pr.*, m.y, abs(probability - CAST(y AS INT)) AS err FROM pr LEFT JOIN m USING (event_id))"


@query("a02_prediction_hourly", EV + "SELECT date_trunc('hour', ts) AS hour, room, horizon_minutes, round(avg(probability), 6) AS avg_probability, round(avg(uncertainty), 6) AS avg_uncertainty, round(avg(err), 6) AS avg_error, count(*) AS n FROM ev WHERE err IS NOT NULL GROUP BY ALL")
def _(v):
    return rounded(rollups.prediction_hourly(occupancy.with_outcome(v.pr, v.oc)), "avg_probability", "avg_uncertainty", "avg_error")


@query("a03_occupancy_hourly", "SELECT date_trunc('hour', ts) AS hour, room, round(avg(CAST(occupied AS INT)), 6) AS rate, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM oc GROUP BY ALL")
def _(v):
    return rounded(rollups.occupancy_hourly(v.oc), "rate", "avg_confidence")


@query("a04_occupancy_probability", f"SELECT room, round(avg(CAST(occupied AS INT)), 6) AS probability FROM oc WHERE ts BETWEEN {T} - INTERVAL 10 DAY AND {T} GROUP BY room")
def _(v):
    some = v.oc.where(F.col("ts").between(rollups.days_before(when_is(), 10), when_is()))
    return some.groupBy("room").agg(r6(F.avg(F.col("occupied").cast("double"))).alias("probability"))


@query("a05_occupancy_summary", f"SELECT room, count(*) AS n, count(*) FILTER (occupied) AS n_occupied, round(100.0*count(*) FILTER (occupied)/count(*), 2)::DOUBLE AS percent, max(ts) AS last_seen FROM oc WHERE ts > {T} - INTERVAL 1 DAY AND ts <= {T} GROUP BY room")
def _(v):
    return rollups.occupancy_summary(v.oc, when_is())


@query("a06_model_accuracy", EV + f"SELECT model_name, round(avg(1 - err), 6) AS accuracy, count(err) AS n FROM ev WHERE room = 'office' AND ts > {T} - INTERVAL 20 DAY AND ts <= {T} AND err IS NOT NULL GROUP BY 1")
def _(v):
    e = rollups.within(occupancy.with_outcome(v.pr.where("room = 'office'"), v.oc), when_is(), 20).where("prediction_error is not null")
    return e.groupBy("model_name").agg(r6(F.avg(1 - F.col("prediction_error"))).alias("accuracy"), F.count("*").alias("n"))


@query("a07_room_stats", "SELECT room, count(*) AS n, count(DISTINCT entity_id) AS entities, min(ts) AS first, max(ts) AS last FROM se GROUP BY room")
def _(v):
    return rollups.summary(v.se, ["room"], entities=F.count_distinct("entity_id"), first=F.min("ts"), last=F.max("ts"))


@query("a08_person_stats", "SELECT person, count(*) AS n, count(DISTINCT room) AS rooms FROM se WHERE person IS NOT NULL GROUP BY person")
def _(v):
    return rollups.summary(v.se.where("person is not null"), ["person"], rooms=F.count_distinct("room"))


@query("a09_data_quality", "SELECT room, count(*) AS n, round((epoch_us(max(ts)) - epoch_us(min(ts)))/1e6, 6) AS span_s, count(DISTINCT CAST(ts AS DATE)) AS days, round(least(100, count(*)/1e6*100), 6)::DOUBLE AS completeness FROM se GROUP BY room")
def _(v):
    return rounded(rollups.data_quality(v.se), "span_s", "completeness")


@query("a10_room_summary", "SELECT room, count(*) AS n, count(DISTINCT entity_id) AS sensors, count(DISTINCT person) AS people FROM se GROUP BY room ORDER BY n DESC")
def _(v):
    return rollups.summary(v.se, ["room"], sensors=F.count_distinct("entity_id"), people=F.count_distinct("person")).orderBy(F.desc("n"))


@query("a11_sensor_coverage", "SELECT sensor_type, count(*) AS n, count(DISTINCT entity_id) AS sensors, count(DISTINCT room) AS rooms FROM se GROUP BY sensor_type")
def _(v):
    return rollups.summary(v.se, ["sensor_type"], sensors=F.count_distinct("entity_id"), rooms=F.count_distinct("room"))


@query("a12_anomaly_summary", "SELECT CASE WHEN k > 95 THEN 'extreme' ELSE 'high' END AS pattern_type, count(*) AS n, round(avg(k/100.0), 6)::DOUBLE AS avg_score FROM se WHERE k > 90 GROUP BY 1")
def _(v):
    a = v.se.where("k > 90").withColumn("pattern_type", F.when(F.col("k") > 95, "extreme").otherwise("high"))
    return rounded(rollups.summary(a, ["pattern_type"], avg_score=F.avg(F.col("k") / 100.0)), "avg_score")


@query("a13_room_list", "SELECT room, count(*) AS event_count, max(ts) AS last_activity FROM se GROUP BY room ORDER BY room")
def _(v):
    return rollups.summary(v.se, ["room"], last_activity=F.max("ts")).withColumnRenamed("n", "event_count").orderBy("room")


@query("a14_last_activity", "SELECT room, max(ts) AS last_activity FROM se WHERE state = 'on' GROUP BY room")
def _(v):
    return v.se.where("state = 'on'").groupBy("room").agg(F.max("ts").alias("last_activity"))


@query("a15_table_stats", "SELECT 'sensor_events' AS table_name, count(*) AS n, min(ts) AS first, max(ts) AS last FROM se UNION ALL SELECT 'predictions', count(*), min(ts), max(ts) FROM pr")
def _(v):
    return rollups.table_stats({"sensor_events": v.se, "predictions": v.pr})


@query("a16_window_statistics", f"SELECT count(*) AS n, round((epoch_us(max(ts)) - epoch_us(min(ts)))/1e6, 6) AS span_s, count(DISTINCT room) AS rooms, count(DISTINCT entity_id) AS entities FROM se WHERE ts > {T} - INTERVAL 1 DAY AND ts <= {T}")
def _(v):
    return rounded(rollups.window_statistics(rollups.within(v.se, when_is(), 1)), "span_s")


STAYS = ", st AS (SELECT * FROM (WITH " + periods_sql(*BATH).lstrip().lstrip(",").lstrip() + ") q)"


@query("a17_stay_means", STAYS + "SELECT hour(end_ts) AS hour, round(avg(duration_min)*60, 3) AS mean_s, count(*) AS n FROM st GROUP BY 1")
def _(v):
    return occupancy.stay_means(occupancy.bathroom_periods(v.se), "hour").withColumn("mean_s", F.round("mean_s", 3))


@query("a17_stay_means_context", STAYS + "SELECT CASE WHEN hour(end_ts) BETWEEN 6 AND 9 THEN 'morning' WHEN hour(end_ts) BETWEEN 21 AND 23 THEN 'evening' ELSE 'other' END AS context, round(avg(duration_min)*60, 3) AS mean_s, count(*) AS n FROM st GROUP BY 1")
def _(v):
    return occupancy.stay_means(occupancy.bathroom_periods(v.se), "context").withColumn("mean_s", F.round("mean_s", 3))


@query("a18_predicted_durations", STAYS + """, h AS (SELECT hour(end_ts) AS h, avg(duration_min)*60 AS m FROM st GROUP BY 1 HAVING count(*) > 3), c AS (SELECT CASE WHEN hour(end_ts) BETWEEN 6 AND 9 THEN 'morning' WHEN hour(end_ts) BETWEEN 21 AND 23 THEN 'evening' ELSE 'other' END AS c, avg(duration_min)*60 AS m FROM st GROUP BY 1 HAVING count(*) > 3)
SELECT event_id, round(coalesce(h.m, c.m, CASE WHEN hour(ts) BETWEEN 6 AND 9 THEN 180 WHEN hour(ts) BETWEEN 21 AND 23 THEN 300 ELSE 120 END), 3) AS duration_s FROM se LEFT JOIN h ON h.h = hour(ts) LEFT JOIN c ON c.c = CASE WHEN hour(ts) BETWEEN 6 AND 9 THEN 'morning' WHEN hour(ts) BETWEEN 21 AND 23 THEN 'evening' ELSE 'other' END""")
def _(v):
    return occupancy.predicted_durations(v.se.select("event_id", "ts"), occupancy.bathroom_periods(v.se)).select("event_id", F.round("duration_s", 3).alias("duration_s"))


@query("a19_active_rooms", f"SELECT DISTINCT room FROM se WHERE ts > {T} - INTERVAL 1 DAY AND ts <= {T}")
def _(v):
    return rollups.within(v.se, when_is(), 1).select("room").distinct()


@query("a20_room_performance", f", a AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY ts DESC, event_id DESC) AS rn FROM res WHERE ts > {T} - INTERVAL 7 DAY AND ts <= {T}), b AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY ts DESC, event_id DESC) AS rn FROM res WHERE ts > {T} - INTERVAL 1 DAY AND ts <= {T}) SELECT x.*, round(m, 6) AS mean_response_ms FROM (SELECT room, round(avg(accuracy_score), 6) AS mean_accuracy, round(stddev_pop(accuracy_score), 6) AS std_accuracy FROM a WHERE rn <= 100 GROUP BY room) x LEFT JOIN (SELECT room, avg(prediction_time_ms) AS m FROM b WHERE rn <= 100 GROUP BY room) y USING (room)")
def _(v):
    return rounded(rollups.room_performance(v.res, when_is()), "mean_accuracy", "std_accuracy", "mean_response_ms")


@query("a21_recent_accuracy", f"SELECT room, round(avg(accuracy_score) FILTER (ts > {T} - INTERVAL 1 DAY), 6) AS accuracy, count(*) AS samples FROM res WHERE ts > {T} - INTERVAL 7 DAY AND ts <= {T} GROUP BY room")
def _(v):
    day = F.when(F.col("ts") > rollups.days_before(when_is(), 1), F.col("accuracy_score"))
    return rollups.within(v.res, when_is(), 7).groupBy("room").agg(r6(F.avg(day)).alias("accuracy"), F.count("*").alias("samples"))


@query("a22_zone_coverage", "SELECT room, round(CASE WHEN count(*) FILTER (zone_type = 'full') > 0 THEN least(1.0, count(*) FILTER (zone_type = 'subzone')/count(*) FILTER (zone_type = 'full')) ELSE 0 END, 6)::DOUBLE AS coverage FROM se GROUP BY room")
def _(v):
    return rounded(movement.zone_coverage(v.se), "coverage")


@query("a23_importance", ", f AS (SELECT sensor_type || '-' || (k % 7) AS feature, numeric_value/200 AS value, k/100.0 AS error FROM se WHERE numeric_value IS NOT NULL), g AS (SELECT feature, avg(abs(value)*(1 - least(1, abs(error)))) AS importance, count(*) AS n FROM f GROUP BY 1) SELECT feature, round(importance, 6)::DOUBLE AS importance, n, CASE WHEN n > 10 AND importance < 0.1 THEN 'pruned' WHEN n > 10 THEN 'kept' ELSE 'learning' END AS status FROM g")
def _(v):
    return rounded(rollups.importance(feature_rows(v)), "importance")


def feature_rows(v):
    name = F.concat_ws("-", "sensor_type", (F.col("k") % 7).cast("string"))
    return v.se.where("numeric_value is not null").select(name.alias("feature"), (F.col("numeric_value") / 200).alias("value"), (F.col("k") / 100.0).alias("error"), "ts", "event_id")


@query("a24_periodic_entities", ", g AS (SELECT entity_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY entity_id ORDER BY ts, event_id)))/1e6 AS g FROM se) SELECT entity_id, count(*) AS n, round(avg(g), 4) AS mean_gap_s FROM g GROUP BY 1 HAVING count(*) >= 3 AND count(g) >= 3 AND stddev_pop(g) < 0.98*avg(g)")
def _(v):
    return movement.periodic_entities(v.se, most_cv=0.98).select("entity_id", "n", F.round("mean_gap_s", 4).alias("mean_gap_s"))


@query("a25_bursts", ", c AS (SELECT epoch_us(ts) // 300000000 AS bucket, count(*) AS n FROM se GROUP BY 1) SELECT CAST(bucket AS BIGINT) AS bucket, n FROM c WHERE n > (SELECT avg(n) + 2*stddev_pop(n) FROM c)")
def _(v):
    return movement.bursts(v.se)


@query("a26_simultaneous", "SELECT date_trunc('minute', ts) AS minute, count(*) AS n, string_agg(entity_id, ',' ORDER BY entity_id) AS entities FROM se GROUP BY 1 HAVING count(*) >= 2")
def _(v):
    s = v.se.withColumn("minute", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    return movement.simultaneous(s, "minute").select("minute", "n", F.array_join("entities", ",").alias("entities"))


@query("a27_movement_profile", ", x AS (SELECT person, zone, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY person ORDER BY ts, event_id)))/1e6 AS dt FROM se WHERE person IS NOT NULL) SELECT person, count(*) AS n, round(avg(CASE WHEN dt > 0 THEN 1/dt END), 6) AS mean_velocity, count(DISTINCT zone) AS zones FROM x GROUP BY person")
def _(v):
    moves = movement.velocities(v.se.where("person is not null"), ("person",))
    return rounded(rollups.summary(moves, ["person"], mean_velocity=F.avg("velocity"), zones=F.count_distinct("zone")), "mean_velocity")


@query("a28_performance_summary", f"SELECT room, count(*) AS n, round(avg(CAST(probability > 0.5 AS INT)), 6) AS accuracy, count(*) FILTER (confidence > 0.9) AS drifts FROM pr WHERE ts > {T} - INTERVAL 2 DAY AND ts <= {T} GROUP BY ROLLUP (room)")
def _(v):
    r = v.pr.withColumn("correct", F.col("probability") > 0.5).withColumn("drift", F.col("confidence") > 0.9)
    return rounded(rollups.performance_summary(r, when_is(), 2), "accuracy")


CONFUSION = "count(*) AS n, round(1 - (count(*) FILTER ((probability > 0.5) <> y))/count(*), 6) AS accuracy, round(count(*) FILTER (probability > 0.5 AND NOT y)/count(*), 6) AS fp_rate, round(count(*) FILTER (probability <= 0.5 AND y)/count(*), 6) AS fn_rate, round(count(*) FILTER (probability > 0.5 AND y)/nullif(count(*) FILTER (probability > 0.5), 0), 6) AS precision, round(count(*) FILTER (probability > 0.5 AND y)/nullif(count(*) FILTER (y), 0), 6) AS recall, round(2*count(*) FILTER (probability > 0.5 AND y)/nullif(count(*) FILTER (probability > 0.5) + count(*) FILTER (y), 0), 6) AS f1"


@query("a29_confusion", EV + f"SELECT room, model_name, horizon_minutes, {CONFUSION} FROM ev WHERE y IS NOT NULL GROUP BY ALL")
def _(v):
    return rounded(rollups.confusion(occupancy.with_outcome(v.pr, v.oc), ["room", "model_name", "horizon_minutes"]), "accuracy", "fp_rate", "fn_rate", "precision", "recall", "f1")


@query("a30_prediction_metrics", EV + f"SELECT model_name, {CONFUSION} FROM ev WHERE y IS NOT NULL GROUP BY ALL")
def _(v):
    return rounded(rollups.confusion(occupancy.with_outcome(v.pr, v.oc), ["model_name"]), "accuracy", "fp_rate", "fn_rate", "precision", "recall", "f1")


LAST = "SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY ts DESC, event_id DESC) AS rn FROM {t}"


@query("a31_room_metrics", f"SELECT room, count(*) AS n, round(avg(probability), 6) AS mean_accuracy, round(avg(uncertainty), 6) AS mean_score FROM ({LAST.format(k='room', t='pr')}) q WHERE rn <= 100 GROUP BY room")
def _(v):
    return rounded(rollups.summary(series.last_rows(v.pr, ["room"], ["ts", "event_id"], 100), ["room"], mean_accuracy=F.avg("probability"), mean_score=F.avg("uncertainty")), "mean_accuracy", "mean_score")


@query("a32_drift_statistics", f"SELECT room, count(*) FILTER (k % 3 = 0) AS adwin, count(*) FILTER (k % 3 = 1) AS ks, count(*) FILTER (k % 3 = 2) AS page_hinkley FROM se WHERE k > 80 AND ts > {T} - INTERVAL 5 DAY AND ts <= {T} GROUP BY room")
def _(v):
    a = rollups.within(v.se.where("k > 80"), when_is(), 5).withColumn("drift_type", F.element_at(F.array(*map(F.lit, ("adwin", "ks", "page_hinkley"))), F.col("k") % 3 + 1))
    return a.groupBy("room").pivot("drift_type", ["adwin", "ks", "page_hinkley"]).agg(F.count(F.lit(1))).na.fill(0)


@query("a33_feature_statistics", ", f AS (SELECT sensor_type || '-' || (k % 7) AS feature, numeric_value/200 AS value, ts, event_id FROM se WHERE numeric_value IS NOT NULL) SELECT feature, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS least, round(max(value), 6) AS most FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY ts DESC, event_id DESC) AS rn FROM f) q WHERE rn <= 1000 GROUP BY 1")
def _(v):
    out = rollups.recent_summary(feature_rows(v), ["feature"], ["ts", "event_id"], "value", n=1000)
    return rounded(out.select("feature", "n", "mean", "std", "least", "most"), "mean", "std", "least", "most")


@query("a34_merged_votes", ", n AS (SELECT room, (k % 8)*30 + 5 AS horizon, count(*) AS votes FROM se WHERE k % 4 <> 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY votes DESC, horizon) AS rn FROM n), kp AS (SELECT room, horizon FROM r WHERE (votes >= 2 OR rn <= 2) AND rn <= 3), e AS (SELECT room, min(horizon) AS lo, max(horizon) AS hi FROM kp GROUP BY room) SELECT room, horizon FROM kp UNION SELECT room, 15 FROM e WHERE lo > 30 UNION SELECT room, 120 FROM e WHERE hi < 90")
def _(v):
    return series.merged_votes(v.se.where("k % 4 <> 0").select("room", ((F.col("k") % 8) * 30 + 5).alias("horizon")), ["room"])


@query("a35_registry_stats", "SELECT c_mktsegment AS segment, count(*) AS models, CAST(sum(c_custkey) AS BIGINT) AS bytes, max(c_custkey) AS latest_version FROM customer GROUP BY ROLLUP (c_mktsegment)")
def _(v):
    return v.table("customer").rollup(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("models"), F.sum("c_custkey").alias("bytes"), F.max("c_custkey").alias("latest_version"))


@query("a36_correlation", "SELECT room, round(coalesce(CASE WHEN var_pop(epoch_us(ts)/3.6e9) > 0 AND var_pop(probability) > 0 THEN corr(epoch_us(ts)/3.6e9, probability) END, 0), 5)::DOUBLE AS r, count(*) AS n FROM pr GROUP BY room")
def _(v):
    from tidelark.operators.temporal import micros

    return rollups.correlation(v.pr, ["room"], micros("ts") / 3.6e9, F.col("probability")).withColumn("r", F.round("r", 5))


@query("a37_search_statistics", f"SELECT model_name AS strategy, count(*) AS n, round(avg(CAST(probability - 0.5 > 0 AS INT)), 6) AS success_rate, round(avg(probability - 0.5), 6) AS mean_improvement, count(*) FILTER (ts > {T} - INTERVAL 1 DAY) AS last_day FROM pr GROUP BY ROLLUP (model_name)")
def _(v):
    runs = v.pr.select(F.col("model_name").alias("strategy"), (F.col("probability") - 0.5).alias("improvement"), "ts")
    return rounded(rollups.search_statistics(runs, when_is()), "success_rate", "mean_improvement")


@query("a38_hourly_prior", "SELECT p.event_id, round(least(0.8, coalesce(q.rate, 0.3)*CASE WHEN p.confidence > 0.5 THEN 1.2 ELSE 1 END), 6)::DOUBLE AS probability FROM pr p LEFT JOIN (SELECT room, hour(ts) AS h, avg(CAST(occupied AS INT)) AS rate FROM oc GROUP BY ALL) q ON q.room = p.room AND q.h = hour(p.ts)")
def _(v):
    asked = v.pr.select("event_id", "room", F.hour("ts").alias("hour"), (F.col("confidence") > 0.5).alias("active"))
    return rounded(rollups.pattern_prediction(asked, rollups.hourly_activity_prior(v.oc)).select("event_id", "probability"), "probability")


@query("a39_import_statistics", "SELECT 'sensor' AS kind, sensor_type AS name, count(*) AS n FROM se GROUP BY ALL UNION ALL SELECT 'room', room, count(*) FROM se GROUP BY ALL UNION ALL SELECT 'person', person, count(*) FROM se WHERE person IS NOT NULL GROUP BY ALL")
def _(v):
    each = F.array(F.struct(F.lit("sensor").alias("kind"), F.col("sensor_type").alias("name")), F.struct(F.lit("room").alias("kind"), F.col("room").alias("name")), F.struct(F.lit("person").alias("kind"), F.col("person").alias("name")))
    return v.se.select(F.explode(each).alias("x")).where("x.name is not null").groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


@query("a40_value_trend", ", x AS (SELECT model_name, probability AS p, event_id, ts, row_number() OVER (PARTITION BY model_name ORDER BY ts, event_id) AS up, row_number() OVER (PARTITION BY model_name ORDER BY ts DESC, event_id DESC) AS down FROM pr) SELECT model_name, round(max(p) FILTER (down = 1), 6) AS current, round(CASE WHEN count(*) >= 10 THEN avg(p) FILTER (down <= 5) - avg(p) FILTER (up <= 5) ELSE 0 END, 6)::DOUBLE AS trend, round(stddev_pop(p), 6) AS std FROM x GROUP BY 1")
def _(v):
    return rounded(rollups.value_trend(v.pr, ["model_name"], ["ts", "event_id"], "probability"), "current", "trend", "std")


@query("a41_horizon_summary", f"SELECT horizon_minutes, round(avg(probability), 6) AS mean, round(stddev_pop(probability), 6) AS std, count(*) AS n, round(avg(probability) FILTER (rn <= 10), 6) AS newest_mean FROM ({LAST.format(k='horizon_minutes', t='pr')}) q WHERE rn <= 100 GROUP BY 1")
def _(v):
    return rounded(rollups.recent_summary(v.pr, ["horizon_minutes"], ["ts", "event_id"], "probability").drop("least", "most"), "mean", "std", "newest_mean")


@query("a42_room_model_mean", ", a AS (SELECT room, model_name, avg(probability - 0.4) AS acc FROM pr GROUP BY ALL) SELECT room, round(avg(acc) FILTER (acc > 0), 6) AS accuracy FROM a GROUP BY room")
def _(v):
    a = v.pr.groupBy("room", "model_name").agg(F.avg(F.col("probability") - 0.4).alias("acc"))
    return a.groupBy("room").agg(r6(F.avg(F.when(F.col("acc") > 0, F.col("acc")))).alias("accuracy"))


@query("a43_model_evaluation", f"SELECT room, model_name, count(*) AS n, round(avg(probability), 6) AS mean, round(avg(probability) FILTER (rn <= 5), 6) AS newest_mean FROM ({LAST.format(k='room, model_name', t='pr')}) q WHERE rn <= 100 GROUP BY ALL")
def _(v):
    return rounded(rollups.recent_summary(v.pr, ["room", "model_name"], ["ts", "event_id"], "probability", newest=5).select("room", "model_name", "n", "mean", "newest_mean"), "mean", "newest_mean")


