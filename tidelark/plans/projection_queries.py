"""P: projections, filters, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelark.functions import enrich
from tidelark.operators import occupancy, temporal
from tidelark.plans.base import AS_OF, query, r6, when_is

T = f"TIMESTAMP '{AS_OF}'"

#: Ids such as a home has, one for each event: made from its room and type, so that the rules have something to find.
NAMED = """, nm AS (SELECT *, 'binary_sensor.' || CASE user_k WHEN 0 THEN 'presence_livingroom_full' WHEN 1 THEN 'kitchen_pressence_stove' WHEN 2 THEN 'guest_bedroom_temperature' WHEN 3 THEN 'office_desk_light'
 WHEN 4 THEN 'small_bathroom_door_contact' WHEN 5 THEN 'bathroom_entrance' WHEN 6 THEN 'livingroom_couch_presence' WHEN 7 THEN 'bedroom_full_presence' ELSE 'attic_humidity' END || '_' || (k % 3) AS name FROM (SELECT *, k % 9 AS user_k FROM se) q)"""
NAMES = ["presence_livingroom_full", "kitchen_pressence_stove", "guest_bedroom_temperature", "office_desk_light", "small_bathroom_door_contact", "bathroom_entrance", "livingroom_couch_presence", "bedroom_full_presence", "attic_humidity"]


def named(v):
    part = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("k") % 9) + 1)
    return v.se.withColumn("name", F.concat(F.lit("binary_sensor."), part, F.lit("_"), (F.col("k") % 3).cast("string")))


@query("p01_room_of", NAMED + """SELECT event_id, CASE WHEN name LIKE '%livingroom%' THEN 'livingroom' WHEN name LIKE '%kitchen%' THEN 'kitchen' WHEN name LIKE '%guest%' THEN 'guest_bedroom' WHEN name LIKE '%bedroom%' THEN 'bedroom'
 WHEN name LIKE '%office%' THEN 'office' WHEN name LIKE '%small_bathroom%' THEN 'small_bathroom' WHEN name LIKE '%bathroom%' THEN 'bathroom' ELSE 'unknown' END AS found_room FROM nm""")
def _(v):
    return named(v).select("event_id", enrich.room_of("name").alias("found_room"))


@query("p02_sensor_type_of", NAMED + """SELECT event_id, CASE WHEN name LIKE '%presence%' OR name LIKE '%pressence%' THEN 'presence' WHEN name LIKE '%door%' AND name LIKE '%contact%' THEN 'door' WHEN name LIKE '%entrance%' THEN 'entrance'
 WHEN name LIKE '%temperature%' THEN 'temperature' WHEN name LIKE '%humidity%' THEN 'humidity' WHEN name LIKE '%light%' THEN 'light' ELSE 'unknown' END AS found_type FROM nm""")
def _(v):
    return named(v).select("event_id", enrich.sensor_type_of("name").alias("found_type"))


@query("p03_zone_info", NAMED + """SELECT event_id, CASE user_k WHEN 0 THEN 'livingroom_full' WHEN 1 THEN 'kitchen_stove' WHEN 3 THEN 'office_desk' WHEN 6 THEN 'livingroom_couch' WHEN 7 THEN 'bedroom_full' ELSE 'main' END AS zone_name,
 CASE WHEN user_k IN (0, 7) THEN 'full' WHEN user_k IN (1, 3, 6) THEN 'subzone' ELSE 'unknown' END AS zone_kind, CASE user_k WHEN 1 THEN 'stove' WHEN 3 THEN 'desk' WHEN 6 THEN 'couch' END AS spot FROM nm""")
def _(v):
    z = named(v).select("event_id", enrich.zone_info("name").alias("z"))
    return z.select("event_id", F.col("z.zone").alias("zone_name"), F.col("z.zone_type").alias("zone_kind"), F.col("z.specific_location").alias("spot"))


@query("p04_room_merge", "SELECT CASE WHEN room IN ('livingroom','kitchen') THEN 'living_kitchen' ELSE room END AS merged, count(*) AS n FROM se GROUP BY 1")
def _(v):
    return v.se.groupBy(enrich.merged_room().alias("merged")).agg(F.count("*").alias("n"))


@query("p05_transition_class", "SELECT event_id, CASE WHEN state IN ('on','open','detected') THEN 'activation' WHEN state IN ('off','closed','clear') THEN 'deactivation' ELSE 'unknown' END AS transition FROM se")
def _(v):
    return v.se.select("event_id", enrich.transition_class().alias("transition"))


@query("p06_active_flag", "SELECT event_id, CAST(state IN ('on','open','detected') AS INT) AS active FROM se")
def _(v):
    return v.se.select("event_id", enrich.is_active().alias("active"))


@query("p07_numeric_state", "SELECT event_id, TRY_CAST(CASE WHEN k % 5 = 0 THEN 'unavailable' ELSE CAST(k AS VARCHAR) || '.5' END AS DOUBLE) AS reading FROM se")
def _(v):
    text = F.when(F.col("k") % 5 == 0, "unavailable").otherwise(F.concat(F.col("k").cast("string"), F.lit(".5")))
    return v.se.select("event_id", text.alias("text")).select("event_id", enrich.numeric_state("text").alias("reading"))


CAL = "hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, hour(ts)*60 + minute(ts) AS minute_of_day, CAST(isodow(ts) >= 6 AS INT) AS is_weekend, CAST(hour(ts) BETWEEN 6 AND 11 AS INT) AS is_morning, CAST(hour(ts) BETWEEN 12 AND 17 AS INT) AS is_afternoon, CAST(hour(ts) BETWEEN 18 AND 23 AS INT) AS is_evening, CAST(hour(ts) < 6 AS INT) AS is_night"


@query("p08_calendar", f"SELECT event_id, {CAL} FROM se")
def _(v):
    return v.se.select("event_id", *[c.alias(n) for n, c in enrich.calendar().items()])


@query("p09_context_flags", "SELECT event_id, CAST(hour(ts) BETWEEN 6 AND 9 AS INT) AS is_morning_routine, CAST(hour(ts) BETWEEN 21 AND 23 AS INT) AS is_evening_routine FROM se")
def _(v):
    return v.se.select("event_id", *[c.alias(n) for n, c in enrich.context_flags().items()])


@query("p10_cyclical", "SELECT event_id, round(sin(hour(ts)*2*pi()/24), 6) AS hour_sin, round(cos(hour(ts)*2*pi()/24), 6) AS hour_cos, round(sin((isodow(ts)-1)*2*pi()/7), 6) AS day_sin, round(cos((isodow(ts)-1)*2*pi()/7), 6) AS day_cos FROM se")
def _(v):
    return v.se.select("event_id", *[r6(c).alias(n) for n, c in enrich.cyclical().items()])


@query("p11_interactions", "SELECT event_id, hour(ts)*(isodow(ts)-1) AS hour_x_day, CAST(state IN ('on','open','detected') AS INT)*hour(ts) AS state_x_hour FROM se")
def _(v):
    return v.se.select("event_id", *[c.alias(n) for n, c in enrich.interactions().items()])


@query("p12_feature_defaults", "SELECT event_id, coalesce(numeric_value, 0) AS reading, hour(ts) AS hour FROM se")
def _(v):
    named_features = enrich.features(more={"reading": F.col("numeric_value")})
    return v.se.select("event_id", *[named_features[n].alias(n) for n in ("reading", "hour")])


@query("p13_zone_features", NAMED + "SELECT event_id, CAST(user_k IN (0, 7) AS INT) AS is_full_zone, CAST(user_k IN (1, 3, 6) AS INT) AS is_subzone, CAST(CASE WHEN user_k = 7 THEN 0.5 WHEN user_k = 0 THEN 0.7 WHEN user_k IN (1, 3, 6) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS coverage_score FROM nm")
def _(v):
    z = named(v).select("event_id", enrich.zone_info("name").alias("z")).select("event_id", "z.*")
    return z.select("event_id", *[c.alias(n) for n, c in enrich.zone_features().items()])


@query("p14_person_of", "SELECT event_id, CASE WHEN entity_id LIKE '%11%' OR zone LIKE '%11%' THEN '11' WHEN entity_id LIKE '%7%' OR zone LIKE '%7%' THEN '7' END AS found FROM se")
def _(v):
    return v.se.select("event_id", enrich.person_of(["11", "7"]).alias("found"))


@query("p15_cache_key", "SELECT event_id, entity_id || '|' || room || '|' || state || '|' || CAST(epoch_us(ts) // 60000000 AS BIGINT) AS key FROM se")
def _(v):
    return v.se.select("event_id", enrich.cache_key().alias("key"))


@query("p16_significant", "SELECT event_id, feature, value FROM (SELECT event_id, unnest(['k','reading']) AS feature, unnest([CAST(k AS DOUBLE), numeric_value / 10000]) AS value FROM se) q WHERE abs(value) > 0.01")
def _(v):
    return enrich.significant(v.se.withColumn("reading", F.col("numeric_value") / 10000), ["k", "reading"], ["event_id"])


@query("p17_validation", f"SELECT event_id, CASE WHEN k % 10 = 0 THEN 'missing entity_id' WHEN k % 10 = 1 THEN 'missing state' END AS reason, CASE WHEN ts > {T} + INTERVAL 1 HOUR THEN 'future timestamp' END AS warning FROM se")
def _(v):
    odd = v.se.withColumn("entity_id", F.when(F.col("k") % 10 != 0, F.col("entity_id"))).withColumn("state", F.when(F.col("k") % 10 != 1, F.col("state")))
    return enrich.validated(odd, when_is()).select("event_id", "reason", "warning")


@query("p18_preheat", "SELECT event_id, room FROM pr WHERE horizon_minutes = 120 AND probability > 0.7 AND confidence > 0.6")
def _(v):
    return enrich.preheat(v.pr).select("event_id", "room")


@query("p19_precool", """, t AS (SELECT p.*, (SELECT arg_max(numeric_value, ts) FROM se s WHERE s.room = p.room AND s.ts <= p.ts AND s.numeric_value IS NOT NULL AND s.sensor_type = 'door') AS temperature FROM pr p)
SELECT event_id, room, temperature FROM t WHERE horizon_minutes = 15 AND probability > 0.8 AND confidence > 0.7 AND temperature > 25""")
def _(v):
    with_t = temporal.latest_before(v.pr, v.se.where("sensor_type = 'door'"), "room", "numeric_value", out="temperature")
    return enrich.precool(with_t).select("event_id", "room", "temperature")


@query("p20_notable_anomalies", "SELECT event_id FROM se WHERE k > 90 AND NOT (k % 2 = 0)")
def _(v):
    return enrich.notable_anomalies(v.se.withColumn("is_anomaly", F.col("k") > 90).withColumn("is_pet", F.col("k") % 2 == 0)).select("event_id")


@query("p21_like_between", f"SELECT event_id, ts, entity_id FROM se WHERE entity_id LIKE '%sensor_1%' AND ts BETWEEN {T} - INTERVAL 24 HOUR AND {T} ORDER BY ts DESC, event_id DESC LIMIT 100")
def _(v):
    day = when_is() - F.make_dt_interval(days=F.lit(1))
    return v.se.where(F.col("entity_id").like("%sensor_1%") & F.col("ts").between(day, when_is())).select("event_id", "ts", "entity_id").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


@query("p22_occupancy_projection", f"SELECT ts AS timestamp, probability > 0.5 AS occupied, round(confidence, 6) AS confidence FROM pr WHERE room = 'office' AND ts >= {T} - INTERVAL 72 HOUR AND ts <= {T} ORDER BY ts DESC LIMIT 200")
def _(v):
    some = v.pr.where((F.col("room") == "office") & F.col("ts").between(when_is() - F.make_dt_interval(hours=F.lit(72)), when_is()))
    return some.orderBy(F.desc("ts")).limit(200).select(F.col("ts").alias("timestamp"), (F.col("probability") > 0.5).alias("occupied"), r6("confidence").alias("confidence"))


@query("p23_json_round_trip", "SELECT event_id, CAST(json_extract_string(attributes, '$.k') AS INT) + 1 AS next_k, room FROM se")
def _(v):
    made = v.se.select("event_id", F.to_json(F.struct((F.col("k") + 1).alias("k"), "room")).alias("j"))
    read = made.select("event_id", F.from_json("j", "k int, room string").alias("r"))
    return read.select("event_id", F.col("r.k").alias("next_k"), F.col("r.room").alias("room"))


@query("p24_signatures", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, room, string_agg(room || '-' || sensor_type || '-' || state, '->' ORDER BY ts, event_id) AS signature FROM se WHERE hour(ts) = 7 GROUP BY ALL")
def _(v):
    step = F.struct("ts", "event_id", F.concat_ws("-", "room", "sensor_type", "state").alias("s"))
    grouped = v.se.where(F.hour("ts") == 7).groupBy(F.to_date("ts").cast("string").alias("day"), "room").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return grouped.select("day", "room", enrich.signature(F.transform("steps", lambda x: x["s"])).alias("signature"))


@query("p25_state_transition", "SELECT event_id, lag(state) OVER (PARTITION BY entity_id ORDER BY ts, event_id) || '_to_' || state AS transition FROM se")
def _(v):
    return temporal.lagged(v.se, ["entity_id"], "state", [1]).select("event_id", F.concat("state_lag_1", F.lit("_to_"), "state").alias("transition"))


@query("p26_truth_label", "SELECT event_id, CASE WHEN sensor_type = 'presence' THEN state = 'on' END AS label FROM se WHERE room <> 'bathroom'")
def _(v):
    return occupancy.truth_labels(v.se.where("room <> 'bathroom'"), None).select("event_id", "label")


@query("p27_prior_prediction", "SELECT event_id, round(least(0.8, [0.1,0.05,0.05,0.05,0.05,0.1,0.3,0.5,0.6,0.4,0.2,0.2,0.4,0.3,0.2,0.2,0.2,0.3,0.4,0.6,0.7,0.6,0.5,0.3][1 + (hour(ts) + horizon_minutes // 60) % 24] * CASE WHEN room = 'bathroom' THEN 0.5 ELSE 1 END), 6) AS probability FROM pr")
def _(v):
    return v.pr.select("event_id", r6(enrich.prior_prediction("ts", "horizon_minutes")).alias("probability"))


@query("p28_fallback_chain", """, asked AS (SELECT DISTINCT entity_id FROM se), a AS (SELECT entity_id, avg(numeric_value)/200 AS probability FROM se WHERE state = 'reading' AND k < 10 GROUP BY 1), b AS (SELECT entity_id, avg(k)/100 AS probability FROM se WHERE state = 'on' AND k > 40 GROUP BY 1)
SELECT asked.entity_id, round(coalesce(a.probability, b.probability, 0.5), 6) AS probability, CASE WHEN a.probability IS NOT NULL THEN 0.2 WHEN b.probability IS NOT NULL THEN 0.7 ELSE 1.0 END::DOUBLE AS uncertainty, a.probability IS NULL AS fallback_used FROM asked LEFT JOIN a USING (entity_id) LEFT JOIN b USING (entity_id)""")
def _(v):
    make = lambda df, p, u: df.groupBy("entity_id").agg(p.alias("probability")).select("entity_id", "probability", F.lit(u).alias("uncertainty"), F.lit(1 - u).alias("confidence"))
    a = make(v.se.where("state = 'reading' AND k < 10"), F.avg("numeric_value") / 200, 0.2)
    b = make(v.se.where("state = 'on' AND k > 40"), F.avg("k") / 100, 0.7)
    return enrich.with_fallback(v.se.select("entity_id").distinct(), a, b, ["entity_id"]).select("entity_id", r6("probability").alias("probability"), "uncertainty", "fallback_used")


@query("p29_lookback", "SELECT event_id, CASE WHEN horizon_minutes <= 30 THEN 60 WHEN horizon_minutes <= 120 THEN 180 ELSE 360 END AS lookback_minutes, CASE WHEN horizon_minutes <= 30 THEN 'fast_adaptive' WHEN horizon_minutes <= 120 THEN 'balanced' ELSE 'stable_pattern' END AS model_family FROM pr")
def _(v):
    return v.pr.select("event_id", *[c.alias(n) for n, c in enrich.lookback_of().items()])


@query("p30_defaults_by_hour", "SELECT event_id, CAST(CASE WHEN hour(ts) BETWEEN 6 AND 9 THEN 180 WHEN hour(ts) BETWEEN 21 AND 23 THEN 300 ELSE 120 END AS DOUBLE) AS duration_s, CAST(CASE WHEN hour(ts) BETWEEN 6 AND 9 THEN 0.4 WHEN hour(ts) BETWEEN 21 AND 23 THEN 0.3 WHEN hour(ts) BETWEEN 12 AND 14 THEN 0.2 ELSE 0.1 END AS DOUBLE) AS prior FROM se")
def _(v):
    return v.se.select("event_id", enrich.typical_duration(F.hour("ts")).alias("duration_s"), enrich.hourly_prior(F.hour("ts")).alias("prior"))


@query("p31_entry_confidence", "SELECT event_id, round(least(0.95, CASE WHEN hour(ts) BETWEEN 6 AND 9 OR hour(ts) BETWEEN 21 AND 23 THEN 0.8 WHEN hour(ts) BETWEEN 12 AND 14 THEN 0.6 ELSE 0.5 END + CASE WHEN k > 5 THEN 0.1 ELSE 0 END), 6)::DOUBLE AS confidence FROM se")
def _(v):
    return v.se.select("event_id", r6(enrich.entry_confidence(F.hour("ts"), F.col("k"))).alias("confidence"))


@query("p32_batch_requests", "SELECT r.room, h.h AS horizon_minutes, count(p.event_id) AS n FROM (SELECT DISTINCT room FROM se) r CROSS JOIN (SELECT unnest([15, 30, 60, 120, 180]) AS h) h LEFT JOIN pr p ON p.room = r.room AND p.horizon_minutes = h.h GROUP BY ALL")
def _(v):
    asked = v.se.select("room").distinct().select("room", F.explode(F.array(*map(F.lit, (15, 30, 60, 120, 180)))).alias("horizon_minutes"))
    return asked.join(v.pr.groupBy("room", "horizon_minutes").agg(F.count("*").alias("n")).hint("merge"), ["room", "horizon_minutes"], "left").select("room", "horizon_minutes", F.coalesce("n", F.lit(0)).alias("n"))


@query("p33_horizon_score", "SELECT event_id, round(greatest(0.1, least(0.9, CASE WHEN horizon_minutes <= 30 THEN 0.5 + 0.1*probability*10 WHEN horizon_minutes > 60 THEN 0.5 + 0.2*confidence ELSE 0.5 END)), 6)::DOUBLE AS score FROM pr")
def _(v):
    family = F.when(F.col("horizon_minutes") <= 30, "fast_adaptive").when(F.col("horizon_minutes") > 60, "stable_pattern").otherwise("balanced")
    return v.pr.select("event_id", r6(enrich.horizon_score(family, F.col("probability") * 10, F.col("confidence"))).alias("score"))


@query("p34_evolution_strategy", """, s AS (SELECT room, avg(accuracy_score) AS m, stddev_pop(accuracy_score) AS d, avg(prediction_time_ms) AS t FROM res GROUP BY room, CAST(ts AS DATE))
SELECT room, CASE WHEN m < 0.6 THEN 'change_algorithm' WHEN m < 0.75 AND d < 0.05 THEN 'feature_engineering' WHEN t > 100 THEN 'prune_ensemble' WHEN d > 0.1 THEN 'hyperparameter_tuning' WHEN m > 0.75 THEN 'expand_ensemble' ELSE 'hyperparameter_tuning' END AS strategy, count(*) AS n FROM s GROUP BY ALL""")
def _(v):
    s = v.res.groupBy("room", F.to_date("ts").cast("string").alias("day")).agg(F.avg("accuracy_score").alias("mean_accuracy"), F.stddev_pop("accuracy_score").alias("std_accuracy"), F.avg("prediction_time_ms").alias("mean_response_ms"))
    return s.groupBy("room", enrich.evolution_strategy().alias("strategy")).agg(F.count("*").alias("n"))


@query("p35_complexity_penalty", "SELECT event_id, CAST(CASE k % 3 WHEN 1 THEN CASE WHEN k*30 < 500 THEN 0.1 WHEN k*30 < 2000 THEN 0.05 ELSE 0 END WHEN 2 THEN CASE WHEN k*30 < 500 THEN 0.2 WHEN k*30 < 2000 THEN 0.15 ELSE 0.05 END ELSE 0 END AS DOUBLE) AS penalty FROM se")
def _(v):
    level = F.when(F.col("k") % 3 == 1, "medium").when(F.col("k") % 3 == 2, "high").otherwise("low")
    return v.se.select("event_id", enrich.complexity_penalty(F.col("k") * 30, level).alias("penalty"))
