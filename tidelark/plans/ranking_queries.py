"""L: sorts, limits, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelark.functions import enrich
from tidelark.operators import ranking, series
from tidelark.plans.base import AS_OF, query, r6, when_is

T = f"TIMESTAMP '{AS_OF}'"


@query("l01_latest_per_room", "SELECT room, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(state, (ts, event_id)) AS state, max(ts) AS ts FROM se GROUP BY room")
def _(v):
    return ranking.latest(v.se.select("room", "event_id", "state", "ts"), ["room"])


@query("l02_latest_prediction", "SELECT room, horizon_minutes, arg_max(event_id, (ts, event_id)) AS event_id, round(arg_max(probability, (ts, event_id)), 6) AS probability FROM pr GROUP BY ALL")
def _(v):
    return ranking.latest(v.pr, ["room", "horizon_minutes"]).select("room", "horizon_minutes", "event_id", r6("probability").alias("probability"))


@query("l03_last_n", "SELECT entity_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) AS rn FROM se) q WHERE rn <= 100")
def _(v):
    return series.last_rows(v.se, ["entity_id"], ["ts", "event_id"], 100).select("entity_id", "event_id")


IMP = ", im AS (SELECT sensor_type || '-' || (k % 10) AS feature, avg(numeric_value)/100 AS importance FROM se WHERE numeric_value IS NOT NULL GROUP BY 1)"


def importances(v):
    return v.se.where("numeric_value is not null").groupBy(F.concat_ws("-", "sensor_type", (F.col("k") % 10).cast("string")).alias("feature")).agg((F.avg("numeric_value") / 100).alias("importance"))


@query("l04_prune_least", IMP + ", n AS (SELECT *, row_number() OVER (ORDER BY importance, feature) AS rn, count(*) OVER () AS c FROM im) SELECT feature, round(importance, 6) AS importance, c > 25 AND rn <= floor(c*0.2) AS pruned FROM n")
def _(v):
    return ranking.prune_least(importances(v)).withColumn("importance", r6("importance"))


@query("l04_top_features", IMP + "SELECT feature, round(importance, 6) AS importance FROM im ORDER BY im.importance DESC, feature LIMIT 5")
def _(v):
    return importances(v).orderBy(F.desc("importance"), "feature").limit(5).withColumn("importance", r6("importance"))


@query("l05_select_features", IMP + ", r AS (SELECT feature, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM im WHERE feature LIKE 'door%') SELECT im.feature, CAST(r.rank AS INT) AS rank FROM im LEFT JOIN r USING (feature) ORDER BY r.rank NULLS LAST, feature LIMIT 15")
def _(v):
    from pyspark.sql import Window as W

    i = importances(v)
    ranks = i.where("feature like 'door%'").withColumn("kind", F.lit(1)).select("feature", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("importance"), "feature")).alias("rank"))
    return ranking.select_features(i.select("feature"), ranks, 15)


CAND = ", cd AS (SELECT room, model_name AS model_type, avg(probability) AS perf, 1 + avg(horizon_minutes)/60 AS cost, 1.0 + count(*) % 5 AS complexity FROM pr GROUP BY ALL), sc AS (SELECT *, 0.6*perf + 0.2/cost + 0.2/complexity AS score FROM cd)"


@query("l06_best_candidate", CAND + "SELECT room, arg_max(model_type, (score, model_type)) AS model_type, round(max(score), 6) AS score FROM sc GROUP BY room")
def _(v):
    c = v.pr.groupBy("room", F.col("model_name").alias("model_type")).agg(F.avg("probability").alias("perf"), (1 + F.avg("horizon_minutes") / 60).alias("cost"), (1.0 + F.count("*") % 5).alias("complexity"))
    return ranking.best_candidates(c, ["room"]).select("room", "model_type", r6("score").alias("score"))


@query("l07_best_model", ", r AS (SELECT *, row_number() OVER (PARTITION BY room, model_name ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY room, model_name) AS c FROM pr), g AS (SELECT room, model_name, avg(probability) - CASE model_name WHEN 'm0' THEN 0 WHEN 'm1' THEN CASE WHEN any_value(c) < 500 THEN 0.1 WHEN any_value(c) < 2000 THEN 0.05 ELSE 0 END ELSE CASE WHEN any_value(c) < 500 THEN 0.2 WHEN any_value(c) < 2000 THEN 0.15 ELSE 0.05 END END AS score FROM r WHERE rn <= 10 GROUP BY room, model_name) SELECT room, arg_max(model_name, (score, model_name)) AS model_name, round(max(score), 6)::DOUBLE AS score FROM g GROUP BY room")
def _(v):
    n = v.pr.groupBy("room", "model_name").agg(F.count("*").alias("samples"))
    m = series.last_rows(v.pr, ["room", "model_name"], ["ts", "event_id"], 10).groupBy("room", "model_name").agg(F.avg("probability").alias("mean")).join(n, ["room", "model_name"])
    level = F.when(F.col("model_name") == "m0", "low").when(F.col("model_name") == "m1", "medium").otherwise("high")
    s = m.withColumn("score", F.col("mean") - enrich.complexity_penalty(F.col("samples"), level))
    return s.groupBy("room").agg(F.max_by("model_name", F.struct("score", "model_name")).alias("model_name"), r6(F.max("score")).alias("score"))


@query("l08_useful_horizons", ", a AS (SELECT room, horizon_minutes, avg(probability) AS acc FROM pr GROUP BY ALL), u AS (SELECT room, horizon_minutes, acc*CASE horizon_minutes WHEN 15 THEN 1.5 WHEN 120 THEN 1.5 WHEN 30 THEN 1.2 ELSE 1.0 END AS utility FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY utility DESC, horizon_minutes) AS rank FROM u) SELECT room, horizon_minutes, round(utility, 6) AS utility, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3")
def _(v):
    a = v.pr.groupBy("room", "horizon_minutes").agg(F.avg("probability").alias("accuracy"))
    return ranking.useful_horizons(a, ["room"]).select("room", "horizon_minutes", r6("utility").alias("utility"), "rank")


REG = ", rg AS (SELECT c_mktsegment AS room, 't' || (c_nationkey % 3) AS model_type, c_custkey AS version, c_custkey % 4 <> 0 AS is_active FROM customer)"


def registry(v):
    return v.table("customer").select(F.col("c_mktsegment").alias("room"), F.concat(F.lit("t"), (F.col("c_nationkey") % 3).cast("string")).alias("model_type"), F.col("c_custkey").alias("version"), (F.col("c_custkey") % 4 != 0).alias("is_active"))


@query("l09_registry_versions", REG + ", m AS (SELECT room, max(version) AS mv FROM rg WHERE is_active GROUP BY room) SELECT room, model_type, version, row_number() OVER (PARTITION BY room, model_type ORDER BY version DESC) > 5 AS expired, is_active AND version = mv AS is_latest FROM rg JOIN m USING (room)")
def _(v):
    return ranking.registry_versions(registry(v)).select("room", "model_type", "version", "expired", "is_latest")


@query("l10_model_listing", REG + "SELECT model_type, version FROM rg WHERE room = 'BUILDING' ORDER BY version DESC")
def _(v):
    return registry(v).where("room = 'BUILDING'").select("model_type", "version").orderBy(F.desc("version"))


@query("l11_newest_first", f"SELECT event_id, ts, room FROM se WHERE ts <= {T} ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(v):
    return v.se.where(F.col("ts") <= when_is()).select("event_id", "ts", "room").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


@query("l12_union_all", "SELECT event_id, room, 'event' AS kind FROM se WHERE k < 50 UNION ALL SELECT event_id, room, 'prediction' FROM pr")
def _(v):
    return v.se.where("k < 50").select("event_id", "room", F.lit("event").alias("kind")).unionByName(v.pr.select("event_id", "room", F.lit("prediction").alias("kind")))


@query("l13_set_difference", "SELECT entity_id FROM se WHERE k >= 50 EXCEPT SELECT entity_id FROM se WHERE k < 3")
def _(v):
    return v.se.where("k >= 50").select("entity_id").subtract(v.se.where("k < 3").select("entity_id"))


@query("l14_distinct", "SELECT DISTINCT room, sensor_type FROM se")
def _(v):
    return v.se.select("room", "sensor_type").distinct()


@query("l15_best_configuration", ", r AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY ts DESC, event_id DESC) AS rn FROM pr), b AS (SELECT room, arg_max(event_id, (probability, event_id)) AS best_id, max(probability) AS best FROM pr GROUP BY room) SELECT b.room, best_id, round(best, 6) AS best, round(CASE WHEN count(*) < 10 THEN 0.1 ELSE stddev_pop(probability) END, 6) AS noise FROM b JOIN r ON r.room = b.room AND rn <= 10 GROUP BY ALL")
def _(v):
    best = v.pr.groupBy("room").agg(F.max_by("event_id", F.struct("probability", "event_id")).alias("best_id"), r6(F.max("probability")).alias("best"))
    noise = series.last_rows(v.pr, ["room"], ["ts", "event_id"], 10).groupBy("room").agg(r6(F.when(F.count("*") < 10, 0.1).otherwise(F.stddev_pop("probability"))).alias("noise"))
    return best.join(noise, "room")


