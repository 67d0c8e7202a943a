"""E: scoring, evaluation and learning."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidelark.operators import learning, occupancy, ranking, rollups, scoring, series
from tidelark.plans.aggregate_queries import CONFUSION, EV, rounded
from tidelark.plans.base import AS_OF, query, r6, when_is
from tidelark.sources import tables
from tidelark.streaming import runner

T = f"TIMESTAMP '{AS_OF}'"
#: Three models' probabilities for every occupancy row.
SC = ", sc AS (SELECT room, 'm' || m AS model_name, event_id, ts, least(1, greatest(0, confidence - 0.2*m + CASE WHEN occupied THEN 0.1 ELSE 0 END)) AS p, occupied AS y FROM oc, (SELECT unnest([0, 1, 2]) AS m) q)"
WT = SC + ", b AS (SELECT room, model_name, CASE WHEN count(*) > 10 THEN avg(1 - abs(p - CAST(y AS INT))) ELSE 0.5 END AS s FROM sc GROUP BY ALL), w AS (SELECT room, model_name, greatest(0.1, s)/sum(greatest(0.1, s)) OVER (PARTITION BY room) AS weight FROM b)"


def scores(v):
    m = F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("m")
    p = F.col("confidence") - 0.2 * F.col("m") + F.when(F.col("occupied"), 0.1).otherwise(0.0)
    return v.oc.select("room", "event_id", "ts", "confidence", "occupied", m).select("room", F.concat(F.lit("m"), F.col("m").cast("string")).alias("model_name"), "event_id", "ts", F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)).alias("p"), F.col("occupied").alias("y"))


@query("e01_model_weights", WT + "SELECT room, model_name, round(weight, 6) AS weight FROM w")
def _(v):
    return rounded(scoring.model_weights(scores(v)), "weight")


@query("e02_ensemble_probability", WT + "SELECT sc.room, event_id, round(sum(p*weight)/sum(weight), 6) AS probability FROM sc JOIN w USING (room, model_name) GROUP BY ALL")
def _(v):
    return rounded(scoring.ensemble(scores(v), scoring.model_weights(scores(v)), ["room", "event_id"]).select("room", "event_id", "probability"), "probability")


@query("e03_uncertainty", WT + "SELECT event_id, round(least(1, 0.7*(max(p) - min(p)) + 0.3*(1 - sum(abs(p - 0.5)*weight)/count(*))), 6)::DOUBLE AS uncertainty FROM sc JOIN w USING (room, model_name) GROUP BY 1")
def _(v):
    return rounded(scoring.ensemble(scores(v), scoring.model_weights(scores(v)), ["event_id"]).select("event_id", "uncertainty"), "uncertainty")


@query("e04_agreement", SC + "SELECT event_id, round(greatest(0, 1 - 4*var_pop(p)), 6)::DOUBLE AS agreement FROM sc GROUP BY 1")
def _(v):
    return rounded(scoring.ensemble(scores(v), scoring.model_weights(scores(v)), ["event_id"]).select("event_id", "agreement"), "agreement")


@query("e05_contributions", WT + "SELECT event_id, model_name, round(p*weight, 6) AS contribution FROM sc JOIN w USING (room, model_name)")
def _(v):
    return rounded(scoring.contributions(scores(v), scoring.model_weights(scores(v))).select("event_id", "model_name", "contribution"), "contribution")


@query("e06_prequential", SC + "SELECT event_id, model_name, round(avg(CAST((p > 0.5) = y AS INT)) OVER (PARTITION BY model_name ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW), 6) AS rolling_accuracy FROM sc")
def _(v):
    return rounded(scoring.prequential(scores(v), ["model_name"], ["ts", "event_id"]).select("event_id", "model_name", "rolling_accuracy"), "rolling_accuracy")


@query("e07_hybrid", "SELECT event_id, round(0.7*probability + 0.3*confidence, 6) AS probability, round(greatest(1 - confidence, uncertainty), 6) AS uncertainty FROM pr")
def _(v):
    h = occupancy.hybrid(F.col("probability"), F.col("confidence"), F.col("confidence"), F.col("uncertainty"))
    return v.pr.select("event_id", *[r6(h[n]).alias(n) for n in ("probability", "uncertainty")])


@query("e08_bathroom_forecast", """, n AS (SELECT event_id, confidence > 0.5 AS occ, k*6.0 AS e, CASE WHEN hour(ts) BETWEEN 6 AND 9 THEN 180.0 WHEN hour(ts) BETWEEN 21 AND 23 THEN 300.0 ELSE 120.0 END AS d, k*80.0 AS idle, k % 40 AS s, (hour(ts) + 1) % 24 AS h FROM pr JOIN (SELECT event_id, k, numeric_value FROM se) q USING (event_id))
SELECT event_id, round(CASE WHEN occ THEN least(0.95, CASE WHEN e >= d THEN greatest(0.1, 1 - (e - d)/d) ELSE 1 - 0.3*e/d END) ELSE least(0.8, CASE WHEN s > 0 THEN least(0.3, s/100) WHEN h BETWEEN 6 AND 9 THEN 0.4 WHEN h BETWEEN 21 AND 23 THEN 0.3 WHEN h BETWEEN 12 AND 14 THEN 0.2 ELSE 0.1 END*CASE WHEN idle > 3600 THEN 1.2 ELSE 1 END) END, 5)::DOUBLE AS probability FROM n""")
def _(v):
    from tidelark.functions import enrich

    k = v.se.select("event_id", "k")
    now = v.pr.join(k, "event_id").select("event_id", (F.col("confidence") > 0.5).alias("occupied"), (F.col("k") * 6.0).alias("elapsed_s"), enrich.typical_duration(F.hour("ts")).alias("typical_s"), (F.col("k") * 80.0).alias("idle_s"), (F.col("k") % 40).alias("samples"), ((F.hour("ts") + 1) % 24).alias("target_hour"))
    return occupancy.bathroom_forecast(now).select("event_id", F.round("probability", 5).alias("probability"))


METRICS = EV + f", mt AS (SELECT room, {CONFUSION}, avg(confidence) AS confidence FROM ev WHERE y IS NOT NULL GROUP BY room)"


def metrics(v):
    return rollups.confusion(occupancy.with_outcome(v.pr, v.oc), ["room"], confidence=F.avg("confidence"))


@query("e09_health", METRICS + ", h AS (SELECT room, (0.4*least(1, accuracy/0.9) + 0.2*greatest(0, 1 - fp_rate/0.2) + 0.2*greatest(0, 1 - fn_rate/0.2) + 0.2*confidence)*least(1, n/100) AS health FROM mt) SELECT room, round(health, 4) AS health, CASE WHEN health >= 0.8 THEN 'excellent' WHEN health >= 0.6 THEN 'good' WHEN health >= 0.4 THEN 'fair' ELSE 'poor' END AS status FROM h")
def _(v):
    return scoring.health(metrics(v)).select("room", F.round("health", 4).alias("health"), "status")


@query("e10_adaptation_triggers", METRICS + ", t AS (SELECT room, unnest(list_filter([CASE WHEN accuracy < 0.7 AND n >= 50 THEN 'low_accuracy' END, CASE WHEN n % 2 = 0 THEN 'concept_drift' END, CASE WHEN fp_rate > 0.3 THEN 'high_false_positives' END, CASE WHEN confidence < 0.5 AND n >= 20 THEN 'low_confidence' END, CASE WHEN n % 3 = 0 THEN 'relevance_degradation' END], lambda x: x IS NOT NULL)) AS trigger FROM mt) SELECT * FROM t")
def _(v):
    m = metrics(v).withColumn("drift", F.col("n") % 2 == 0).withColumn("degraded", F.col("n") % 3 == 0)
    return scoring.adaptation_triggers(m, ["room"])


@query("e11_threshold_alerts", ", m AS (SELECT room, avg(accuracy_score) AS a, avg(CAST(accuracy_score < 0.2 AS INT)) AS e, max(prediction_time_ms)*5.0 AS t FROM res GROUP BY room) SELECT room, 'low_prediction_accuracy' AS alert FROM m WHERE a < 0.7 UNION ALL SELECT room, 'high_error_rate' FROM m WHERE e > 0.05 UNION ALL SELECT room, 'high_response_time' FROM m WHERE t > 500")
def _(v):
    m = v.res.groupBy("room").agg(F.avg("accuracy_score").alias("accuracy"), F.avg((F.col("accuracy_score") < 0.2).cast("double")).alias("error_rate"), (F.max("prediction_time_ms") * 5.0).alias("response_ms"))
    return scoring.threshold_alerts(m, ["room"])


@query("e12_occupancy_trend", f", c AS (SELECT room, coalesce(CASE WHEN var_pop(epoch_us(ts)/3.6e9) > 0 AND var_pop(probability) > 0 THEN corr(epoch_us(ts)/3.6e9, probability) END, 0) AS r, count(*) AS n FROM pr WHERE ts > {T} - INTERVAL 1 DAY AND ts <= {T} GROUP BY room) SELECT room, CASE WHEN n < 10 THEN 'stable' WHEN r > 0.3 THEN 'increasing' WHEN r < -0.3 THEN 'decreasing' ELSE 'stable' END AS trend, round(CASE WHEN n < 10 THEN 0 WHEN abs(r) > 0.3 THEN abs(r) ELSE 1 - abs(r) END, 4)::DOUBLE AS strength, round(CASE WHEN n < 10 THEN 0.5 ELSE least(0.9, 0.5 + 0.5*abs(r)) END, 4)::DOUBLE AS change_probability FROM c")
def _(v):
    return scoring.occupancy_trend(v.pr, when_is()).withColumns({n: F.round(n, 4) for n in ("strength", "change_probability")})


WEEK = f", n AS (SELECT room, count(*) FILTER (ts > {T} - INTERVAL 1 HOUR) AS h1, count(*) FILTER (ts > {T} - INTERVAL 2 HOUR) AS h2, count(*) AS w FROM se WHERE ts > {T} - INTERVAL 7 DAY AND ts <= {T} GROUP BY room)"


@query("e13_activity_anomaly", WEEK + "SELECT room, CASE WHEN h2 = 0 THEN 'none' WHEN h2 > 3*w/7 THEN 'high_activity' WHEN h2 < 0.3*w/7 AND w/7 > 1 THEN 'low_activity' ELSE 'none' END AS anomaly, round(CASE WHEN h2 = 0 THEN 0 WHEN h2 > 3*w/7 THEN least(1, h2/(3*w/7)) WHEN h2 < 0.3*w/7 AND w/7 > 1 THEN 1 - h2/(0.3*w/7) ELSE 0 END, 6)::DOUBLE AS score FROM n")
def _(v):
    return rounded(scoring.activity_anomaly(v.se, when_is()).select("room", "anomaly", "score"), "score")


@query("e14_activity_level", WEEK + "SELECT room, CASE WHEN h1 >= 2*w/168 THEN 'very_high' WHEN h1 >= 1.5*w/168 THEN 'high' WHEN h1 >= 0.5*w/168 THEN 'normal' WHEN h1 > 0 THEN 'low' ELSE 'none' END AS level, round(CASE WHEN w > 0 THEN h1/(w/168) ELSE 1 END, 6)::DOUBLE AS ratio FROM n")
def _(v):
    return rounded(scoring.activity_level(v.se, when_is()).select("room", "level", "ratio"), "ratio")


@query("e15_horizon_recommendations", ", r AS (SELECT horizon_minutes, probability AS x, row_number() OVER (PARTITION BY horizon_minutes ORDER BY ts DESC, event_id DESC) AS rn FROM pr), g AS (SELECT horizon_minutes, avg(x) AS mean, avg(x) FILTER (rn <= 10) - avg(x) FILTER (rn BETWEEN 11 AND 20) AS trend FROM r WHERE rn <= 100 GROUP BY 1) SELECT horizon_minutes, 'improve_accuracy' AS recommendation FROM g WHERE mean < 0.6 UNION ALL SELECT horizon_minutes, 'declining' FROM g WHERE trend < -0.1")
def _(v):
    key, order = ["horizon_minutes"], ["ts", "event_id"]
    h = rollups.recent_summary(v.pr, key, order, "probability").select("horizon_minutes", "mean").join(series.trend(v.pr, key, order, "probability"), key)
    return scoring.horizon_recommendations(h, key)


@query("e16_classifier_scores")
def _(v):
    train, test = learning.split_by_time(learning.labelled(v.se, v.oc, [15]))
    return learning.score(learning.fit_ensemble(train), test).select("event_id", "model_name", "p")


@query("e17_horizon_labels", ", a AS (SELECT event_id, room, h.h AS horizon_minutes, ts + h.h*INTERVAL 1 MINUTE AS at FROM se, (SELECT unnest([15, 120]) AS h) h), x AS (SELECT max(ts) AS e FROM oc) SELECT a.event_id, a.horizon_minutes, CASE WHEN a.at <= x.e THEN o.occupied END AS label FROM a ASOF LEFT JOIN oc o ON o.room = a.room AND a.at >= o.ts CROSS JOIN x")
def _(v):
    return occupancy.horizon_labels(v.se, v.oc, [15, 120])


@query("e17_horizon_accuracy")
def _(v):
    rows = learning.labelled(v.se, v.oc, [15, 120])
    out = None
    for h in (15, 120):
        train, test = learning.split_by_time(rows.where(F.col("horizon_minutes") == h))
        got = learning.accuracy(learning.score(learning.fit_ensemble(train), test), ["horizon_minutes", "model_name"])
        out = got if out is None else out.unionByName(got)
    return out


@query("e18_needs_retraining", f"SELECT room, count(*) AS n, round(avg(accuracy_score) FILTER (ts > {T} - INTERVAL 1 DAY), 6) AS accuracy FROM res WHERE ts > {T} - INTERVAL 7 DAY AND ts <= {T} GROUP BY room HAVING count(*) > 5 AND avg(accuracy_score) FILTER (ts > {T} - INTERVAL 1 DAY) < 0.6")
def _(v):
    return rounded(learning.needs_retraining(v.res, when_is(), more_than=5), "accuracy")


@query("e18_refit", f", q AS (SELECT room FROM res WHERE ts > {T} - INTERVAL 7 DAY AND ts <= {T} GROUP BY room HAVING count(*) > 5 AND avg(accuracy_score) FILTER (ts > {T} - INTERVAL 1 DAY) < 0.6), x AS (SELECT max(ts) AS e FROM oc), l AS (SELECT s.room, o.occupied FROM se s ASOF JOIN oc o ON o.room = s.room AND s.ts + INTERVAL 15 MINUTE >= o.ts CROSS JOIN x WHERE s.ts + INTERVAL 15 MINUTE <= x.e AND s.ts > {T} - INTERVAL 7 DAY AND s.ts <= {T}) SELECT room || '_tree_v1' AS model_id, count(*)::DOUBLE AS n_rows, true AS is_active, true AS loads FROM l WHERE room IN (SELECT room FROM q) GROUP BY room")
def _(v):
    now, folder = dt.datetime.fromisoformat(AS_OF), runner.folder(v.spark)
    empty = v.spark.createDataFrame([], "model_id string, room string, model_type string, version long, parent string, metrics double, created_at timestamp_ntz")
    rows = learning.labelled(v.se, v.oc, [15])
    kept = learning.refit(rows, v.res, empty, now, folder, "tree", more_than=5)
    one = kept.where("is_active").select("room").first()
    loads = one is not None and not learning.score({"tree": learning.load_active(kept, folder, one.room, "tree")}, rows).isEmpty()
    return kept.select("model_id", F.col("metrics").alias("n_rows"), "is_active", F.lit(loads).alias("loads"))


@query("e19_search")
def _(v):
    return learning.search(learning.labelled(v.se, v.oc, [15]), {"tree": [{"maxDepth": 2}, {"maxDepth": 4}], "logistic": [{"regParam": 0.1}]}).select("model_type", "params", "perf")


REG = """, g AS (SELECT room, model_name AS model_type, round(avg(probability), 6) AS metrics, max(ts) AS created_at, min(ts) AS train_start, max(ts) AS train_end FROM pr GROUP BY ALL), o AS (SELECT room || '_' || model_type || '_v1' AS model_id, CAST(1 AS BIGINT) AS version, CAST(NULL AS VARCHAR) AS parent, metrics, train_start, train_end, room, model_type FROM g WHERE model_type <> 'm0'),
 a AS (SELECT model_id, version, parent, metrics, train_start, train_end, false AS is_active, room, model_type FROM o UNION ALL SELECT room || '_' || model_type || '_v' || CASE WHEN model_type <> 'm0' THEN 2 ELSE 1 END, CASE WHEN model_type <> 'm0' THEN 2 ELSE 1 END, CASE WHEN model_type <> 'm0' THEN room || '_' || model_type || '_v1' END, metrics, train_start, train_end, true, room, model_type FROM g)"""


def registry(v):
    """Two rounds of entries: all models but m0 a day earlier, then all."""
    g = v.pr.groupBy("room", F.col("model_name").alias("model_type")).agg(r6(F.avg("probability")).alias("metrics"), F.max("ts").alias("created_at"), F.min("ts").alias("train_start"), F.max("ts").alias("train_end"))
    empty = g.where("false").select(F.lit("").alias("model_id"), "room", "model_type", F.lit(0).cast("long").alias("version"), F.lit(None).cast("string").alias("parent"), "metrics", "created_at")
    first = learning.register(empty, g.where("model_type <> 'm0'").withColumn("created_at", F.col("created_at") - F.make_dt_interval(days=F.lit(1))))
    return learning.register(first, g)


@query("e20_registry", REG + "SELECT model_id, version, parent, metrics, train_start, train_end, is_active FROM a")
def _(v):
    return registry(v).select("model_id", "version", "parent", "metrics", "train_start", "train_end", "is_active")


@query("e20_newest_versions", REG + "SELECT model_id, version, is_active FROM a QUALIFY row_number() OVER (PARTITION BY room, model_type ORDER BY version DESC) <= 1")
def _(v):
    return learning.newest_versions(registry(v), 1).select("model_id", "version", "is_active")


@query("e21_serving", f", c AS (SELECT room, arg_max(probability, (ts, event_id)) AS p, max(ts) + INTERVAL 120 SECOND AS x FROM pr WHERE ts <= {T} AND room <> 'kitchen' GROUP BY room), d AS (SELECT room, avg(probability) AS p FROM pr GROUP BY room) SELECT d.room, round(CASE WHEN c.x > {T} THEN c.p ELSE d.p END, 6) AS probability, coalesce(c.x > {T}, false) AS from_cache FROM d LEFT JOIN c USING (room)")
def _(v):
    cache = tables.cache_rows(v.pr.where((F.col("ts") <= when_is()) & (F.col("room") != "kitchen")), ["room"], "predictions")
    computed = v.pr.groupBy("room").agg(F.avg("probability").alias("probability"))
    return rounded(scoring.served(computed.select("room"), cache, computed, ["room"], when_is()), "probability")


@query("e23_active_alerts", f", l AS (SELECT k AS alert_id, CASE WHEN event_id % 5 = 0 THEN 'resolved' ELSE 'open' END AS status, CASE k % 3 WHEN 0 THEN 'drift' WHEN 1 THEN 'accuracy' ELSE 'other' END AS kind, ts, event_id FROM se WHERE ts <= {T}), n AS (SELECT alert_id, arg_max(status, (ts, event_id)) AS status, arg_max(kind, (ts, event_id)) AS kind, max(ts) AS ts FROM l GROUP BY 1) SELECT alert_id, kind, CASE WHEN ts > {T} - INTERVAL 120 MINUTE THEN CASE kind WHEN 'drift' THEN 'retrain' WHEN 'accuracy' THEN 'optimize' ELSE 'notify' END END AS route FROM n WHERE status <> 'resolved'")
def _(v):
    kind = F.when(F.col("k") % 3 == 0, "drift").when(F.col("k") % 3 == 1, "accuracy").otherwise("other")
    log = v.se.where(F.col("ts") <= when_is()).select(F.col("k").alias("alert_id"), F.when(F.col("event_id") % 5 == 0, "resolved").otherwise("open").alias("status"), kind.alias("kind"), "ts", "event_id")
    return scoring.active_alerts(log, when_is(), 120).select("alert_id", "kind", "route")


@query("e24_room_status", ", l AS (SELECT room, arg_max(probability, (ts, event_id)) AS p FROM pr GROUP BY room), a AS (SELECT room, max(ts) AS last_activity FROM se WHERE state = 'on' GROUP BY room), m AS (SELECT room, avg(probability) AS acc FROM pr GROUP BY room), s AS (SELECT room, count(DISTINCT sensor_type || state) AS patterns FROM se GROUP BY room) SELECT l.room, p > 0.5 AS occupied, round(p, 6) AS probability, last_activity, round(acc, 6) AS accuracy, patterns FROM l LEFT JOIN a USING (room) LEFT JOIN m USING (room) LEFT JOIN s USING (room)")
def _(v):
    last = v.se.where("state = 'on'").groupBy("room").agg(F.max("ts").alias("last_activity"))
    acc = v.pr.groupBy("room").agg(r6(F.avg("probability")).alias("accuracy"))
    kinds = v.se.groupBy("room").agg(F.count_distinct(F.concat("sensor_type", "state")).alias("patterns"))
    return rounded(scoring.room_status(ranking.latest(v.pr, ["room"]), last, acc, kinds), "probability")


