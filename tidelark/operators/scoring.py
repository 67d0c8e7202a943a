"""Ensembles, uncertainty, health, alerts and activity levels.

Ensemble frames are long: one row for each model's probability ``p`` of a
(room, horizon, ts), with the outcome ``y`` where it is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelark.operators.rollups import correlation, within
from tidelark.operators.segments import row_frame
from tidelark.operators.temporal import micros


def model_weights(history: DataFrame, recent: DataFrame | None = None, least_rows: int = 10, floor: float = 0.1) -> DataFrame:
    """room, model_name, weight: mean of 1 - |p - y| (0.5 unless over ``least_rows`` rows), blended 0.7 / 0.3 with a recent metric where there is one, at least ``floor``, summing to 1 by room."""
    score = F.when(F.count("*") > least_rows, F.avg(1 - F.abs(F.col("p") - F.col("y").cast("double")))).otherwise(0.5)
    base = history.where("y is not null").groupBy("room", "model_name").agg(score.alias("_s"))
    if recent is not None:
        base = base.join(recent.select("room", "model_name", F.col("recent").alias("_r")), ["room", "model_name"], "left")
        base = base.withColumn("_s", F.when(F.col("_r").isNotNull(), 0.7 * F.col("_s") + 0.3 * F.col("_r")).otherwise(F.col("_s")))
    w = F.greatest(F.lit(floor), F.col("_s"))
    return base.select("room", "model_name", (w / F.sum(w).over(W.partitionBy("room"))).alias("weight"))


def ensemble(scores: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted probability, uncertainty and agreement of each key's models."""
    joined = scores.join(weights.hint("merge"), ["room", "model_name"])
    n = F.count("*")
    spread = F.max("p") - F.min("p")
    sure = F.sum(F.abs(F.col("p") - 0.5) * F.col("weight")) / n
    return joined.groupBy(*keys).agg(
        (F.sum(F.col("p") * F.col("weight")) / F.sum("weight")).alias("probability"),
        F.least(F.lit(1.0), 0.7 * spread + 0.3 * (1 - sure)).alias("uncertainty"),
        F.when(n < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - 4 * F.var_pop("p"))).alias("agreement"),
        n.alias("models"),
    )


def contributions(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Each model's share of its key's weighted probability."""
    joined = scores.join(weights.hint("merge"), ["room", "model_name"])
    return joined.withColumn("contribution", F.col("p") * F.col("weight"))


def prequential(history: DataFrame, keys: list[str], order: list[str], rows: int = 1000) -> DataFrame:
    """Adds the rolling share of right classes, at 0.5."""
    right = ((F.col("p") > 0.5) == F.col("y")).cast("double")
    return row_frame(history, keys, order, rows - 1, 0, {"rolling_accuracy": F.avg(right)})


def health(latest: DataFrame) -> DataFrame:
    """Adds health and status to rows of accuracy, fp_rate, fn_rate, confidence, n."""
    bad = lambda c: F.greatest(F.lit(0.0), 1 - F.col(c) / 0.2)
    score = 0.4 * F.least(F.lit(1.0), F.col("accuracy") / 0.9) + 0.2 * bad("fp_rate") + 0.2 * bad("fn_rate") + 0.2 * F.col("confidence")
    out = latest.withColumn("health", score * F.least(F.lit(1.0), F.col("n") / 100))
    h = F.col("health")
    return out.withColumn("status", F.when(h >= 0.8, "excellent").when(h >= 0.6, "good").when(h >= 0.4, "fair").otherwise("poor"))


def _raised(df: DataFrame, rules: dict[str, Column], keys: list[str], name: str) -> DataFrame:
    return df.select(*keys, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))).alias(name))


def adaptation_triggers(latest: DataFrame, keys: list[str]) -> DataFrame:
    c = F.col
    rules = {"low_accuracy": (c("accuracy") < 0.7) & (c("n") >= 50), "concept_drift": c("drift"), "high_false_positives": c("fp_rate") > 0.3, "low_confidence": (c("confidence") < 0.5) & (c("n") >= 20), "relevance_degradation": c("degraded")}
    return _raised(latest, rules, keys, "trigger")


def threshold_alerts(metrics: DataFrame, keys: list[str]) -> DataFrame:
    c = F.col
    return _raised(metrics, {"low_prediction_accuracy": c("accuracy") < 0.7, "high_error_rate": c("error_rate") > 0.05, "high_response_time": c("response_ms") > 500}, keys, "alert")


def horizon_recommendations(horizons: DataFrame, keys: list[str]) -> DataFrame:
    return _raised(horizons, {"improve_accuracy": F.col("mean") < 0.6, "declining": F.col("trend") < -0.1}, keys, "recommendation")


def occupancy_trend(preds: DataFrame, as_of: Column, least_rows: int = 10) -> DataFrame:
    """Direction, strength and chance of change by room, from the correlation of time and probability over a day."""
    c = correlation(within(preds, as_of, 1), ["room"], micros("ts") / 3.6e9, F.col("probability"))
    r, few = F.col("r"), F.col("n") < least_rows
    return c.select(
        "room",
        F.when(few, "stable").when(r > 0.3, "increasing").when(r < -0.3, "decreasing").otherwise("stable").alias("trend"),
        F.when(few, 0.0).when(F.abs(r) > 0.3, F.abs(r)).otherwise(1 - F.abs(r)).alias("strength"),
        F.when(few, 0.5).otherwise(F.least(F.lit(0.9), 0.5 + 0.5 * F.abs(r))).alias("change_probability"),
    )


def _recent_counts(events: DataFrame, as_of: Column, hours: float) -> DataFrame:
    since = as_of - F.make_dt_interval(secs=F.lit(hours * 3600.0))
    return within(events, as_of, 7).groupBy("room").agg(F.count(F.when(F.col("ts") > since, 1)).alias("c"), F.count("*").alias("week"))


def activity_anomaly(events: DataFrame, as_of: Column) -> DataFrame:
    """Events of the last two hours against the daily mean of a week."""
    x = _recent_counts(events, as_of, 2).withColumn("a", F.col("week") / 7)
    c, a = F.col("c"), F.col("a")
    none = (c == 0) | (F.col("week") == 0)
    kind = F.when(none, "none").when(c > 3 * a, "high_activity").when((c < 0.3 * a) & (a > 1), "low_activity").otherwise("none")
    score = F.when(none, 0.0).when(c > 3 * a, F.least(F.lit(1.0), c / (3 * a))).when((c < 0.3 * a) & (a > 1), 1 - c / (0.3 * a)).otherwise(0.0)
    sure = F.when(none, 0.0).when(kind == "high_activity", 0.8).when(kind == "low_activity", 0.7).otherwise(0.6)
    return x.select("room", kind.alias("anomaly"), score.alias("score"), sure.alias("confidence"))


def activity_level(events: DataFrame, as_of: Column) -> DataFrame:
    """Events of the last hour against the hourly mean of a week."""
    x = _recent_counts(events, as_of, 1).withColumn("a", F.col("week") / 168)
    c, a = F.col("c"), F.col("a")
    level = F.when(c >= 2 * a, "very_high").when(c >= 1.5 * a, "high").when(c >= 0.5 * a, "normal").when(c > 0, "low").otherwise("none")
    score = F.when(c >= 2 * a, F.least(F.lit(1.0), c / (2 * a))).when(c >= 1.5 * a, c / (1.5 * a)).when(c >= 0.5 * a, 0.5).when(c > 0, c / (0.5 * a)).otherwise(0.0)
    return x.select("room", level.alias("level"), score.alias("score"), F.when(a > 0, c / a).otherwise(1.0).alias("ratio"))


def served(asked: DataFrame, cache: DataFrame, computed: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """The cached probability where it is fresh, else the computed one, and which it was."""
    fresh = cache.where(F.col("expires_at") > as_of).select(*keys, F.col("probability").alias("_c"))
    return asked.join(fresh, keys, "left").join(computed.select(*keys, F.col("probability").alias("_p")), keys, "left").select(*asked.columns, F.coalesce("_c", "_p").alias("probability"), F.col("_c").isNotNull().alias("from_cache"))


def active_alerts(log: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    """Unresolved alerts by id (their newest row says so), and where to send those of the last minutes."""
    newest = log.groupBy("alert_id").agg(F.max_by(F.struct("status", "kind", "ts"), F.struct("ts", "event_id")).alias("r")).select("alert_id", "r.*")
    fresh = F.col("ts") > as_of - F.make_dt_interval(mins=F.lit(minutes))
    route = F.when(F.col("kind") == "drift", "retrain").when(F.col("kind") == "accuracy", "optimize").otherwise("notify")
    return newest.where("status <> 'resolved'").withColumn("route", F.when(fresh, route))


def room_status(latest: DataFrame, activity: DataFrame, accuracy: DataFrame, patterns: DataFrame) -> DataFrame:
    out = latest.select("room", (F.col("probability") > 0.5).alias("occupied"), "probability")
    return out.join(activity, "room", "left").join(accuracy, "room", "left").join(patterns, "room", "left")
