"""Occupied periods, stays and what is learned from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelark.functions import enrich
from tidelark.operators.segments import SECOND
from tidelark.operators.temporal import interval_join, micros, periods


def presence_periods(events: DataFrame, least_min: float = 0.1) -> DataFrame:
    """Periods by room: a presence sensor's ``on`` opens, its ``off`` closes."""
    some = events.where("sensor_type = 'presence'")
    found = periods(some, F.col("state") == "on", F.col("state") == "off", keys=["room"], least_min=least_min)
    return found.withColumn("confidence", F.lit(0.9)).withColumn("method", F.lit("presence_sensor"))


def bathroom_periods(events: DataFrame, least_min: float = 0.5) -> DataFrame:
    """Periods by room: an entrance sensor's ``on`` opens, a door's ``off`` closes."""
    enter = (F.col("sensor_type") == "entrance") & (F.col("state") == "on")
    leave = (F.col("sensor_type") == "door") & (F.col("state") == "off")
    found = periods(events, enter, leave, keys=["room"], least_min=least_min)
    return found.withColumn("confidence", F.lit(0.8)).withColumn("method", F.lit("entrance_and_door"))


def stay_means(stays: DataFrame, by: str) -> DataFrame:
    """Mean stay in seconds and its count, by hour, weekday or context of the end."""
    end = F.col("end_ts")
    key = {"hour": F.hour(end), "weekday": F.weekday(end), "context": context_of(F.hour(end))}[by]
    return stays.groupBy(key.alias(by)).agg((F.avg("duration_min") * 60).alias("mean_s"), F.count("*").alias("n"))


def context_of(hour: Column) -> Column:
    return F.when(hour.between(6, 9), "morning").when(hour.between(21, 23), "evening").otherwise("other")


def predicted_durations(asked: DataFrame, stays: DataFrame, ts: str = "ts", least: int = 3) -> DataFrame:
    """Adds duration_s: the hour's mean of more than ``least`` stays, else the context's, else the default."""
    hour = F.hour(ts)
    by_hour = stay_means(stays, "hour").select(F.col("hour").alias("_h"), F.when(F.col("n") > least, F.col("mean_s")).alias("_by_hour"))
    by_context = stay_means(stays, "context").select(F.col("context").alias("_c"), F.when(F.col("n") > least, F.col("mean_s")).alias("_by_context"))
    joined = asked.withColumn("_h", hour).withColumn("_c", context_of(hour)).join(F.broadcast(by_hour), "_h", "left").join(F.broadcast(by_context), "_c", "left")  # 24 and 3 rows
    return joined.select(*asked.columns, F.coalesce("_by_hour", "_by_context", enrich.typical_duration(hour)).alias("duration_s"))


def truth_labels(events: DataFrame, machine: DataFrame | None) -> DataFrame:
    """Adds label: a presence sensor's state, a bathroom door's result of the state machine, else null."""
    presence = F.when(F.col("sensor_type") == "presence", F.col("state") == "on")
    if machine is None:
        return events.withColumn("label", presence)
    found = machine.select("event_id", F.col("occupied").alias("_m"))
    door = F.when((F.col("sensor_type") == "door") & F.col("room").contains("bathroom"), F.col("_m"))
    return events.join(found.hint("merge"), "event_id", "left").withColumn("label", F.coalesce(presence, door)).drop("_m")


def bathroom_forecast(now: DataFrame, *, occupied="occupied", elapsed="elapsed_s", typical="typical_s", idle="idle_s", samples="samples", target_hour="target_hour") -> DataFrame:
    """Adds probability and confidence of occupancy at the target, from the current state."""
    e, d = F.col(elapsed), F.col(typical)
    stays = F.when(e >= d, F.greatest(F.lit(0.1), 1 - (e - d) / d)).otherwise(1 - 0.3 * e / d)
    n, h = F.coalesce(F.col(samples), F.lit(0)), F.col(target_hour)
    prior = F.when(n > 0, F.least(F.lit(0.3), n / 100)).otherwise(enrich.hourly_prior(h))
    free = F.least(F.lit(0.8), prior * F.when(F.col(idle) > 3600, 1.2).otherwise(1.0))
    return now.withColumn("probability", F.when(F.col(occupied), F.least(F.lit(0.95), stays)).otherwise(free)).withColumn("confidence", F.when(F.col(occupied), 0.8).otherwise(0.6))


def hybrid(rule_p: Column, ml_p: Column, rule_confidence: Column, ml_uncertainty: Column) -> dict[str, Column]:
    u = F.greatest(1 - rule_confidence, ml_uncertainty)
    return {"probability": 0.7 * rule_p + 0.3 * ml_p, "uncertainty": u, "confidence": 1 - u}


def with_outcome(preds: DataFrame, occupancy: DataFrame, tolerance_s: float = 300) -> DataFrame:
    """Adds actual_outcome and prediction_error: the occupancy nearest to predicted_for (then the earlier one, then the least event_id) within the tolerance.

    The nearest one is the last one up to that time or the first one from it on.  Both are found by one pass over a
    room's rows in order, so no pairs are made, however many observations are near.  Rows are dealt to time buckets,
    observations to each bucket that they can reach.  A row carries an observation (``occupied`` is a boolean) as one
    number, four times its time plus what was seen.  All rows of a task are sorted once: of observations at one time only
    that of the least event_id counts, so the last one and the next one are read off the same order.  They are dealt to
    all the session's shuffle partitions, as a few tasks of merged ones would sort more the more rows there are.
    """
    reach = int(tolerance_s * SECOND)
    place = lambda t: F.floor(t / F.lit(max(4 * reach, SECOND)))
    seen = occupancy.where("ts is not null and room is not null").select("room", micros("ts").alias("_t"), F.col("event_id").alias("_id"), (4 * micros("ts") + F.coalesce(F.col("occupied").cast("int"), F.lit(2))).alias("_seen"))
    asked = preds.withColumns({"_t": micros("predicted_for"), "_id": F.lit(None).cast(seen.schema["_id"].dataType), "_seen": F.lit(None).cast("long"), "_side": F.lit(1), "_in": place(micros("predicted_for"))})
    blank = [F.lit(None).cast(preds.schema[c].dataType).alias(c) for c in preds.columns if c != "room"]
    dealt = seen.select("*", *blank, F.lit(0).alias("_side"), F.explode(F.sequence(place(F.col("_t") - reach), place(F.col("_t") + reach))).alias("_in"))
    w = W.partitionBy("_in", "room").orderBy("_t", "_side", "_id")
    parts = int(preds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = asked.unionByName(dealt).repartition(parts, "_in", "room").withColumn("_seen", F.when(F.coalesce(F.lag("_t").over(w) < F.col("_t"), F.lit(True)), F.col("_seen")))
    following = F.expr("lead(_seen) ignore nulls over (partition by _in, room order by _t, _side, _id)")
    rows = first.select("*", F.last("_seen", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("_to"), following.alias("_from")).where("_side = 1")
    away = lambda c: F.abs(F.shiftright(c, 2) - F.col("_t"))
    found = F.least(*[F.when(away(c) <= reach, F.struct(away(c).alias("away"), F.col(c).alias("seen"))) for c in ("_to", "_from")])
    was = found["seen"].bitwiseAND(F.lit(3))
    return rows.select(*preds.columns, F.when(was < 2, was == 1).alias("actual_outcome")).withColumn("prediction_error", F.abs(F.col("probability") - F.col("actual_outcome").cast("double")))


def accuracy_near(preds: DataFrame, occupancy: DataFrame, tolerance_s: float) -> DataFrame:
    """Every pair of a prediction and an occupancy row of its room within the tolerance of predicted_for."""
    seen = occupancy.select("room", F.col("ts").alias("observed_at"), "occupied")
    return interval_join(preds, seen, ["room"], "predicted_for", "observed_at", -tolerance_s, tolerance_s)


def horizon_labels(events: DataFrame, occupancy: DataFrame, horizons: list[int]) -> DataFrame:
    """For each event and horizon, the room's last known occupancy at ts + horizon; null past the data's end."""
    from tidelark.operators.temporal import latest_before

    end = occupancy.agg(F.max("ts")).first()[0]
    at = events.select("event_id", "room", F.col("ts").alias("at"), F.explode(F.array(*map(F.lit, horizons))).alias("horizon_minutes"))
    at = at.withColumn("ts", F.col("at") + F.make_dt_interval(mins=F.col("horizon_minutes")))
    out = latest_before(at, occupancy, "room", "occupied", out="label")
    return out.select("event_id", "horizon_minutes", F.when(F.col("ts") <= F.lit(end), F.col("label")).alias("label"))
