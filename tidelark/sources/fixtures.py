"""Views that give the generic ``events`` table the shape of sensor events, occupancy and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOMS = ("livingroom", "kitchen", "bedroom", "office", "bathroom")


def _pick(number, values):
    out = F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(number == i, v).otherwise(out)
    return out


def sensor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(spark.read.parquet(f"{sf_dir}/events.parquet"))


def shaped(e: DataFrame) -> DataFrame:
    """The generic events, batch or stream, as sensor events."""
    u = F.col("user_id")
    kind = F.col("event_type")
    return e.select(
        "event_id",
        "ts",
        F.concat(F.lit("sensor_"), u.cast("string")).alias("entity_id"),
        _pick(u % 5, ROOMS).alias("room"),
        _pick(u % 3, ("presence", "entrance", "door")).alias("sensor_type"),
        _pick(u % 3, ("full", "subzone", "unknown")).alias("zone_type"),
        F.concat(F.lit("zone_"), (u % 15).cast("string")).alias("zone"),
        F.when(u % 7 == 0, "p1").when(u % 7 == 1, "p2").alias("person"),
        F.when(kind.isin("view", "click"), "on").when(kind.isin("error", "signup"), "off").otherwise("reading").alias("state"),
        F.when(kind == "purchase", F.col("value")).alias("numeric_value"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.col("props").alias("attributes"),
    )


def room_occupancy(events: DataFrame) -> DataFrame:
    kept = events.where("sensor_type = 'presence' AND state IN ('on', 'off')")
    return kept.select("event_id", "ts", "room", (F.col("state") == "on").alias("occupied"), (0.5 + F.col("k") / 200.0).alias("confidence"), F.col("entity_id").alias("detected_by"))


def predictions(events: DataFrame) -> DataFrame:
    h = F.when(F.col("k") % 4 == 0, 15).when(F.col("k") % 4 == 1, 30).when(F.col("k") % 4 == 2, 60).otherwise(120)
    p = F.col("numeric_value") / (F.col("numeric_value") + 50)
    sure = F.abs(2 * p - 1)
    return events.where("state = 'reading'").select(
        "event_id",
        "ts",
        "room",
        h.alias("horizon_minutes"),
        (F.col("ts") + F.make_dt_interval(mins=h)).alias("predicted_for"),
        p.alias("probability"),
        (1 - sure).alias("uncertainty"),
        sure.alias("confidence"),
        F.concat(F.lit("m"), (F.col("k") % 3).cast("string")).alias("model_name"),
    )


def prediction_results(preds: DataFrame) -> DataFrame:
    return preds.select("event_id", "ts", "room", F.col("probability").alias("accuracy_score"), F.col("horizon_minutes").cast("int").alias("prediction_time_ms"))


#: The same views as common table expressions for the SQL of the queries.
VIEWS = """se AS (SELECT event_id, ts, 'sensor_' || user_id AS entity_id,
 CASE user_id % 5 WHEN 0 THEN 'livingroom' WHEN 1 THEN 'kitchen' WHEN 2 THEN 'bedroom' WHEN 3 THEN 'office' ELSE 'bathroom' END AS room,
 CASE user_id % 3 WHEN 0 THEN 'presence' WHEN 1 THEN 'entrance' ELSE 'door' END AS sensor_type,
 CASE user_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'subzone' ELSE 'unknown' END AS zone_type,
 'zone_' || (user_id % 15) AS zone, CASE user_id % 7 WHEN 0 THEN 'p1' WHEN 1 THEN 'p2' ELSE NULL END AS person,
 CASE WHEN event_type IN ('view','click') THEN 'on' WHEN event_type IN ('error','signup') THEN 'off' ELSE 'reading' END AS state,
 CASE WHEN event_type = 'purchase' THEN value ELSE NULL END AS numeric_value,
 CAST(json_extract_string(props, '$.k') AS INT) AS k, props AS attributes FROM events),
oc AS (SELECT event_id, ts, room, state = 'on' AS occupied, CAST(0.5 + k / 200.0 AS DOUBLE) AS confidence, entity_id AS detected_by
 FROM se WHERE sensor_type = 'presence' AND state IN ('on','off')),
pr AS (SELECT event_id, ts, room, h AS horizon_minutes, ts + h * INTERVAL 1 MINUTE AS predicted_for, p AS probability,
 1 - abs(2*p - 1) AS uncertainty, abs(2*p - 1) AS confidence, 'm' || (k % 3) AS model_name
 FROM (SELECT *, CASE k % 4 WHEN 0 THEN 15 WHEN 1 THEN 30 WHEN 2 THEN 60 ELSE 120 END AS h, numeric_value / (numeric_value + 50) AS p FROM se WHERE state = 'reading') q),
res AS (SELECT event_id, ts, room, probability AS accuracy_score, CAST(horizon_minutes AS INT) AS prediction_time_ms FROM pr)"""
