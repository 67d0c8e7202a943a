"""S: scans, sources and sinks."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidelark.operators import scoring
from tidelark.plans.base import AS_OF, query, r6, when_is
from tidelark.sources import tables

T = f"TIMESTAMP '{AS_OF}'"


@query("s01_range_scan", "SELECT event_id, ts, entity_id, room, state FROM se WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00' AND room IN ('kitchen','office') AND entity_id IN ('sensor_1','sensor_3','sensor_6','sensor_8')")
def _(v):
    return tables.between(v.se, when_is("2024-01-05 00:00:00"), when_is("2024-01-12 00:00:00"), rooms=["kitchen", "office"], entities=["sensor_1", "sensor_3", "sensor_6", "sensor_8"]).select("event_id", "ts", "entity_id", "room", "state").orderBy("ts")


@query("s02_recent_scan", f"SELECT event_id, ts, room, state FROM se WHERE ts BETWEEN {T} - INTERVAL 90 MINUTE AND {T} AND room = 'bedroom'")
def _(v):
    return tables.recent(v.se, when_is(), minutes=90, rooms=["bedroom"]).select("event_id", "ts", "room", "state").orderBy("ts")


@query("s03_room_history", f"SELECT ts, occupied, round(confidence, 6) AS confidence FROM oc WHERE room = 'kitchen' AND ts BETWEEN {T} - INTERVAL 48 HOUR AND {T}")
def _(v):
    return tables.recent(v.oc, when_is(), minutes=48 * 60, rooms=["kitchen"]).select("ts", "occupied", r6("confidence").alias("confidence")).orderBy("ts")


@query("s04_recent_events_desc", f"SELECT ts, entity_id, state, sensor_type FROM se WHERE room = 'office' AND ts BETWEEN {T} - INTERVAL 24 HOUR AND {T} ORDER BY ts DESC")
def _(v):
    return tables.recent(v.se, when_is(), minutes=24 * 60, rooms=["office"]).select("ts", "entity_id", "state", "sensor_type").orderBy(F.desc("ts"))


def versions(df, keys):
    """Each row in two versions, the later one with another state."""
    return df.withColumn("seq", F.lit(1)).unionByName(df.where("event_id % 3 = 0").withColumn("state", F.lit("late")).withColumn("seq", F.lit(2)))


@query("s10_event_upsert", "SELECT ts, entity_id, CASE WHEN event_id % 3 = 0 THEN 'late' ELSE state END AS state FROM se")
def _(v):
    return tables.last_write_wins(versions(v.se.select("event_id", "ts", "entity_id", "state"), None), ["ts", "entity_id"], "seq").select("ts", "entity_id", "state")


@query("s11_prediction_upsert", "SELECT date_trunc('hour', ts) AS hour, room, horizon_minutes, round(arg_max(probability, event_id), 6) AS probability FROM pr GROUP BY ALL")
def _(v):
    hourly = v.pr.withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return tables.last_write_wins(hourly, ["hour", "room", "horizon_minutes"], "event_id").select("hour", "room", "horizon_minutes", r6("probability").alias("probability"))


@query("s12_pattern_upsert", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, room, sensor_type AS pattern_type, coalesce(arg_max_null(numeric_value, event_id), 0) AS significance_score, CAST(1 AS BIGINT) AS frequency FROM se GROUP BY ALL")
def _(v):
    found = v.se.select(F.to_date("ts").cast("string").alias("day"), "room", F.col("sensor_type").alias("pattern_type"), F.col("numeric_value").alias("significance_score"), F.lit(None).cast("long").alias("frequency"), "event_id")
    return tables.last_write_wins(found, ["day", "room", "pattern_type"], "event_id", {"significance_score": 0.0, "frequency": 1}).drop("event_id")


@query("s13_numeric_sink", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date, TRY_CAST(CASE WHEN state = 'reading' THEN CAST(numeric_value AS VARCHAR) ELSE state END AS DOUBLE) AS numeric_value FROM se")
def _(v):
    text = F.when(F.col("state") == "reading", F.col("numeric_value").cast("string")).otherwise(F.col("state"))
    at = tables.folder(v.spark)
    tables.write_events(v.se.select("event_id", "entity_id", "room", "ts", text.try_cast("double").alias("numeric_value")), at)
    return tables.read_events(v.spark, at).select("event_id", F.col("event_date").cast("string").alias("event_date"), "numeric_value")


@query("s14_backfill", "SELECT event_id, se.entity_id, c.c_name AS friendly_name, n.n_name AS area FROM se LEFT JOIN customer c ON c.c_custkey = CAST(substr(se.entity_id, 8) AS BIGINT) LEFT JOIN nation n ON n.n_nationkey = se.k WHERE ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts < TIMESTAMP '2024-01-15 00:00:00'")
def _(v):
    meta = v.table("customer").select(F.concat(F.lit("sensor_"), F.col("c_custkey").cast("string")).alias("entity_id"), F.col("c_name").alias("friendly_name"))
    area = v.table("nation").select(F.col("n_nationkey").alias("attributes_id"), F.col("n_name").alias("area"))
    states = v.se.select("event_id", "ts", "entity_id", F.col("k").alias("attributes_id"))
    return tables.backfill(states, meta, area, when_is("2024-01-08 00:00:00"), when_is("2024-01-15 00:00:00")).select("event_id", "entity_id", "friendly_name", "area")


@query("s15_chunked_backfill", "SELECT CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS BIGINT) AS chunk, count(*) AS n, count(DISTINCT entity_id) AS entities, count(*) AS imported FROM se GROUP BY 1")
def _(v):
    """A run that stops after two chunks, one that resumes it and one that finds nothing to do; then the table is read."""
    at, finished = tables.folder(v.spark), tables.folder(v.spark)
    first, last = v.se.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        return v.spark.createDataFrame([], "chunk long, n long, entities long, imported long")
    for at_most in (2, None, None):
        tables.import_chunks(v.se, at, finished, first, last + timedelta(microseconds=1), at_most=at_most)
    rows = v.spark.read.parquet(at).groupBy("chunk").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("entities"))
    log = v.spark.read.parquet(finished).select("chunk", F.col("n").alias("imported"))
    number = F.floor(F.date_diff("chunk", F.lit("2024-01-01").cast("date")) / 7).alias("chunk")
    return rows.join(log.hint("merge"), "chunk").select(number, "n", "entities", "imported")


@query("s18_latest_cache", f"SELECT room, arg_max(entity_id, event_id) AS entity_id, max(ts) + INTERVAL 1800 SECOND AS expires_at FROM se WHERE ts <= {T} GROUP BY room HAVING max(ts) + INTERVAL 1800 SECOND > {T}")
def _(v):
    cache = tables.cache_rows(v.se.where(F.col("ts") <= when_is()).select("room", "entity_id", "ts", "event_id"), ["room"], "room_state")
    return tables.fresh(cache, when_is()).select("room", "entity_id", "expires_at")


@query("s20_counter", f"SELECT entity_id AS name, CAST(sum(k) AS BIGINT) AS value FROM se WHERE ts <= {T} GROUP BY 1 HAVING max(ts) > {T} - INTERVAL 24 HOUR")
def _(v):
    seen = v.se.where(F.col("ts") <= when_is()).withColumnRenamed("entity_id", "name")
    return tables.counter(seen, "name", F.col("k"), when_is()).select("name", "value")


KEYS = "SELECT DISTINCT room || ':' || entity_id || ':' || state AS key FROM se"


def _keys(v):
    return v.se.select(F.concat_ws(":", "room", "entity_id", "state").alias("key")).distinct()


@query("s21_invalidate", f", k AS ({KEYS}) SELECT key FROM k WHERE key NOT LIKE 'kitchen:%:on'")
def _(v):
    return tables.drop_matching(_keys(v), "kitchen:%:on")


@query("s21_prefix_counts", f", k AS ({KEYS}) SELECT split_part(key, ':', 1) AS prefix, count(*) AS n FROM k GROUP BY 1")
def _(v):
    return tables.prefix_counts(_keys(v))


@query("s22_retention_counts", f"SELECT ts < {T} - INTERVAL 14 DAY AS expired, count(*) AS n FROM se GROUP BY 1")
def _(v):
    return tables.expired_counts(v.se, when_is(), 14)


@query("s22_retained", f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM se WHERE ts >= {T} - INTERVAL 14 DAY GROUP BY 1")
def _(v):
    return tables.retained(v.se, when_is(), 14).groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))


EXPIRE = " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) FILTER (ts < b) AS expired, count(*) FILTER (ts >= b) AS kept, count(DISTINCT CAST(ts AS DATE)) FILTER (ts >= b) AS days FROM {t}, bd" for n, t in (("sensor_events", "se"), ("occupancy", "oc"), ("predictions", "pr")))


@query("s22_expire", f", bd AS (SELECT {T} - INTERVAL 14 DAY AS b) " + EXPIRE)
def _(v):
    """Three tables by date: expired dates are dropped by name, the border one is rewritten; what is left is read again."""
    paths = {}
    for name, rows in (("sensor_events", v.se), ("occupancy", v.oc), ("predictions", v.pr)):
        paths[name] = tables.folder(v.spark)
        tables.write_events(rows, paths[name])
    counts = tables.expire(v.spark, paths, datetime.fromisoformat(AS_OF), 14)
    left = None
    for name, path in paths.items():
        one = v.spark.read.parquet(path).agg(F.count("*").alias("kept"), F.count_distinct("event_date").alias("days")).select(F.lit(name).alias("table"), "kept", "days")
        left = one if left is None else left.unionByName(one)
    return counts.drop("kept").join(left, "table")


@query("s23_prediction_entities", "SELECT event_id, 'sensor.occupancy_' || room || '_' || horizon_minutes || 'min' AS entity_id, round(probability, 3) AS state, round(confidence, 3) AS confidence, model_name FROM pr")
def _(v):
    return tables.prediction_entities(v.pr).select("event_id", "entity_id", "state", F.col("attributes.confidence").alias("confidence"), F.col("attributes.model_name").alias("model_name"))


@query("s24_live_entities", f"SELECT entity_id, max(ts) AS last FROM se WHERE ts <= {T} GROUP BY 1 HAVING max(ts) >= {T} - INTERVAL 24 HOUR")
def _(v):
    return tables.live_entities(v.se.where(F.col("ts") <= when_is()), when_is())


@query("s25_helper_entities", f"""
, n AS (SELECT room, count(*) FILTER (ts > {T} - INTERVAL 1 HOUR) AS h1, count(*) FILTER (ts > {T} - INTERVAL 2 HOUR) AS h2, count(*) AS d7
 FROM se WHERE ts > {T} - INTERVAL 7 DAY AND ts <= {T} GROUP BY room)
SELECT 'sensor.' || room || '_activity_level' AS entity_id, CASE WHEN h1 >= 2*d7/168.0 THEN 'very_high' WHEN h1 >= 1.5*d7/168.0 THEN 'high' WHEN h1 >= 0.5*d7/168.0 THEN 'normal' WHEN h1 > 0 THEN 'low' ELSE 'none' END AS state FROM n
UNION ALL SELECT 'binary_sensor.' || room || '_anomaly', CASE WHEN h2 = 0 OR d7 = 0 THEN 'none' WHEN h2 > 3*d7/7.0 THEN 'high_activity' WHEN h2 < 0.3*d7/7.0 AND d7/7.0 > 1 THEN 'low_activity' ELSE 'none' END FROM n""")
def _(v):
    level, odd = scoring.activity_level(v.se, when_is()), scoring.activity_anomaly(v.se, when_is())
    return level.select(F.concat(F.lit("sensor."), "room", F.lit("_activity_level")).alias("entity_id"), F.col("level").alias("state")).unionByName(odd.select(F.concat(F.lit("binary_sensor."), "room", F.lit("_anomaly")).alias("entity_id"), F.col("anomaly").alias("state")))


