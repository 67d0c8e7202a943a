"""J: joins, most of them on time ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelark.operators import movement, occupancy, temporal
from tidelark.plans.base import AS_OF, query, r6, when_is

T = f"TIMESTAMP '{AS_OF}'"


@query("j01_daily_accuracy", "SELECT CAST(CAST(p.predicted_for AS DATE) AS VARCHAR) AS day, p.room, count(*) AS n, round(avg(abs(p.probability - CAST(o.occupied AS INT))), 6) AS mae FROM pr p JOIN oc o ON o.room = p.room AND o.ts BETWEEN p.predicted_for - INTERVAL 5 MINUTE AND p.predicted_for + INTERVAL 5 MINUTE GROUP BY ALL")
def _(v):
    pairs = occupancy.accuracy_near(v.pr, v.oc, 300)
    return pairs.groupBy(F.to_date("predicted_for").cast("string").alias("day"), "room").agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("probability") - F.col("occupied").cast("int")))).alias("mae"))


@query("j02_model_accuracy", f"SELECT p.model_name, p.horizon_minutes, count(*) AS n, round(avg(abs(p.probability - CAST(o.occupied AS INT))), 6) AS mae FROM pr p JOIN oc o ON o.room = p.room AND o.ts BETWEEN p.predicted_for - INTERVAL 2 MINUTE AND p.predicted_for + INTERVAL 2 MINUTE WHERE p.room = 'kitchen' AND p.ts >= {T} - INTERVAL 20 DAY AND p.ts <= {T} GROUP BY ALL")
def _(v):
    mine = v.pr.where((F.col("room") == "kitchen") & F.col("ts").between(when_is() - F.make_dt_interval(days=F.lit(20)), when_is()))
    return occupancy.accuracy_near(mine, v.oc, 120).groupBy("model_name", "horizon_minutes").agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("probability") - F.col("occupied").cast("int")))).alias("mae"))


@query("j03_rapid_movement", "SELECT a.event_id, b.event_id AS to_id, a.room AS from_room, b.room AS to_room, round((epoch_us(b.ts) - epoch_us(a.ts))/1e6, 6) AS dt_s, 'rapid_movement_anomaly' AS anomaly_type FROM se a JOIN se b ON b.ts > a.ts AND b.ts < a.ts + INTERVAL 60 SECOND AND a.room <> b.room WHERE a.sensor_type = 'presence' AND a.state = 'on' AND b.sensor_type = 'presence' AND b.state = 'on'")
def _(v):
    return movement.rapid_movements(v.se, within_s=60).select("event_id", "to_id", "from_room", "to_room", r6("dt_s").alias("dt_s"), "anomaly_type")


NEAR = "FROM se a JOIN se b ON b.ts BETWEEN a.ts - INTERVAL {n} SECOND AND a.ts + INTERVAL {n} SECOND"


@query("j04_concurrent_count", f"SELECT a.event_id, count(*) FILTER (b.entity_id <> a.entity_id) AS concurrent {NEAR.format(n=5)} GROUP BY 1")
def _(v):
    return movement.concurrent_counts(v.se).select("event_id", "concurrent")


@query("j05_concurrent_entities", f"SELECT a.event_id, string_agg(DISTINCT b.entity_id, ',' ORDER BY b.entity_id) FILTER (b.entity_id <> a.entity_id) AS entities {NEAR.format(n=5)} GROUP BY 1 HAVING count(*) FILTER (b.entity_id <> a.entity_id) > 0")
def _(v):
    return movement.concurrent_entities(v.se).where(F.size("concurrent_entities") > 0).select("event_id", F.array_join("concurrent_entities", ",").alias("entities"))


@query("j06_room_state", f"SELECT a.event_id, coalesce(string_agg(DISTINCT b.zone, ',' ORDER BY b.zone) FILTER (b.zone_type = 'subzone' AND b.state = 'on'), '') AS subzones, coalesce(string_agg(DISTINCT b.zone, ',' ORDER BY b.zone) FILTER (b.zone_type = 'full' AND b.state = 'on'), '') AS full_zones {NEAR.format(n=30)} AND a.room = b.room GROUP BY 1")
def _(v):
    return movement.room_state(v.se).select("event_id", F.array_join("active_subzones", ",").alias("subzones"), F.array_join("active_full_zones", ",").alias("full_zones"))


@query("j07_latest_reading", "SELECT p.event_id, q.numeric_value AS latest FROM pr p ASOF LEFT JOIN (SELECT room, ts, numeric_value FROM se WHERE numeric_value IS NOT NULL AND sensor_type = 'entrance') q ON p.room = q.room AND p.ts >= q.ts")
def _(v):
    return temporal.latest_before(v.pr.select("event_id", "room", "ts"), v.se.where("sensor_type = 'entrance'"), "room", "numeric_value").select("event_id", "latest")


@query("j08_metadata_joins", "SELECT s.event_id, c.c_name, n.n_name FROM se s LEFT JOIN customer c ON c.c_custkey = CAST(substr(s.entity_id, 8) AS BIGINT) LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey")
def _(v):
    c = v.table("customer").select(F.concat(F.lit("sensor_"), F.col("c_custkey").cast("string")).alias("entity_id"), "c_name", "c_nationkey")
    n = v.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return v.se.select("event_id", "entity_id").join(c, "entity_id", "left").join(n, "c_nationkey", "left").select("event_id", "c_name", "n_name")


MOVES = ", mv AS (SELECT event_id, ts, room, lag(ts) OVER (ORDER BY ts, event_id) AS prev_ts, lag(room) OVER (ORDER BY ts, event_id) AS prev_room FROM se)"


@query("j09_door_opened", MOVES + ", d AS (SELECT room, ts FROM se WHERE sensor_type = 'door') SELECT event_id, room FROM mv WHERE room <> prev_room AND epoch_us(ts) - epoch_us(prev_ts) <= 600000000 AND EXISTS (SELECT 1 FROM d WHERE d.room = mv.room AND d.ts > mv.prev_ts AND d.ts <= mv.ts)")
def _(v):
    moves = temporal.neighbour(v.se.select("event_id", "ts", "room"), ["ts", "room"]).where("room <> prev_room")
    moves = moves.where(temporal.seconds_between("ts", "prev_ts") <= 600)
    doors = v.se.where("sensor_type = 'door'")
    return movement.door_between(moves, doors, "prev_ts", "ts", "room", 600).select("event_id", "room")


@query("j10_general_presence", "SELECT event_id, room FROM se a WHERE state = 'on' AND zone_type = 'full' AND NOT EXISTS (SELECT 1 FROM se b WHERE b.room = a.room AND b.state = 'on' AND b.zone_type = 'subzone' AND b.ts BETWEEN a.ts - INTERVAL 30 SECOND AND a.ts + INTERVAL 30 SECOND)")
def _(v):
    return movement.general_presence(v.se.select("event_id", "ts", "room", "state", "zone_type")).select("event_id", "room")


@query("j11_actual_outcome", """, m AS (SELECT p.event_id, p.probability, arg_min(o.occupied, (abs(epoch_us(o.ts) - epoch_us(p.predicted_for)), epoch_us(o.ts), o.event_id)) AS actual_outcome FROM pr p JOIN oc o ON o.room = p.room AND o.ts BETWEEN p.predicted_for - INTERVAL 5 MINUTE AND p.predicted_for + INTERVAL 5 MINUTE GROUP BY 1, 2)
SELECT p.event_id, m.actual_outcome, round(abs(p.probability - CAST(m.actual_outcome AS INT)), 6) AS prediction_error FROM pr p LEFT JOIN m USING (event_id)""")
def _(v):
    return occupancy.with_outcome(v.pr, v.oc).select("event_id", "actual_outcome", r6("prediction_error").alias("prediction_error"))


@query("j12_room_seconds", MOVES + "SELECT event_id, CAST(CASE WHEN least(room, prev_room) = 'bedroom' AND greatest(room, prev_room) = 'kitchen' THEN 4 WHEN least(room, prev_room) = 'bedroom' AND greatest(room, prev_room) = 'office' THEN 3 WHEN least(room, prev_room) = 'kitchen' AND greatest(room, prev_room) = 'office' THEN 3 ELSE 2 END AS DOUBLE) AS least_s FROM mv WHERE prev_room IS NOT NULL")
def _(v):
    moves = temporal.neighbour(v.se.select("event_id", "ts", "room"), ["room"]).where("prev_room is not null")
    return moves.select("event_id", movement.least_seconds("room", "prev_room", movement.ROOM_SECONDS, 2.0).alias("least_s"))


ZONES = [("zone_1", "zone_4", 60.0), ("zone_4", "zone_7", 30.0), ("zone_7", "zone_10", 20.0)]


@query("j13_zone_seconds", ", mv AS (SELECT event_id, zone, lag(zone) OVER (ORDER BY ts, event_id) AS pz FROM se) SELECT event_id, CAST(CASE WHEN least(zone, pz) = 'zone_1' AND greatest(zone, pz) = 'zone_4' THEN 60 WHEN least(zone, pz) = 'zone_4' AND greatest(zone, pz) = 'zone_7' THEN 30 WHEN least(zone, pz) = 'zone_10' AND greatest(zone, pz) = 'zone_7' THEN 20 END AS DOUBLE) AS least_s FROM mv")
def _(v):
    moves = temporal.neighbour(v.se.select("event_id", "ts", "zone"), ["zone"])
    return moves.select("event_id", movement.least_seconds("zone", "prev_zone", ZONES, None).alias("least_s"))
