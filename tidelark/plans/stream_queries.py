"""T and the streaming S and J rows: each runs its stream over all files that are there and returns what it wrote."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidelark.operators import patterns, rollups, temporal
from tidelark.plans import fold_sql
from tidelark.plans.base import AS_OF, query, r6
from tidelark.sources import fixtures, tables
from tidelark.streaming import operators as so
from tidelark.streaming import runner

NTZ = "timestamp_ntz"


def stream(v, delay="10 minutes"):
    return runner.event_stream(v.spark, v.sf_dir, delay)


def plain(df, *times):
    return df.withColumns({t: F.col(t).cast(NTZ) for t in times})


def raw(v, *brought):
    """Events as JSON messages; one in ten cut short and one in ten without its id. They can bring the time they ``arrived``."""
    said = ["event_id", F.col("ts").cast("string").alias("ts"), "entity_id", "state", "room", "sensor_type", "attributes"]
    k, t = F.col("event_id") % 10, F.col("t")
    e = stream(v).select("event_id", F.col("ts").alias("arrived"), F.to_json(F.struct(*said)).alias("t"))
    return e.select(*brought, F.when(k == 0, F.substring(t, 1, 20)).when(k == 1, F.regexp_replace(t, '"event_id":[0-9]+,', "")).otherwise(t).alias("value"))


@query("s05_event_messages", "SELECT event_id, ts, entity_id, state FROM se WHERE event_id % 10 > 1")
def _(v):
    return plain(runner.drain(so.good(so.parsed(raw(v), so.EVENT)).select("event_id", "ts", "entity_id", "state")), "ts")


@query("s06_prediction_messages", "SELECT event_id, room, horizon_minutes, round(probability, 6) AS probability FROM pr")
def _(v):
    p = fixtures.predictions(stream(v)).select("event_id", F.col("ts").cast("string").alias("ts"), "room", "horizon_minutes", "probability", "model_name")
    got = so.good(so.parsed(p.select(F.to_json(F.struct(*p.columns)).alias("value")), so.PREDICTION))
    return runner.drain(got.select("event_id", "room", "horizon_minutes", r6("probability").alias("probability")))


@query("s07_anomaly_messages", "SELECT event_id, room, k/100.0::DOUBLE AS anomaly_score FROM se WHERE k > 90")
def _(v):
    a = stream(v).where("k > 90").select("event_id", F.col("ts").cast("string").alias("ts"), "room", F.lit("spike").alias("anomaly_type"), (F.col("k") / 100.0).alias("anomaly_score"))
    return runner.drain(so.good(so.parsed(a.select(F.to_json(F.struct(*a.columns)).alias("value")), so.ANOMALY)).select("event_id", "room", "anomaly_score"))


@query("s08_dead_letters", "SELECT CASE event_id % 10 WHEN 0 THEN 'malformed' ELSE 'missing event_id' END AS reason, count(*) AS n FROM se WHERE event_id % 10 < 2 GROUP BY 1")
def _(v):
    return runner.drain(so.dead_letters(so.parsed(raw(v), so.EVENT))).groupBy("reason").agg(F.count("*").alias("n"))


@query("s08_last_errors", ", d AS (SELECT ts AS arrived, CASE event_id % 10 WHEN 0 THEN 'malformed' ELSE 'missing event_id' END AS reason, row_number() OVER (ORDER BY ts, event_id) AS failed FROM se WHERE event_id % 10 < 2) SELECT arrived, reason, failed FROM d ORDER BY failed DESC LIMIT 100")
def _(v):
    letters = runner.drain(so.dead_letters(so.parsed(raw(v, "arrived"), so.EVENT)))
    return plain(so.last_errors(letters).select("arrived", "reason", F.col("failed").cast("long").alias("failed")), "arrived")


@query("s09_keyed_messages", "SELECT room AS key, event_id, state FROM se")
def _(v):
    sent = runner.drain(so.messages(stream(v).select("event_id", "ts", "room", "state")))
    return sent.select("key", F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), F.get_json_object("value", "$.state").alias("state"))


@query("s16_changed_only", "SELECT event_id, entity_id FROM se")
def _(v):
    both = stream(v, "1 hour").unionByName(stream(v, "1 hour"))
    return runner.drain(so.changed_only(both).select("event_id", "entity_id"))


@query("s17_merged_sources", "SELECT 'push' AS source, room, count(*) AS n FROM se WHERE k % 2 = 0 GROUP BY room UNION ALL SELECT 'poll', room, count(*) FROM se WHERE k % 3 = 0 GROUP BY room")
def _(v):
    both = so.merged_sources(stream(v).where("k % 2 = 0"), stream(v).where("k % 3 = 0"))
    return runner.drain(both.select("source", "room", "event_id")).groupBy("source", "room").agg(F.count("*").alias("n"))


@query("s19_cached_batches", "SELECT room, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) + INTERVAL 300 SECOND AS expires_at FROM se GROUP BY room")
def _(v):
    at = runner.folder(v.spark)
    runner.drain(stream(v).select("room", "event_id", "ts"), each=so.cache_latest(at, ["room"], "features"))
    kept = v.spark.read.schema("room string, event_id long, ts timestamp, expires_at timestamp").parquet(f"{at}/*")
    return plain(tables.last_write_wins(kept, ["room"], "ts").select("room", "event_id", "expires_at"), "expires_at")


@query("t01_watermark", ", w AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM se) SELECT date_trunc('hour', ts) AS start, room, count(*) AS n FROM se, w GROUP BY 1, 2 HAVING date_trunc('hour', max(ts)) + INTERVAL 1 HOUR <= max(w)")
def _(v):
    return plain(runner.drain(so.tumbling(stream(v, "1 hour"), "1 hour")), "start")


@query("t02_tumbling", "SELECT date_trunc('hour', ts) AS start, room, count(*) AS n FROM se GROUP BY ALL")
def _(v):
    return plain(runner.drain(so.tumbling(stream(v), "1 hour"), "complete"), "start")


@query("t03_sliding", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) - o.o*INTERVAL 5 MINUTE AS start, room, count(*) AS n, count(*) FILTER (state = 'on') AS n_on FROM se, (SELECT unnest(range(0, 6)) AS o) o GROUP BY ALL")
def _(v):
    return plain(runner.drain(so.sliding(stream(v)), "complete"), "start")


@query("t04_sessions", ", x AS (SELECT *, lag(ts) OVER (PARTITION BY person ORDER BY ts) AS p FROM se WHERE person IS NOT NULL), y AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) >= 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY person ORDER BY ts) AS s FROM x) SELECT person, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS \"end\", count(*) AS n FROM y GROUP BY person, s")
def _(v):
    return plain(runner.drain(so.sessions(stream(v).where("person is not null")), "complete"), "start", "end")


@query("t05_once_a_minute", "SELECT DISTINCT entity_id, room, state, epoch_us(ts) // 60000000 AS minute FROM se")
def _(v):
    kept = runner.drain(so.once_a_minute(stream(v)).select("entity_id", "room", "state", "cache_key"))
    return kept.select("entity_id", "room", "state", F.element_at(F.split("cache_key", "[|]"), -1).cast("long").alias("minute"))


def timed(v):
    return v.se.withColumn("ts", F.col("ts").cast("timestamp"))


@query("t05_expiring_cache", "SELECT entity_id AS key, count(DISTINCT 1) AS within, count(DISTINCT 1) + 1 AS after FROM se GROUP BY 1")
def _(v):
    """The same events in two triggers: once with entries that outlive the pause between them, once with entries that don't."""
    rows = timed(v).select("entity_id", "event_id")
    kept = {ttl: runner.in_turns([rows, rows], lambda s, t=ttl: so.once_per(s, "entity_id", t), pause_s=2.5).groupBy("key").agg(F.count("*").alias(name)) for ttl, name in ((3_600_000, "within"), (1_000, "after"))}
    return kept[3_600_000].join(kept[1_000].hint("merge"), "key", "full")


@query("t06_micro_batches", ", r AS (SELECT room, event_id, (row_number() OVER (PARTITION BY room ORDER BY event_id) - 1) // 1000 AS b FROM se) SELECT room, CAST(b AS INT) AS batch, count(*) AS n, CASE WHEN count(*) = 1000 THEN 'full' ELSE 'timeout' END AS reason FROM r GROUP BY room, b")
def _(v):
    rows = timed(v)
    return runner.in_turns([rows], so.micro_batches, rows=rows.count()).groupBy("room", "batch", "reason").agg(F.count("*").alias("n"))


@query("t07_last_change_delta", "SELECT event_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY entity_id ORDER BY ts, event_id)))/1e6, 6) AS delta_s FROM se")
def _(v):
    return so.last_change_delta(stream(v)).select("event_id", r6(F.nanvl("delta_s", F.lit(None).cast("double"))).alias("delta_s"))


@query("t08_bathroom_machine", fold_sql.BATHROOM + " SELECT * FROM br")
def _(v):
    said = plain(so.bathroom_machine(stream(v)), "ts")
    return said.withColumns({"confidence": r6("confidence"), "duration_s": F.round(F.nanvl("duration_s", F.lit(None).cast("double")), 3), "door_probability": r6("door_probability")})


ALERTS = fold_sql.ROWS.format(x="k/100.0", where="") + fold_sql.PAGE_HINKLEY + fold_sql.KOLMOGOROV + ", b2 AS (SELECT p.room, p.event_id, p.alarm AS page_hinkley, k.alarm AS ks, nx.sec, row_number() OVER (PARTITION BY p.room ORDER BY p.i) AS i FROM ph p JOIN ks k ON k.room = p.room AND k.i = p.i JOIN nx ON nx.room = p.room AND nx.i = p.i WHERE p.alarm OR k.alarm)" + fold_sql.COOLDOWN.format(rows="b2") + " SELECT b2.room, b2.event_id, page_hinkley, ks FROM cd JOIN b2 ON b2.room = cd.room AND b2.i = cd.i WHERE kept"


@query("t09_drift_alerts", ALERTS)
def _(v):
    return so.drift_alerts(stream(v).select("room", "event_id", "ts", (F.col("k") / 100.0).alias("x")))


@query("t10_hourly_rollup", "SELECT date_trunc('hour', ts) AS hour, room, sensor_type, count(*) AS n, round(avg(numeric_value), 6) AS mean_value FROM se GROUP BY ALL")
def _(v):
    return plain(runner.drain(so.hourly_rollup(stream(v)), "update"), "hour").withColumn("mean_value", r6("mean_value"))


@query("t10_refreshed_rollup", f"SELECT date_trunc('hour', ts) AS hour, room, sensor_type, count(*) AS n, round(avg(numeric_value), 6) AS mean_value FROM se WHERE ts < date_trunc('hour', TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR) GROUP BY ALL")
def _(v):
    """A first rollup, and two refreshes that recompute the day before; nothing later than the lag is in it."""
    at, now = runner.folder(v.spark), datetime.fromisoformat(AS_OF)
    rollups.refresh_rollup(v.se, at, now - timedelta(hours=36), lookback=None)
    for back in (18, 0):
        rollups.refresh_rollup(v.se, at, now - timedelta(hours=back))
    return rollups.rollup_view(v.spark, at).withColumn("mean_value", r6("mean_value"))


@query("t11_fan_out", "SELECT 'store' AS sink, count(*) AS n FROM se UNION ALL SELECT 'topic', count(*) FROM se UNION ALL SELECT 'features', count(*) FROM se")
def _(v):
    at = runner.folder(v.spark)
    runner.drain(stream(v), each=so.fan_out(*[f"{at}/{x}" for x in ("store", "topic", "features")]))
    out = None
    for x in ("store", "topic", "features"):
        row = v.spark.read.parquet(f"{at}/{x}/*").agg(F.count("*").alias("n")).select(F.lit(x).alias("sink"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("t12_occupancy_changes", "SELECT room, ts, occupied FROM oc")
def _(v):
    changes = runner.drain(so.occupancy_changes(stream(v)))
    return plain(tables.last_write_wins(changes, ["room", "ts"], "seq").drop("seq"), "ts")


@query("t13_enrichment", "SELECT event_id, CASE WHEN room IN ('livingroom','kitchen') THEN 'living_kitchen' ELSE room END AS merged_room, CASE state WHEN 'on' THEN 'activation' WHEN 'off' THEN 'deactivation' ELSE 'unknown' END AS transition, CAST(state = 'on' AS INT) AS active, hour(ts) AS hour FROM se")
def _(v):
    return runner.drain(so.enriched(stream(v)).select("event_id", "merged_room", "transition", "active", "hour"))


@query("t14_observed", "SELECT event_id, room FROM se")
def _(v):
    return runner.drain(so.counted(stream(v)).select("event_id", "room"))


@query("t14_processing_stats", "SELECT count(*) AS processed, count(*) FILTER (state IS NULL) AS failed, max(ts) AS \"last\" FROM se")
def _(v):
    seen: list[dict] = []
    runner.drain(so.counted(stream(v)).select("event_id", "room"), observed=seen)
    triggers = [m["processed"] for m in seen if "processed" in m]
    rows = v.spark.createDataFrame([(m["processed"], m["failed"], m["last"]) for m in triggers], "processed long, failed long, last string")
    return rows.agg(F.coalesce(F.sum("processed"), F.lit(0)).alias("processed"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"), F.max("last").cast(NTZ).alias("last"))


@query("t15_overlapping_blocks", ", r AS (SELECT room, event_id, row_number() OVER (PARTITION BY room ORDER BY ts, event_id) - 1 AS i FROM se), x AS (SELECT room, event_id, i, unnest(range(greatest(0, (i - 50)//50), i//50 + 1)) AS b FROM r) SELECT room, CAST(b AS INT) AS block, count(*) AS n, min(event_id) AS first_id FROM x GROUP BY room, b")
def _(v):
    return patterns.overlapping_blocks(v.se).groupBy("room", "block").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("t15_stream_blocks", ", r AS (SELECT room, event_id, row_number() OVER (PARTITION BY room ORDER BY ts, event_id) - 1 AS i FROM se), x AS (SELECT room, event_id, i, unnest(range(greatest(0, (i - 50)//50), i//50 + 1)) AS b FROM r) SELECT room, CAST(b AS INT) AS block, count(*) AS n, min(event_id) AS first_id, arg_min(event_id, i) AS opens, arg_max(event_id, i) AS closes FROM x GROUP BY room, b HAVING count(*) = 100")
def _(v):
    """The full blocks, from a stream whose events come in three triggers."""
    rows = timed(v).select("room", "event_id", "ts")
    at = temporal.micros("ts")
    first, last = rows.agg(F.min(at), F.max(at)).first()
    one, two = (int((first or 0) + share * ((last or 0) - (first or 0))) for share in (0.3, 0.7))
    return runner.in_turns([rows.where(at <= one), rows.where((at > one) & (at <= two)), rows.where(at > two)], so.overlapping_blocks)


@query("j14_stream_interval_join", "SELECT p.event_id, p.room, round(p.probability, 6) AS probability, o.occupied FROM pr p JOIN oc o ON o.room = p.room AND o.ts BETWEEN p.predicted_for - INTERVAL 5 MINUTE AND p.predicted_for + INTERVAL 5 MINUTE")
def _(v):
    p = fixtures.predictions(stream(v, None))
    o = fixtures.room_occupancy(stream(v, None))
    return runner.drain(so.interval_matches(p, o)).withColumn("probability", r6("probability"))
