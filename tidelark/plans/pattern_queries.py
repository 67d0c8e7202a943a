"""M: sequence and pattern mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelark.operators import bathroom, patterns
from tidelark.plans import fold_sql
from tidelark.plans.base import query, r6

SEQ = """, tk AS (SELECT room, ts, event_id, sensor_type || '-' || state AS x, row_number() OVER (PARTITION BY room ORDER BY ts, event_id) AS i FROM se {where}), sq AS (SELECT a.room, a.ts AS start_ts, a.event_id, n.n AS n, string_agg(b.x, '->' ORDER BY b.i) AS signature, round((epoch_us(max(b.ts)) - epoch_us(a.ts))/1e6, 6) AS span_s
 FROM tk a JOIN (SELECT unnest(range(2, {longest} + 1)) AS n) n ON true JOIN tk b ON b.room = a.room AND b.i BETWEEN a.i AND a.i + n.n - 1 GROUP BY a.room, a.ts, a.event_id, n.n HAVING count(*) = n.n)"""
ALL, STAIRS = SEQ.format(where="", longest=5), SEQ.format(where="WHERE room IN ('office','kitchen')", longest=5)
WINDOWS = f"(SELECT unnest({patterns.WINDOWS}) AS m)"


def found(v, where="true", longest=5):
    return patterns.sequences(v.se.where(where), patterns.token("sensor_type", "state"), longest)


@query("m01_sequences", ALL + "SELECT event_id, CAST(n AS INT) AS n, signature, span_s FROM sq")
def _(v):
    return found(v).select("event_id", "n", "signature", r6("span_s").alias("span_s"))


COUNTS = f", wc AS (SELECT room, signature, (SELECT min(m) FROM {WINDOWS} w WHERE m*60 >= span_s) AS window_min, count(*) AS n FROM sq GROUP BY ALL), cc AS (SELECT room, signature, window_min, CAST(sum(n) OVER (PARTITION BY room, signature ORDER BY window_min) AS BIGINT) AS n FROM wc WHERE window_min IS NOT NULL)"


@query("m02_windowed_counts", ALL + COUNTS + "SELECT room, signature, CAST(window_min AS INT) AS window_min, n FROM cc")
def _(v):
    return patterns.windowed_counts(found(v))


CHI = ", ct AS (SELECT room, signature, count(*) AS n FROM sq GROUP BY ALL), ch AS (SELECT room, count(*) AS kinds, CAST(sum(n) AS BIGINT) AS total, sum(n*n)/(sum(n)/count(*)) - sum(n) AS chi2 FROM ct GROUP BY room) SELECT room, kinds, total, round(chi2, 4) AS chi2, round(CASE WHEN kinds < 2 THEN 0 ELSE 1/(1 + chi2) END, 6)::DOUBLE AS p_value FROM ch"


def chi(df):
    return patterns.uniform_chi_square(df.groupBy("room", "signature").agg(F.count("*").alias("n")), ["room"]).select("room", "kinds", "total", F.round("chi2", 4).alias("chi2"), r6("p_value").alias("p_value"))


@query("m03_chi_square", ALL + CHI)
def _(v):
    return chi(found(v))


LONG = [5, 10, 20, 50, 100]
LONG_SQL = f""", tk AS (SELECT room, event_id, state AS x, row_number() OVER (PARTITION BY room ORDER BY ts, event_id) AS i FROM se), gr AS (SELECT a.room, a.i, n.n, string_agg(b.x, '->' ORDER BY b.i) AS s FROM tk a JOIN (SELECT unnest({LONG}) AS n) n ON true JOIN tk b ON b.room = a.room AND b.i BETWEEN a.i AND a.i + n.n - 1 GROUP BY a.room, a.i, n.n HAVING count(*) = n.n),
 ct AS (SELECT room, n, s, count(*) AS f FROM gr GROUP BY ALL) SELECT room, CAST(n AS INT) AS n, count(*) AS kinds, CAST(sum(f) AS BIGINT) AS total, max(f) AS most FROM ct GROUP BY room, n"""


@query("m01_long_sequences", LONG_SQL)
def _(v):
    return patterns.long_sequences(v.se, F.col("state"), LONG)


POSSIBLE = ", kd AS (SELECT DISTINCT sensor_type || '-' || state AS x FROM se), pa(s, l, n) AS (SELECT x, [x], 1 FROM kd UNION ALL SELECT s || '->' || x, list_append(l, x), n + 1 FROM pa JOIN kd ON n < {longest} AND NOT list_contains(l, x)), ps AS (SELECT s AS signature FROM pa WHERE n > 1)"


def possible(v, longest=3):
    return patterns.possible_signatures(v.se.select(patterns.token("sensor_type", "state").alias("x")), longest=longest)


@query("m04_possible_signatures", POSSIBLE.format(longest=3) + "SELECT signature FROM ps")
def _(v):
    return possible(v)


@query("m05_negative_patterns", SEQ.format(where="", longest=5) + POSSIBLE.format(longest=5) + ", rm AS (SELECT DISTINCT room FROM sq) SELECT room, signature, 0.8::DOUBLE AS strength FROM ps JOIN rm ON true WHERE NOT EXISTS (SELECT 1 FROM sq WHERE sq.room = rm.room AND sq.signature = ps.signature)")
def _(v):
    return patterns.negative_patterns(possible(v, 5), found(v), ("room",))


STATES = SEQ.format(where="", longest=19).replace("sensor_type || '-' || state AS x", "state AS x")


@query("m06_repeated_ngrams", STATES + ", t AS (SELECT room, count(*) AS total FROM se GROUP BY room), g AS (SELECT room, signature, n, count(*) AS frequency FROM sq GROUP BY ALL HAVING count(*) >= 3) SELECT room, signature, CAST(n AS INT) AS n, frequency, round((total - n + 1)/pow(4, n), 6) AS expected, round(least(1, frequency/(0.1*total)), 6)::DOUBLE AS significance FROM g JOIN t USING (room) WHERE frequency > 2*(total - n + 1)/pow(4, n)")
def _(v):
    out = patterns.repeated_ngrams(v.se, F.col("state"), 19)
    return out.select("room", "signature", "n", "frequency", r6("expected").alias("expected"), r6("significance").alias("significance"))


SPANS = """, st AS (SELECT dense_rank() OVER (ORDER BY room, CAST(ts AS DATE), hour(ts)) AS s, row_number() OVER (PARTITION BY room, CAST(ts AS DATE), hour(ts) ORDER BY ts, event_id) AS i, sensor_type || '-' || state AS x FROM se),
 -- the earliest end of each session's pattern is enough to extend it
 p1 AS (SELECT s, x AS pattern, min(i) AS e FROM st GROUP BY ALL), p2 AS (SELECT a.s, a.pattern || '->' || b.x AS pattern, min(b.i) AS e FROM p1 a JOIN st b ON b.s = a.s AND b.i > a.e GROUP BY ALL),
 p3 AS (SELECT a.s, a.pattern || '->' || b.x AS pattern, min(b.i) AS e FROM p2 a JOIN st b ON b.s = a.s AND b.i > a.e GROUP BY ALL), pp AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)
SELECT pattern, count(*) AS freq FROM pp GROUP BY 1 HAVING count(*) >= (SELECT ceil(0.05 * max(s)) FROM st)"""


@query("m07_prefix_span", SPANS)
def _(v):
    return patterns.prefix_span(patterns.daily_sessions(v.se, patterns.token("sensor_type", "state")), least_support=0.05, longest=3)


@query("m08_transition_areas", STAIRS + CHI)
def _(v):
    return chi(found(v, "room IN ('office','kitchen')"))


@query("m09_room_patterns", SEQ.format(where="WHERE room = 'bathroom'", longest=5) + "SELECT signature, count(*) AS n FROM sq GROUP BY 1 HAVING count(*) >= 2")
def _(v):
    return found(v, "room = 'bathroom'").groupBy("signature").agg(F.count("*").alias("n")).where("n >= 2")


@query("m10_pet_signatures", ", x AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER w))/1e6 AS dt FROM se WHERE person IS NOT NULL WINDOW w AS (PARTITION BY person ORDER BY ts, event_id)), y AS (SELECT *, sum(CASE WHEN dt > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY person ORDER BY ts, event_id) AS s FROM x) SELECT DISTINCT string_agg(room || ':' || state, '->' ORDER BY ts, event_id) AS signature FROM y GROUP BY person, s HAVING count(*) > 1 AND (count(*) FILTER (dt <= 600 AND dt < 60) > 2 OR epoch_us(max(ts)) - epoch_us(min(ts)) < 60000000)")
def _(v):
    from tidelark.operators.temporal import micros, seconds_between
    from pyspark.sql import Window as W

    w = W.partitionBy("person").orderBy("ts", "event_id")
    x = v.se.where("person is not null").withColumn("dt", seconds_between("ts", F.lag("ts").over(w)))
    y = x.withColumn("s", F.sum(F.when(F.col("dt") > 600, 1).otherwise(0)).over(w))
    g = y.groupBy("person", "s").agg(F.count("*").alias("n"), F.count(F.when((F.col("dt") <= 600) & (F.col("dt") < 60), 1)).alias("fast"), (F.max(micros("ts")) - F.min(micros("ts"))).alias("span"), F.array_sort(F.collect_list(F.struct("ts", "event_id", F.concat_ws(":", "room", "state").alias("x")))).alias("steps"))
    tagged = g.where("n > 1 AND (fast > 2 OR span < 60000000)")
    return tagged.select(F.array_join(F.transform("steps", lambda s: s["x"]), "->").alias("signature")).distinct()


@query("m11_pattern_ranking", ALL + "SELECT signature, count(*) AS frequency FROM sq WHERE room = 'kitchen' GROUP BY 1 ORDER BY frequency DESC, signature LIMIT 20")
def _(v):
    return found(v, "room = 'kitchen'").groupBy("signature").agg(F.count("*").alias("frequency")).orderBy(F.desc("frequency"), "signature").limit(20)


USAGE = """ SELECT room, 'bathroom_usage' AS pattern_type, '{"hour":' || hour(ts) || ',"weekday":' || (isodow(ts) - 1) || ',"reason":"' || reason || '","occupied":' || occupied || '}' AS pattern_data, confidence, ts AS discovered_at, event_id FROM br"""


@query("m12_usage_patterns", fold_sql.BATHROOM + USAGE)
def _(v):
    return patterns.pattern_rows(bathroom.bathroom_states(v.se)).withColumns({"discovered_at": F.col("discovered_at").cast("timestamp_ntz"), "confidence": r6("confidence")})


