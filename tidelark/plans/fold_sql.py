"""SQL of the folds: recursive tables that take one more row of each room in every step."""

#: Rows of a room in order, with the value x; {x} is its expression.
ROWS = """, nx AS (SELECT room, event_id, CAST({x} AS DOUBLE) AS x, epoch_us(ts)/1e6 AS sec, row_number() OVER (PARTITION BY room ORDER BY ts, event_id) AS i FROM se {where})"""

PAGE_HINKLEY = """, ph AS (SELECT room, event_id, i, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down, CAST(0 AS DOUBLE) AS low, CAST(0 AS DOUBLE) AS high, false AS alarm FROM nx WHERE i = 1
 UNION ALL SELECT room, event_id, i, CASE WHEN a THEN 0 ELSE u END, CASE WHEN a THEN 0 ELSE d END, CASE WHEN a THEN 0 ELSE l END, CASE WHEN a THEN 0 ELSE h END, a
 FROM (SELECT *, u - l > 50 OR h - d > 50 AS a FROM (SELECT *, least(low, u) AS l, greatest(high, d) AS h FROM (SELECT nx.room, nx.event_id, nx.i, low, high, up + (x - 0.05) AS u, down + (x + 0.05) AS d FROM ph JOIN nx ON nx.room = ph.room AND nx.i = ph.i + 1) q) q) q)"""

KOLMOGOROV = """, ks AS (SELECT DISTINCT room, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS i, CAST([] AS DOUBLE[]) AS ref, CAST([] AS DOUBLE[]) AS cur, false AS alarm FROM nx
 UNION ALL SELECT room, event_id, i, CASE WHEN a THEN c ELSE r END, CASE WHEN a THEN CAST([] AS DOUBLE[]) ELSE c END, a
 FROM (SELECT *, len(c) = 100 AND coalesce(list_max(list_transform(list_sort(r), lambda v, j: abs(j/100.0 - len(list_filter(c, lambda y: y <= v))/100.0))), 0) > 1.36*sqrt(2/100.0) AS a
 FROM (SELECT nx.room, nx.event_id, nx.i, CASE WHEN len(ref) < 100 THEN list_append(ref, x) ELSE ref END AS r, CASE WHEN len(ref) < 100 THEN cur ELSE list_slice(list_append(cur, x), -100, -1) END AS c FROM ks JOIN nx ON nx.room = ks.room AND nx.i = ks.i + 1) q) q)"""

#: Rows of {rows} (room, event_id, sec, i from 1 without gaps) that pass if none passed in the half hour before.
COOLDOWN = """, cd AS (SELECT room, event_id, i, sec AS last, true AS kept FROM {rows} WHERE i = 1
 UNION ALL SELECT n.room, n.event_id, n.i, CASE WHEN n.sec - c.last >= 1800 THEN n.sec ELSE c.last END, n.sec - c.last >= 1800 FROM cd c JOIN {rows} n ON n.room = c.room AND n.i = c.i + 1)"""

ADWIN = """, an AS (SELECT room, event_id, i AS n, x, avg(x) OVER (PARTITION BY room ORDER BY i ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS a, avg(x) OVER (PARTITION BY room ORDER BY i ROWS BETWEEN 49 PRECEDING AND 25 PRECEDING) AS b FROM nx),
 al AS (SELECT *, CASE WHEN n <= 1000 THEN n ELSE 501 + (n - 1001) % 500 END AS len FROM an), ac AS (SELECT *, sum(x) OVER w AS s, sum(x*x) OVER w AS q FROM al WINDOW w AS (PARTITION BY room ORDER BY n)),
 ad AS (SELECT c.room, c.event_id, c.n AS i, coalesce(c.len >= 50 AND abs(c.a - c.b) > 3*sqrt(greatest(0, (c.q - coalesce(o.q, 0))/c.len - pow((c.s - coalesce(o.s, 0))/c.len, 2))), false) AS alarm FROM ac c LEFT JOIN ac o ON o.room = c.room AND o.n = c.n - c.len)"""

BATHROOM = """, ev AS (SELECT room, event_id, ts, epoch_us(ts)/1e6 AS sec, CAST(hour(ts) AS INT) AS h, sensor_type AS s, state AS st, row_number() OVER (PARTITION BY room ORDER BY ts, event_id) AS i FROM se WHERE sensor_type IN ('entrance', 'door')),
 bm AS (SELECT DISTINCT room, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS TIMESTAMP) AS ts, false AS occ, CAST(NULL AS DOUBLE) AS ent, false AS closed, false AS trig, CAST(0.5 AS DOUBLE) AS dp, list_transform(range(24), lambda j: CAST(0 AS DOUBLE)) AS sums, list_transform(range(24), lambda j: CAST(0 AS BIGINT)) AS counts, CAST(NULL AS VARCHAR) AS act, CAST(NULL AS DOUBLE) AS conf, CAST(NULL AS DOUBLE) AS dur FROM ev
 UNION ALL SELECT room, i, event_id, ts, CASE WHEN act IN ('enter', 'shut') THEN true WHEN act IN ('clear', 'open') THEN false ELSE occ END, CASE WHEN act = 'enter' THEN sec ELSE ent END, CASE WHEN s = 'door' THEN st = 'off' ELSE closed END, CASE WHEN act = 'enter' THEN true WHEN act IN ('clear', 'open') THEN false ELSE trig END,
 CASE WHEN s = 'door' THEN 0.9*dp + CASE WHEN st = 'off' THEN 0.1 ELSE 0 END ELSE dp END,
 CASE WHEN act IN ('clear', 'open') THEN list_transform(sums, lambda v, j: CASE WHEN j = h + 1 THEN v + (sec - ent) ELSE v END) ELSE sums END, CASE WHEN act IN ('clear', 'open') THEN list_transform(counts, lambda v, j: CASE WHEN j = h + 1 THEN v + 1 ELSE v END) ELSE counts END, act,
 CASE act WHEN 'already' THEN 0.3 WHEN 'enter' THEN least(0.95, CASE WHEN h BETWEEN 6 AND 9 OR h BETWEEN 21 AND 23 THEN 0.8 WHEN h BETWEEN 12 AND 14 THEN 0.6 ELSE 0.5 END + CASE WHEN counts[h + 1] > 5 THEN 0.1 ELSE 0 END) WHEN 'clear' THEN 0.7 WHEN 'shut' THEN 0.95 WHEN 'open' THEN 0.8 ELSE 0.5 END,
 CASE WHEN act = 'enter' THEN typ WHEN act IN ('clear', 'open') THEN sec - ent END
 FROM (SELECT *, CASE WHEN s = 'entrance' AND st IN ('on', 'detected') THEN CASE WHEN occ THEN 'already' ELSE 'enter' END WHEN s = 'entrance' THEN CASE WHEN occ AND sec - ent > 0.5*typ AND NOT closed THEN 'clear' ELSE 'none' END WHEN st = 'off' AND trig THEN 'shut' WHEN st <> 'off' AND occ AND sec - ent > 0.8*typ THEN 'open' ELSE 'kept' END AS act
 FROM (SELECT ev.*, occ, ent, closed, trig, dp, sums, counts, CASE WHEN counts[h + 1] > 3 THEN sums[h + 1]/counts[h + 1] WHEN h BETWEEN 6 AND 9 THEN 180 WHEN h BETWEEN 21 AND 23 THEN 300 ELSE 120 END AS typ FROM bm JOIN ev ON ev.room = bm.room AND ev.i = bm.i + 1) q) q),
 br AS (SELECT event_id, room, ts, CASE WHEN act IN ('already', 'enter', 'shut') THEN true WHEN act IN ('clear', 'open') THEN false ELSE occ END AS occupied, round(conf, 6) AS confidence, CASE act WHEN 'already' THEN 'already_occupied' WHEN 'enter' THEN 'entrance_trigger' WHEN 'clear' THEN 'entrance_clear' WHEN 'shut' THEN 'door_closed_after_entrance' WHEN 'open' THEN 'door_opened_after_duration' ELSE 'state_maintained' END AS reason, round(dur, 3) AS duration_s, round(dp, 6) AS door_probability FROM bm WHERE act <> 'none')"""
