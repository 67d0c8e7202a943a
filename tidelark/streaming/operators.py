"""Streaming forms: messages, windows, de-duplication, state and joins."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidelark.functions import enrich
from tidelark.operators import bathroom, drift
from tidelark.operators.segments import bucket_of
from tidelark.sources import tables
from tidelark.streaming import runner

EVENT = "event_id long, ts string, entity_id string, state string, room string, sensor_type string, attributes string"
PREDICTION = "event_id long, ts string, room string, horizon_minutes int, probability double, model_name string"
ANOMALY = "event_id long, ts string, room string, anomaly_type string, anomaly_score double"


def parsed(raw: DataFrame, schema: str) -> DataFrame:
    """JSON values as columns, with ts as event time; what doesn't parse keeps its text in _corrupt_record."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    brought = [c for c in ("value", "arrived") if c in raw.columns]
    rows = raw.select(*brought, F.from_json("value", f"{schema}, _corrupt_record string", options).alias("m")).select(*brought, "m.*")
    return rows.withColumn("ts", F.try_to_timestamp("ts"))


def good(rows: DataFrame, required: tuple[str, ...] = ("event_id", "ts")) -> DataFrame:
    bad = F.col("_corrupt_record").isNotNull()
    for c in required:
        bad = bad | F.col(c).isNull()
    return rows.where(~bad).drop("value", "_corrupt_record")


def dead_letters(rows: DataFrame, required: tuple[str, ...] = ("event_id", "ts")) -> DataFrame:
    """Rejected values with the reason, and when they arrived if the messages say so."""
    reason = F.when(F.col("_corrupt_record").isNotNull(), "malformed")
    for c in required:
        reason = reason.when(F.col(c).isNull(), f"missing {c}")
    brought = [c for c in ("value", "arrived") if c in rows.columns]
    return rows.select(*brought, reason.alias("reason")).where("reason is not null")


def last_errors(letters: DataFrame, n: int = 100) -> DataFrame:
    """The last n rejected messages by arrival, each with ``failed``, the count of all rejected up to it."""
    newest = [F.desc("arrived"), F.desc("value")]
    last = letters.orderBy(*newest).limit(n)
    return last.withColumn("failed", F.lit(letters.count()) + 1 - F.row_number().over(W.orderBy(*newest)))  # over n rows


def messages(events: DataFrame, key: str = "room") -> DataFrame:
    """Keyed JSON rows for a topic."""
    return events.select(F.col(key).alias("key"), F.to_json(F.struct(*events.columns)).alias("value"))


def merged_sources(pushed: DataFrame, polled: DataFrame) -> DataFrame:
    return pushed.withColumn("source", F.lit("push")).unionByName(polled.withColumn("source", F.lit("poll")))


def changed_only(events: DataFrame, keys: tuple[str, ...] = ("entity_id", "ts")) -> DataFrame:
    """One row for each change, whichever source brings it first; duplicates must come within the watermark's delay."""
    return events.dropDuplicatesWithinWatermark(list(keys))


def once_a_minute(events: DataFrame) -> DataFrame:
    return events.withColumn("cache_key", enrich.cache_key()).dropDuplicatesWithinWatermark(["cache_key"])


def tumbling(events: DataFrame, width: str, keys: tuple[str, ...] = ("room",)) -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sliding(events: DataFrame, width: str = "30 minutes", slide: str = "5 minutes", keys: tuple[str, ...] = ("room",)) -> DataFrame:
    return events.groupBy(F.window("ts", width, slide).alias("w"), *keys).agg(F.count("*").alias("n"), F.count_if(F.col("state") == "on").alias("n_on")).select(F.col("w.start").alias("start"), *keys, "n", "n_on")


def sessions(events: DataFrame, gap: str = "10 minutes", keys: tuple[str, ...] = ("person",)) -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def hourly_rollup(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "room", "sensor_type").agg(F.count("*").alias("n"), F.avg("numeric_value").alias("mean_value")).select(F.col("w.start").alias("hour"), "room", "sensor_type", "n", "mean_value")


def occupancy_changes(events: DataFrame) -> DataFrame:
    some = events.where("sensor_type = 'presence' AND state IN ('on', 'off')")
    return some.select("room", "ts", (F.col("state") == "on").alias("occupied"), F.col("event_id").alias("seq"))


def enriched(events: DataFrame) -> DataFrame:
    return events.withColumns({"merged_room": enrich.merged_room(), "transition": enrich.transition_class(), "active": enrich.is_active(), "hour": F.hour("ts")})


def interval_matches(preds: DataFrame, occupancy: DataFrame, minutes: int = 5, delay: str = "3 hours") -> DataFrame:
    """Stream-stream form of the interval join; both sides' state is bounded by their watermarks.

    Times are cut into buckets as long as the range.  A prediction is in one, an observation is dealt to those that it can
    reach, and both are keys of the join: a row meets the state of its bucket, not all of its room's.
    """
    p = preds.select("event_id", F.col("room").alias("p_room"), "predicted_for", "probability").withWatermark("predicted_for", delay)
    o = occupancy.select(F.col("room").alias("o_room"), F.col("ts").alias("observed_at"), "occupied").withWatermark("observed_at", delay)
    step = F.make_dt_interval(mins=F.lit(minutes))
    place = lambda t: bucket_of(t, 2 * 60 * minutes)
    p = p.withColumn("p_in", place("predicted_for"))
    o = o.withColumn("o_in", F.explode(F.sequence(place(F.col("observed_at") - step), place(F.col("observed_at") + step))))
    on = (F.col("p_room") == F.col("o_room")) & (F.col("p_in") == F.col("o_in")) & (F.col("observed_at") >= F.col("predicted_for") - step) & (F.col("observed_at") <= F.col("predicted_for") + step)
    return p.join(o, on).select("event_id", F.col("p_room").alias("room"), "probability", "occupied")


def fold_batches(at: str, keys: list[str], order: list[str], fold: Callable[[dict, pd.DataFrame], tuple[dict, pd.DataFrame]], schema: str):
    """A foreachBatch function that writes what ``fold(state, rows)`` answers over each key's rows in order to ``at``/n=number.

    fold takes and returns the key's state, a dict that JSON can hold, and any number of consecutive rows at a time.  A
    trigger's rows are sorted by Spark and reach Python slice by slice, so a task holds one slice, however many rows
    of a key the trigger brings.  The states, a row with _k for each key, lie beside the answers: a trigger reads those of the one
    before, and one that is run again replaces what it wrote.
    """
    states, written = "_k string, _state string", f"{schema}, _k string, _state string"
    names = [f.name for f in StructType.fromDDL(written)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, {}
        for rows in batches:
            columns = [c for c in rows.columns if c not in ("_k", "_state")]
            answers, left = [], []
            for k, part in rows.groupby("_k", sort=False):
                if k != key:
                    if key is not None:
                        left.append((key, json.dumps(state)))
                    key, state = k, {}
                held = part["_state"].notna()
                if held.any():
                    state, part = json.loads(part["_state"][held].iloc[0]), part[~held]
                if len(part):
                    state, out = fold(state, part[columns])
                    if len(out):
                        answers.append(out)
            if answers:
                yield pd.concat(answers).assign(_k=None, _state=None)
            if left:
                yield ended(left)
        if key is not None:
            yield ended([(key, json.dumps(state))])

    def ended(left: list[tuple[str, str]]) -> pd.DataFrame:
        return pd.DataFrame([(*[None] * (len(names) - 2), *row) for row in left], columns=names, dtype=object)

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.withColumns({"_k": F.to_json(F.struct(*keys)), "_state": F.lit(None).cast("string")})
        if number:
            before = batch.sparkSession.read.schema(states).parquet(f"{at}/n={number - 1}").where("_k is not null")
            rows = rows.unionByName(before, allowMissingColumns=True)
        sorted_rows = rows.repartition("_k").sortWithinPartitions("_k", F.col("_state").isNull(), *order)
        sorted_rows.mapInPandas(run, written).write.mode("overwrite").parquet(f"{at}/n={number}")

    return put


def folded(df: DataFrame, keys: list[str], order: list[str], fold: Callable, schema: str) -> DataFrame:
    """Runs a stream to the end of what is there with ``fold_batches`` and returns its answers."""
    spark, at = df.sparkSession, runner.folder(df.sparkSession)
    runner.drain(df, each=fold_batches(f"{at}/answers", keys, order, fold, schema))
    return spark.read.schema(f"{schema}, _k string").parquet(f"{at}/answers/n=*").where("_k is null").drop("_k")


def _delta(kept: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
    at = rows["ts"].astype("int64") // 1000 if str(rows["ts"].dtype) == "datetime64[ns]" else rows["ts"].astype("datetime64[us]").astype("int64")
    before = at.shift(1)
    before.iloc[0] = kept.get("at")
    return {"at": int(at.iloc[-1])}, pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "delta_s": ((at - before.astype("float64")) / 1e6).to_numpy()})


def _bathroom(kept: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
    machine = bathroom.Machine(**kept)
    out = bathroom.results(machine, rows)
    return asdict(machine), out


def _drift(kept: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
    """Page-Hinkley and Kolmogorov-Smirnov alarms of a key, at most one in each cooldown."""
    ph, ks, quiet = drift.PageHinkley(**kept.get("ph", {})), drift.KolmogorovSmirnov(**kept.get("ks", {})), drift.Cooldown(**kept.get("quiet", {}))
    out = []
    for r in rows.itertuples():
        a, b = ph.add(r.x), ks.add(r.x)
        if (a or b) and quiet.add(r.ts.value / 1e9):
            out.append((r.room, r.event_id, a, b))
    return {"ph": asdict(ph), "ks": asdict(ks), "quiet": asdict(quiet)}, pd.DataFrame(out, columns=["room", "event_id", "page_hinkley", "ks"])


def _stateful(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, time: str = "None") -> DataFrame:
    return df.groupBy(*keys).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode=time)


def last_change_delta(events: DataFrame) -> DataFrame:
    """Runs the stream to its end: seconds since the last event of each event's entity."""
    return folded(events.select("entity_id", "event_id", "ts"), ["entity_id"], ["ts", "event_id"], _delta, "event_id long, delta_s double")


def bathroom_machine(events: DataFrame) -> DataFrame:
    """Runs the stream to its end: what the machine of each room says."""
    some = events.where("sensor_type IN ('entrance', 'door')").select("room", "event_id", "ts", "sensor_type", "state")
    return folded(some, ["room"], ["ts", "event_id"], _bathroom, bathroom.RESULT)


def drift_alerts(rows: DataFrame) -> DataFrame:
    """Runs the stream to its end: alarms over rows(room, event_id, ts, x)."""
    return folded(rows, ["room"], ["ts", "event_id"], _drift, "room string, event_id long, page_hinkley boolean, ks boolean")


class _Blocks(StatefulProcessor):
    """A list of the newest events; at ``size`` they are a block, and the last ``size - step`` stay for the next one."""

    def __init__(self, size: int, step: int):
        self.size, self.step = size, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getListState("events", "event_id long, ts timestamp")
        self.number = handle.getValueState("number", "block int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        held = [(int(e), t) for e, t in self.events.get()] if self.events.exists() else []
        held += [(int(e), t.to_pydatetime()) for e, t in zip(new["event_id"], new["ts"], strict=True)]
        block, out = self.number.get()[0] if self.number.exists() else 0, []
        start = 0
        while len(held) - start >= self.size:
            ids = [e for e, _ in held[start : start + self.size]]
            out.append((key[0], block, len(ids), min(ids), ids[0], ids[-1]))
            block, start = block + 1, start + self.step
        self.events.put(held[start:]) if held[start:] else self.events.clear()
        self.number.update((block,))
        if out:
            yield pd.DataFrame(out, columns=["room", "block", "n", "first_id", "opens", "closes"])

    def close(self) -> None:
        pass


def overlapping_blocks(events: DataFrame, size: int = 100, step: int = 50) -> DataFrame:
    """Counted windows of each room in a stream: every ``step`` events, the last ``size`` ones are a block.

    Events of a room must come in order from trigger to trigger; inside a trigger they are sorted.
    """
    return _stateful(events.select("room", "event_id", "ts"), ["room"], _Blocks(size, step), "room string, block int, n int, first_id long, opens long, closes long")


class _Buffer(StatefulProcessor):
    """Events of a key wait until ``most`` are there, or until the first of them has waited ``wait_ms``."""

    def __init__(self, most: int, wait_ms: int):
        self.most, self.wait_ms = most, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "event_id long")
        self.number = handle.getValueState("number", "batch int")
        self.due = handle.getValueState("due", "at long")

    def _number(self) -> int:
        return self.number.get()[0] if self.number.exists() else 0

    def _rest(self, held: list[int]) -> None:
        self.events.put([(e,) for e in held]) if held else self.events.clear()

    def _stop_clock(self) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()

    def _frame(self, key, number: int, ids: list[int], reason: str) -> pd.DataFrame:
        return pd.DataFrame({"room": key[0], "batch": number, "event_id": ids, "reason": reason})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [int(r[0]) for r in self.events.get()] if self.events.exists() else []
        waited = bool(held)
        held += [int(e) for part in rows for e in part["event_id"]]
        number = self._number()
        while len(held) >= self.most:
            yield self._frame(key, number, held[: self.most], "full")
            held, number, waited = held[self.most :], number + 1, False
        self.number.update((number,))
        self._rest(held)
        if not waited:
            self._stop_clock()
            if held:
                at = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
                self.handle.registerTimer(at)
                self.due.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [int(r[0]) for r in self.events.get()] if self.events.exists() else []
        number = self._number()
        self.due.clear()
        if held:
            self.number.update((number + 1,))
            self.events.clear()
            yield self._frame(key, number, held, "timeout")

    def close(self) -> None:
        pass


def micro_batches(events: DataFrame, most: int = 1000, wait_ms: int = 10_000) -> DataFrame:
    """Each event with the batch of its room that it left in, which was full or had waited long enough (processing time)."""
    return _stateful(events.select("room", "event_id"), ["room"], _Buffer(most, wait_ms), "room string, batch int, event_id long, reason string", "ProcessingTime")


class _Once(StatefulProcessor):
    """Lets a key's first event of a trigger pass unless one passed less than ``ttl_ms`` ago; the state store forgets it after that."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "event_id long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = min(int(part["event_id"].min()) for part in rows)
        if not self.seen.exists():
            self.seen.update((first,))
            yield pd.DataFrame({"key": [key[0]], "event_id": [first]})

    def close(self) -> None:
        pass


def once_per(events: DataFrame, key: str, ttl_ms: int) -> DataFrame:
    """A cache with expiry: key and event_id of each event that finds no entry of its key that is younger than ``ttl_ms`` (processing time)."""
    return _stateful(events.select(F.col(key).alias("key"), "event_id"), ["key"], _Once(ttl_ms), "key string, event_id long", "ProcessingTime")


def fan_out(store: str, topic: str, features: str):
    """A foreachBatch function that writes one batch to a table, as messages and as features."""

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.write.mode("overwrite").parquet(f"{store}/n={number}")
        messages(batch).write.mode("overwrite").parquet(f"{topic}/n={number}")
        enriched(batch).write.mode("overwrite").parquet(f"{features}/n={number}")
        batch.unpersist()

    return put


def cache_latest(path: str, keys: list[str], kind: str):
    """A foreachBatch function that appends each batch's latest rows with their expiry."""

    def put(batch: DataFrame, number: int) -> None:
        tables.cache_rows(batch, keys, kind).write.mode("overwrite").parquet(f"{path}/n={number}")

    return put


def counted(events: DataFrame, name: str = "processed") -> DataFrame:
    """Events with observed metrics: processed, failed, and the last time as text, for a listener or the query's progress."""
    return events.observe(name, F.count(F.lit(1)).alias("processed"), F.count_if(F.col("state").isNull()).alias("failed"), F.max("ts").cast("string").alias("last"))
