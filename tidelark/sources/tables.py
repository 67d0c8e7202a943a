"""Reading, upserting, caching and expiring event tables."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds that a cached kind of value stays valid.
TTL = {"features": 300, "predictions": 120, "patterns": 3600, "room_state": 1800, "models": 7200, "aggregates": 600}


def folder(spark: SparkSession, kind: str = "kept") -> str:
    """A new folder under the one that ``spark.checkpoint.dir`` names; in local mode, as in tests, under the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and spark.sparkContext.master.startswith("local"):
        base = spark.conf.get("spark.sql.warehouse.dir")
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def kept(df: DataFrame, of: list[str] | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read back: its lineage is cut and its size known.  The path is appended to ``of``."""
    at = folder(df.sparkSession)
    df.write.parquet(at)
    if of is not None:
        of.append(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def discard(spark: SparkSession, path: str) -> None:
    """Delete what nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_events(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append as Parquet by date, sorted by room and time inside files so that row groups can be skipped."""
    dated = df.withColumn("event_date", F.to_date("ts"))
    salt = F.pmod(F.xxhash64("entity_id" if "entity_id" in df.columns else "event_id"), F.lit(16))
    dated.repartition("event_date", salt).sortWithinPartitions("event_date", "room", "ts").write.mode(mode).partitionBy("event_date").parquet(path)


def between(df: DataFrame, start: Column, end: Column, *, rooms=None, entities=None, closed: bool = True, ts: str = "ts") -> DataFrame:
    """Rows in [start, end] (or [start, end)), with the date condition that prunes partitions where there is one."""
    out = df.where((F.col(ts) >= start) & ((F.col(ts) <= end) if closed else (F.col(ts) < end)))
    if "event_date" in df.columns:
        out = out.where(F.col("event_date").between(F.to_date(start), F.to_date(end)))
    if rooms:
        out = out.where(F.col("room").isin(*rooms))
    if entities:
        out = out.where(F.col("entity_id").isin(*entities))
    return out


def recent(df: DataFrame, as_of: Column, *, minutes: float, ts: str = "ts", **how) -> DataFrame:
    return between(df, as_of - F.make_dt_interval(secs=F.lit(minutes * 60.0)), as_of, ts=ts, **how)


def last_write_wins(df: DataFrame, keys: list[str], seq: str, defaults: dict | None = None) -> DataFrame:
    """One row for each key: the one with the greatest ``seq``, and of equal ones the one with the greatest hash; nulls in it become the defaults."""
    rest = [c for c in df.columns if c not in keys]
    plain = [c for c in rest if "map<" not in df.schema[c].dataType.simpleString()]
    newest = F.max_by(F.struct(*rest), F.struct(seq, F.xxhash64(*plain)))
    out = df.groupBy(*keys).agg(newest.alias("_r")).select(*keys, "_r.*").select(*df.columns)
    for name, value in (defaults or {}).items():
        out = out.withColumn(name, F.coalesce(name, F.lit(value)))
    return out


def upsert(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], seq: str) -> None:
    """Merge a batch into a Parquet table of versions; readers take the latest version of each key.

    Appending keeps a write linear in the batch; ``compact`` drops old versions.
    """
    last_write_wins(batch, keys, seq).write.mode("append").parquet(path)


def compact(spark: SparkSession, path: str, target: str, keys: list[str], seq: str) -> None:
    last_write_wins(spark.read.parquet(path), keys, seq).write.mode("overwrite").parquet(target)


def cache_rows(df: DataFrame, keys: list[str], kind: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Latest row of each key with the time at which it expires."""
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(ts, tie)).alias("_r")).select(*keys, "_r.*")
    return latest.withColumn("expires_at", F.col(ts) + F.make_dt_interval(secs=F.lit(float(TTL[kind]))))


def fresh(cache: DataFrame, as_of: Column) -> DataFrame:
    return cache.where(F.col("expires_at") > as_of)


def counter(df: DataFrame, name: str, increment: Column, as_of: Column, hours: int = 24, ts: str = "ts") -> DataFrame:
    """Sum of increments by name, for names touched within the last hours."""
    return df.groupBy(name).agg(F.sum(increment).alias("value"), F.max(ts).alias("last")).where(F.col("last") > as_of - F.make_dt_interval(hours=F.lit(hours)))


def drop_matching(cache: DataFrame, pattern: str, key: str = "key") -> DataFrame:
    return cache.where(~F.col(key).like(pattern))


def prefix_counts(cache: DataFrame, key: str = "key") -> DataFrame:
    return cache.groupBy(F.substring_index(key, ":", 1).alias("prefix")).agg(F.count("*").alias("n"))


def expired_counts(df: DataFrame, as_of: Column, days: int, ts: str = "ts") -> DataFrame:
    return df.groupBy((F.col(ts) < as_of - F.make_dt_interval(days=F.lit(days))).alias("expired")).agg(F.count("*").alias("n"))


def retained(df: DataFrame, as_of: Column, days: int, ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts) >= as_of - F.make_dt_interval(days=F.lit(days)))


def _dates(spark: SparkSession, path: str) -> dict[str, str]:
    """The folder of each date partition, by its name alone."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    found = [(s.getPath().getName(), s.getPath().toString()) for s in listed if s.isDirectory()]
    return {name.partition("=")[2]: folder for name, folder in found if name.startswith("event_date=")}


def expire(spark: SparkSession, paths: dict[str, str], as_of: datetime, days: int) -> DataFrame:
    """Drops the rows of tables by ``write_events`` that are older than ``days`` before ``as_of``; returns (table, expired, kept).

    Whole dates go by their folders' names, without a read; only the border date is rewritten. Rows are
    counted for all tables in one job before that.  Rows without a time, and later dates' files, stay as they are.
    """
    border = as_of - timedelta(days=days)
    old = F.coalesce(F.col("ts") < F.lit(border).cast("timestamp_ntz"), F.lit(False))
    counted = None
    for name, path in paths.items():
        one = spark.read.parquet(path).select(F.lit(name).alias("table"), old.alias("_old"))
        counted = one if counted is None else counted.unionByName(one)
    counts = kept(counted.groupBy("table").agg(F.count_if("_old").alias("expired"), F.count_if(~F.col("_old")).alias("kept")))
    for path in paths.values():
        for date, folder in _dates(spark, path).items():
            if date < border.date().isoformat():
                discard(spark, folder)
            elif date == border.date().isoformat():
                rest = kept(spark.read.parquet(path).where(F.col("event_date") == F.lit(date).cast("date")).where(~old))
                if rest.isEmpty():
                    discard(spark, folder)
                else:
                    rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)
    return counts


def backfill(states: DataFrame, meta: DataFrame, attributes: DataFrame, start: Column, end: Column, entities=None) -> DataFrame:
    """History rows of [start, end) with their entity's metadata and attributes, where there are any."""
    rows = between(states, start, end, closed=False, entities=entities)
    return rows.join(meta, "entity_id", "left").join(attributes, "attributes_id", "left")


#: A Monday that all chunks of days are counted from, so that runs over other ranges have the same chunks.
FIRST_DAY = datetime(1970, 1, 5)


def chunks(start: datetime, end: datetime, days: int = 7) -> list[tuple[datetime, datetime]]:
    """[start, end) cut at every ``days`` days after FIRST_DAY."""
    step, out = timedelta(days=days), []
    at = start
    while at < end:
        to = min(FIRST_DAY + ((at - FIRST_DAY) // step + 1) * step, end)
        out.append((at, to))
        at = to
    return out


def import_chunks(states: DataFrame, path: str, finished: str, start: datetime, end: datetime, *, days: int = 7, together: int = 4, at_most: int | None = None) -> int:
    """Imports the rows of [start, end) chunk by chunk, going on where an earlier run stopped; returns how many chunks it imported.

    A chunk is a partition of ``path``, named after its first day, and a row of ``finished`` (chunk, first, last,
    n) that is written after its data, so one that was cut off is imported again and replaces what it left.
    ``together`` chunks are one job; their range of time reaches the scan of ``states``.  A chunk that was
    imported for a part of its days is widened: it is imported whole and has one more row in ``finished``.  ``at_most`` stops a run early.  Rows without a time belong to no chunk.
    """
    spark, step = states.sparkSession, timedelta(days=days)
    schema = "chunk date, first timestamp_ntz, last timestamp_ntz, n long"
    spark.createDataFrame([], schema).write.mode("append").parquet(finished)
    # a row for each chunk, however many rows of states there are
    done = {r.chunk: (r.a, r.b) for r in spark.read.schema(schema).parquet(finished).groupBy("chunk").agg(F.min("first").alias("a"), F.max("last").alias("b")).collect()}
    wanted = []
    for first, last in chunks(start, end, days):
        name = (FIRST_DAY + (first - FIRST_DAY) // step * step).date()
        a, b = done.get(name, (first, last))
        if name not in done or first < a or last > b:
            wanted.append((name, min(a, first), max(b, last)))
    wanted = wanted[:at_most]
    chunk = F.date_add(F.lit(FIRST_DAY.date()), (F.floor(F.date_diff(F.to_date("ts"), F.lit(FIRST_DAY.date())) / days) * days).cast("int"))
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    for i in range(0, len(wanted), together):
        part = wanted[i : i + together]
        rows = between(states, at(part[0][1]), at(part[-1][2]), closed=False).withColumn("chunk", chunk)
        rows = rows.where(" OR ".join(f"(ts >= TIMESTAMP_NTZ '{a}' AND ts < TIMESTAMP_NTZ '{b}')" for _, a, b in part))
        rows.hint("rebalance", "chunk").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path)
        ranges = spark.createDataFrame(part, "chunk date, first timestamp_ntz, last timestamp_ntz")
        written = spark.read.schema(rows.schema).parquet(path).where(F.col("chunk").isin([name for name, *_ in part])).groupBy("chunk").agg(F.count("*").alias("n"))
        ranges.join(written.hint("merge"), "chunk", "left").select("chunk", "first", "last", F.coalesce("n", F.lit(0)).cast("long").alias("n")).write.mode("append").parquet(finished)
    return len(wanted)


def database_states(spark: SparkSession, url: str, table: str, *, partitions: int, lower: str, upper: str, **options) -> DataFrame:
    """The same history over JDBC, read in parallel by time of change."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn="last_changed", lowerBound=lower, upperBound=upper, numPartitions=str(partitions), **options)
    return reader.load()


def prediction_entities(preds: DataFrame) -> DataFrame:
    """Publishable rows: entity id, state and attributes of each prediction."""
    name = F.concat(F.lit("sensor.occupancy_"), "room", F.lit("_"), F.col("horizon_minutes").cast("string"), F.lit("min"))
    return preds.select(name.alias("entity_id"), F.round("probability", 3).alias("state"), F.struct("room", "horizon_minutes", F.round("uncertainty", 3).alias("uncertainty"), F.round("confidence", 3).alias("confidence"), "model_name").alias("attributes"), "ts", "event_id")


def live_entities(df: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Entities whose last row is within the last hours."""
    return df.groupBy("entity_id").agg(F.max("ts").alias("last")).where(F.col("last") >= as_of - F.make_dt_interval(hours=F.lit(hours)))
