"""Aggregations over events, occupancy, predictions and registries.  All combine before the shuffle."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelark.operators.series import between_rows, last_rows
from tidelark.operators.temporal import SECOND, micros
from tidelark.sources.tables import kept


def hour_of(ts: str = "ts") -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def days_before(as_of: Column, days: float) -> Column:
    return as_of - F.make_dt_interval(secs=F.lit(days * 86_400.0))


def within(df: DataFrame, as_of: Column, days: float, ts: str = "ts") -> DataFrame:
    return df.where((F.col(ts) > days_before(as_of, days)) & (F.col(ts) <= as_of))


def sensor_hourly(events: DataFrame, is_anomaly: Column) -> DataFrame:
    return events.groupBy(hour_of().alias("hour"), "entity_id", "room", "sensor_type").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("entities"), F.avg(is_anomaly.cast("double")).alias("anomaly_rate"))


def prediction_hourly(evaluated: DataFrame) -> DataFrame:
    known = evaluated.where("prediction_error is not null")
    return known.groupBy(hour_of().alias("hour"), "room", "horizon_minutes").agg(F.avg("probability").alias("avg_probability"), F.avg("uncertainty").alias("avg_uncertainty"), F.avg("prediction_error").alias("avg_error"), F.count("*").alias("n"))


def occupancy_hourly(occupancy: DataFrame) -> DataFrame:
    return occupancy.groupBy(hour_of().alias("hour"), "room").agg(F.avg(F.col("occupied").cast("double")).alias("rate"), F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"))


def occupancy_summary(occupancy: DataFrame, as_of: Column, days: float = 1) -> DataFrame:
    some = within(occupancy, as_of, days)
    return some.groupBy("room").agg(F.count("*").alias("n"), F.count_if("occupied").alias("n_occupied"), F.round(100.0 * F.count_if("occupied") / F.count("*"), 2).alias("percent"), F.max("ts").alias("last_seen"))


def summary(events: DataFrame, keys: list[str], **more: Column) -> DataFrame:
    """Row count and the given aggregates by key."""
    return events.groupBy(*keys).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in more.items()])


def data_quality(events: DataFrame) -> DataFrame:
    out = events.groupBy("room").agg(F.count("*").alias("n"), ((F.max(micros("ts")) - F.min(micros("ts"))) / SECOND).alias("span_s"), F.count_distinct(F.to_date("ts")).alias("days"))
    return out.withColumn("completeness", F.least(F.lit(100.0), F.col("n") / 1e6 * 100))


def table_stats(tables: dict[str, DataFrame], ts: str = "ts") -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")).select(F.lit(name).alias("table_name"), "n", "first", "last")
        out = row if out is None else out.unionByName(row)
    return out


def window_statistics(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("n"), ((F.max(micros("ts")) - F.min(micros("ts"))) / SECOND).alias("span_s"), F.count_distinct("room").alias("rooms"), F.count_distinct("entity_id").alias("entities"))


def room_performance(results: DataFrame, as_of: Column) -> DataFrame:
    """Mean and population std of the newest 100 accuracies of 7 days, mean of the newest 100 response times of a day."""
    order = ["ts", "event_id"]
    acc = last_rows(within(results, as_of, 7), ["room"], order, 100).groupBy("room").agg(F.avg("accuracy_score").alias("mean_accuracy"), F.stddev_pop("accuracy_score").alias("std_accuracy"))
    time = last_rows(within(results, as_of, 1), ["room"], order, 100).groupBy("room").agg(F.avg("prediction_time_ms").alias("mean_response_ms"))
    return acc.join(time, "room", "left")


def importance(rows: DataFrame, least: float = 0.1, more_than: int = 10) -> DataFrame:
    """Running means of contributions |value| * (1 - min(1, |error|)) by feature, with a status."""
    contribution = F.abs("value") * (1 - F.least(F.lit(1.0), F.abs("error")))
    out = rows.groupBy("feature").agg(F.avg(contribution).alias("importance"), F.count("*").alias("n"))
    return out.withColumn("status", F.when((F.col("n") > more_than) & (F.col("importance") < least), "pruned").when(F.col("n") > more_than, "kept").otherwise("learning"))


def confusion(preds: DataFrame, keys: list[str], p: str = "probability", y: str = "actual_outcome", cut: float = 0.5, **more: Column) -> DataFrame:
    """Accuracy, false rates, precision, recall and F1 of evaluated rows; a ratio without a denominator is null.  ``more`` are further aggregates of theirs."""
    said, was = F.col(p) > cut, F.col(y)
    tp, fp, fn, n = F.count_if(said & was), F.count_if(said & ~was), F.count_if(~said & was), F.count("*")
    out = preds.where(was.isNotNull()).groupBy(*keys).agg(n.alias("n"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), *[a.alias(name) for name, a in more.items()])
    ratio = lambda a, b: F.when(b > 0, a / b)
    c = F.col
    return out.select(*keys, "n", ((c("n") - c("fp") - c("fn")) / c("n")).alias("accuracy"), (c("fp") / c("n")).alias("fp_rate"), (c("fn") / c("n")).alias("fn_rate"), ratio(c("tp"), c("tp") + c("fp")).alias("precision"), ratio(c("tp"), c("tp") + c("fn")).alias("recall"), ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"), *more)


def performance_summary(records: DataFrame, as_of: Column, days: float = 1) -> DataFrame:
    """Totals (room null) and a row for each room, in one rollup."""
    some = within(records, as_of, days)
    return some.rollup("room").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count_if("drift").alias("drifts"))


def recent_summary(df: DataFrame, keys: list[str], order: list[str], value: str, n: int = 100, newest: int = 10) -> DataFrame:
    out = last_rows(df, keys, order, n)
    return out.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("n"), between_rows(value, 1, newest).alias("newest_mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def value_trend(df: DataFrame, keys: list[str], order: list[str], value: str, n: int = 5) -> DataFrame:
    """Current value, last-n mean minus first-n mean (0 with under 2n rows), and population std."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys)
    rows = df.withColumn("_up", F.row_number().over(w.orderBy(*order))).withColumn("_down", F.row_number().over(w.orderBy(*[F.desc(c) for c in order])))
    change = F.avg(F.when(F.col("_down") <= n, F.col(value))) - F.avg(F.when(F.col("_up") <= n, F.col(value)))
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("current"), F.when(F.count("*") >= 2 * n, change).otherwise(0.0).alias("trend"), F.stddev_pop(value).alias("std"))


def correlation(df: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """Pearson's r, 0 where either side doesn't vary."""
    r = F.when((F.var_pop(x) > 0) & (F.var_pop(y) > 0), F.corr(x, y))
    return df.groupBy(*keys).agg(F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0)).alias("r"), F.count("*").alias("n"))


def search_statistics(runs: DataFrame, as_of: Column) -> DataFrame:
    """Success rate, mean improvement and runs of the last day, by strategy and in total (strategy null)."""
    good = (F.col("improvement") > 0).cast("double")
    return runs.rollup("strategy").agg(F.count("*").alias("n"), F.avg(good).alias("success_rate"), F.avg("improvement").alias("mean_improvement"), F.count_if(F.col("ts") > days_before(as_of, 1)).alias("last_day"))


def hourly_activity_prior(occupancy: DataFrame, active: Column | None = None) -> DataFrame:
    rate = F.avg(F.col("occupied").cast("double"))
    return occupancy.groupBy("room", F.hour("ts").alias("hour")).agg(rate.alias("rate"), F.count("*").alias("n"))


def pattern_prediction(asked: DataFrame, prior: DataFrame, default: float = 0.3) -> DataFrame:
    """asked(room, hour, active): the hourly rate, times 1.2 while active, at most 0.8; ``default`` where unknown."""
    joined = asked.join(prior.select("room", "hour", "rate"), ["room", "hour"], "left")
    p = F.coalesce("rate", F.lit(default)) * F.when(F.col("active"), 1.2).otherwise(1.0)
    return joined.select(*asked.columns, F.least(F.lit(0.8), p).alias("probability"))


def partial_hourly(events: DataFrame) -> DataFrame:
    """Hourly sums that can be merged: n, and the number and sum of values."""
    return events.groupBy(hour_of().alias("hour"), "room", "sensor_type").agg(F.count("*").alias("n"), F.count("numeric_value").alias("n_value"), F.sum("numeric_value").alias("sum_value"))


def _overwrite_days(partial: DataFrame, path: str) -> None:
    partial.withColumn("day", F.to_date("hour")).repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def refresh_rollup(events: DataFrame, path: str, now: datetime, *, lag: timedelta = timedelta(hours=1), lookback: timedelta | None = timedelta(days=1)) -> None:
    """Recomputes the hours from the day of ``now - lookback`` (None: all) up to the last whole hour before ``now - lag``, and overwrites the partitions of those days only."""
    end = (now - lag).replace(minute=0, second=0, microsecond=0)
    rows = events.where(F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    if lookback is not None:
        rows = rows.where(F.col("ts") >= F.lit((now - lookback).replace(hour=0, minute=0, second=0, microsecond=0)).cast("timestamp_ntz"))
    _overwrite_days(partial_hourly(rows), path)


def merge_late(late: DataFrame, path: str) -> None:
    """Adds rows that came after their days were last recomputed: their sums are merged with those of their days' partitions."""
    spark = late.sparkSession
    new = kept(partial_hourly(late))
    days = [r.day for r in new.select(F.to_date("hour").alias("day")).distinct().collect()]  # as many as there are dates
    if not days:
        return
    old = spark.read.parquet(path).where(F.col("day").isin(days)).drop("day")
    sums = old.unionByName(new).groupBy("hour", "room", "sensor_type").agg(F.sum("n").alias("n"), F.sum("n_value").alias("n_value"), F.sum("sum_value").alias("sum_value"))
    _overwrite_days(kept(sums), path)


def rollup_view(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("hour", "room", "sensor_type", "n", (F.col("sum_value") / F.when(F.col("n_value") > 0, F.col("n_value"))).alias("mean_value"))
