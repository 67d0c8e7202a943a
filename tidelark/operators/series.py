"""Rolling metrics, trends and horizon curves over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelark.operators.segments import count, row_frame, running, total


def _ordered(keys, order):
    return W.partitionBy(*keys).orderBy(*order)


def rolling(df: DataFrame, keys: list[str], order: list[str], rows: int, outputs: dict[str, Column]) -> DataFrame:
    """Adds aggregates over the last ``rows`` rows of the key, the row included."""
    return row_frame(df, keys, order, rows - 1, 0, outputs)


def last_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The newest n rows of each key, with ``rn`` (1 is the newest)."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def between_rows(value: str, low: int, high: int) -> Column:
    """Mean of the newest rows number low..high, in a groupBy over last_rows()."""
    return F.avg(F.when(F.col("rn").between(low, high), F.col(value)))


def trend(df: DataFrame, keys: list[str], order: list[str], value: str, n: int = 10) -> DataFrame:
    """Mean of the newest n minus that of the n before, or of all earlier ones where fewer; 0 with under n rows."""
    newest = last_rows(df, keys, order, 2 * n)
    out = newest.groupBy(*keys).agg(F.count("*").alias("_n"), between_rows(value, 1, n).alias("_a"), between_rows(value, n + 1, 2 * n).alias("_b"))
    return out.select(*keys, F.when((F.col("_n") < n) | F.col("_b").isNull(), 0.0).otherwise(F.col("_a") - F.col("_b")).alias("trend"))


def needs_optimization(df: DataFrame, keys, order, value) -> DataFrame:
    newest = last_rows(df, keys, order, 11)
    out = newest.groupBy(*keys).agg(F.count("*").alias("_n"), between_rows(value, 1, 5).alias("recent"), between_rows(value, 6, 10).alias("older"), between_rows(value, 1, 10).alias("mean"))
    worse = (F.col("_n") > 10) & (F.col("recent") < F.col("older") - 0.02)
    return out.select(*keys, "recent", "older", (worse | (F.col("mean") < 0.75)).alias("optimize"))


def relevance_degraded(df: DataFrame, keys, order, value, n: int = 10, share: float = 0.1) -> DataFrame:
    newest = last_rows(df, keys, order, 2 * n)
    out = newest.groupBy(*keys).agg(F.count("*").alias("_n"), between_rows(value, 1, n).alias("_a"), between_rows(value, n + 1, 2 * n).alias("_b"))
    loss = (F.col("_b") - F.col("_a")) / F.col("_b")
    return out.where((F.col("_n") >= 2 * n) & (F.col("_b") != 0)).select(*keys, loss.alias("degradation"), (loss > share).alias("degraded"))


def stagnant(df: DataFrame, keys, order, value, n: int = 10, least_std: float = 0.01) -> DataFrame:
    out = last_rows(df, keys, order, n).groupBy(*keys).agg(F.count("*").alias("_n"), F.stddev_pop(value).alias("std"))
    return out.select(*keys, "std", ((F.col("_n") >= n) & (F.col("std") < least_std)).alias("stagnant"))


def recently_bad(df: DataFrame, keys, order, value, n: int = 5, least: float = 0.6) -> DataFrame:
    out = last_rows(df, keys, order, n).groupBy(*keys).agg(F.avg(value).alias("recent"))
    return out.withColumn("degraded", F.col("recent") < least)


def z_outliers(df: DataFrame, keys, order, value, rows: int = 10, most: float = 2.0, least_rows: int = 3) -> DataFrame:
    """Adds z against the last ``rows`` rows, and outlier: beyond ``most``, or of a key's first ``least_rows`` - 1 values."""
    if least_rows > rows:
        raise ValueError("least_rows is counted inside the frame")
    near = rolling(df, keys, order, rows, {"_m": F.avg(value), "_s": F.stddev_pop(value), "_c": F.count(value)})
    z = F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return near.withColumn("z", z).withColumn("outlier", (F.col("_c") < least_rows) | (F.abs("z") > most)).drop("_m", "_s", "_c")


def prior_deviation(df: DataFrame, keys, order, value, std: float = 1.0, most: float = 2.0, least_rows: int = 10) -> DataFrame:
    past = running(df, keys, order, {"_s": total(value), "_c": count(F.col(value))}, upto=-1)
    mean = F.col("_s") / F.when(F.col("_c") > 0, F.col("_c"))
    return past.withColumn("prior_mean", mean).withColumn("anomalous", (F.col("_c") >= least_rows) & (F.abs(F.col(value) - F.col("prior_mean")) / std > most)).drop("_s", "_c")


def ewma(df: DataFrame, keys: list[str], order: list[str], x: Column, alpha: float = 0.1, start: float = 0.5) -> DataFrame:
    """p = (1 - alpha) p + alpha x over all rows of the key, in closed form from row numbers.

    Weights that no longer matter in a double (older than the exponent allows) are 0.
    """
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    aged = df.select(*keys, x.cast("double").alias("_x"), (F.row_number().over(w) - 1).alias("_age"))
    keep = F.lit(1 - alpha)
    return aged.groupBy(*keys).agg(F.count("*").alias("n"), (F.sum(alpha * F.pow(keep, F.col("_age")) * F.col("_x")) + start * F.pow(keep, F.count("*"))).alias("ewma"))


# Accuracy by horizon: frames of (key, horizon, accuracy)


def local_maxima(curve: DataFrame, keys: list[str], h: str = "horizon", acc: str = "accuracy", least: float = 0.6) -> DataFrame:
    w = _ordered(keys, [h])
    return curve.withColumn("_a", F.lag(acc).over(w)).withColumn("_b", F.lead(acc).over(w)).where((F.col(acc) > F.col("_a")) & (F.col(acc) > F.col("_b")) & (F.col(acc) > least)).drop("_a", "_b")


def gradient_breaks(curve: DataFrame, keys: list[str], h: str = "horizon", acc: str = "accuracy", least_change: float = 0.1, least: float = 0.5) -> DataFrame:
    """Horizons after which the slope changes by more than ``least_change``."""
    w = _ordered(keys, [h])
    before, after = F.col(acc) - F.lag(acc).over(w), F.lead(acc).over(w) - F.col(acc)
    marked = curve.withColumn("_d", F.abs(after - before)).withColumn("break_horizon", F.lead(h).over(w)).withColumn("_acc", F.lead(acc).over(w))
    return marked.where((F.col("_d") > least_change) & (F.col("_acc") > least)).select(*keys, F.col("break_horizon").alias(h), F.col("_acc").alias(acc))


def interpolated(known: DataFrame, keys: list[str], h: str = "horizon", acc: str = "accuracy", top: int = 239, near: int = 30) -> DataFrame:
    """A curve over 1..top: own value, else the mean of known ones within ``near``, else the nearest, decayed by distance."""
    all_h = known.select(*keys).distinct().withColumn("_h", F.explode(F.sequence(F.lit(1), F.lit(top))))
    pairs = all_h.join(known.hint("merge"), keys)
    d = F.abs(F.col(h) - F.col("_h"))
    out = pairs.groupBy(*keys, "_h").agg(
        F.max(F.when(d == 0, F.col(acc))).alias("_own"),
        F.avg(F.when(d <= near, F.col(acc))).alias("_mean"),
        F.min_by(F.col(acc) * F.greatest(F.lit(0.1), 1 - 0.2 * d / 60), F.struct(d, F.col(h))).alias("_far"),
    )
    return out.select(*keys, F.col("_h").alias(h), F.coalesce("_own", "_mean", "_far", F.lit(0.5)).alias(acc))


def breakpoints(curve: DataFrame, keys: list[str], h: str = "horizon", acc: str = "accuracy", most: int = 3) -> DataFrame:
    """Chosen horizons of each key: local maxima, or slope breaks where under two, filled up by the defaults, at most three."""
    w = _ordered(keys, [h])
    here, back, back2, ahead = F.col(acc), F.lag(acc).over(w), F.lag(acc, 2).over(w), F.lead(acc).over(w)
    peak = F.coalesce((here > back) & (here > ahead) & (here > 0.6), F.lit(False))
    bend = F.coalesce((F.abs((here - back) - (back - back2)) > 0.1) & (here > 0.5), F.lit(False))
    point = F.struct(F.col(acc).alias("acc"), F.col(h).alias("h"))
    marked = curve.select(*keys, point.alias("_x"), peak.alias("_peak"), bend.alias("_bend"))
    take = lambda c: F.collect_list(F.when(c, F.col("_x")))
    got = marked.groupBy(*keys).agg(take(F.col("_peak")).alias("_p"), take(F.col("_bend")).alias("_b"), take(F.col("_x.h").isin(15, 120)).alias("_d"))
    got = got.withColumn("_c", F.when(F.size("_p") >= 2, F.col("_p")).otherwise(F.col("_b")))
    only = F.get("_c", F.lit(0))["h"]
    wanted = F.when(F.size("_c") == 0, F.array(F.lit(15), F.lit(120))).when(F.size("_c") == 1, F.array(F.when(only < 60, 120).otherwise(15))).otherwise(F.array().cast("array<int>"))
    default = F.transform(wanted, lambda x: F.struct(F.get(F.filter("_d", lambda d: d["h"] == x), F.lit(0))["acc"].alias("acc"), x.alias("h")))
    every = F.filter(F.concat(F.transform("_c", lambda x: F.struct(x["acc"].alias("acc"), x["h"].cast("int").alias("h"))), default), lambda x: x["h"].between(5, 240))
    best = F.array_sort(F.transform(F.array_distinct(every), lambda x: F.struct((-F.coalesce(x["acc"], F.lit(-1.0))).alias("a"), x["h"].alias("h"))))
    return got.select(*keys, F.explode(F.slice(best, 1, most)).alias("_x")).select(*keys, F.col("_x.h").alias(h))


def stable_horizons(curve: DataFrame, keys: list[str], h: str = "horizon", acc: str = "accuracy", width: int = 10, step: int = 5, most: int = 3) -> DataFrame:
    """Middles of the first windows (by position) with little variance and a high mean."""
    w = _ordered(keys, [h])
    ranked = curve.withColumn("_i", F.row_number().over(w) - 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - (width - 1)) / step)).cast("int")
    dealt = ranked.withColumn("_w", F.explode(F.sequence(first, F.floor(F.col("_i") / step).cast("int"))))
    out = dealt.groupBy(*keys, "_w").agg(F.count("*").alias("_n"), F.var_pop(acc).alias("_v"), F.avg(acc).alias("_m"), F.max(F.when(F.col("_i") == F.col("_w") * step + width // 2, F.col(h))).alias(h))
    good = out.where((F.col("_n") == width) & (F.col("_v") < 0.01) & (F.col("_m") > 0.6))
    return good.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("_w"))).where(F.col("_r") <= most).select(*keys, h)


def merged_votes(votes: DataFrame, keys: list[str], h: str = "horizon") -> DataFrame:
    """Horizons by votes: those with two or more, or the first two, at most three; 15 or 120 is added where that side is bare."""
    n = votes.groupBy(*keys, h).agg(F.count("*").alias("votes"))
    ranked = n.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("votes"), h)))
    kept = ranked.where(((F.col("votes") >= 2) | (F.col("_r") <= 2)) & (F.col("_r") <= 3)).groupBy(*keys).agg(F.collect_list(F.col(h).cast("int")).alias("_h"))
    add = F.array_compact(F.array(F.when(F.array_min("_h") > 30, 15), F.when(F.array_max("_h") < 90, 120)))
    return kept.select(*keys, F.explode(F.array_union("_h", add)).alias(h))
