"""Drift detection: sums and windows where the rule allows it, folds where it starts anew after an alarm.

The folds keep a small state for a key and take rows in order, so the batch
form (``folded``, many buckets of a key at once) and the streaming form share them.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import accumulate
from math import sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelark.operators.folds import in_order
from tidelark.operators.segments import DAY, count, first, greatest, least, numbered, row_frame, running, total
from tidelark.sources.tables import kept


@dataclass
class PageHinkley:
    """Sums of x - delta and x + delta against their running extremes; the first value of all is skipped."""

    delta: float = 0.05
    limit: float = 50.0
    seen: bool = False
    up: float = 0.0
    down: float = 0.0
    low: float = 0.0
    high: float = 0.0

    def add(self, x: float) -> bool:
        if not self.seen:
            self.seen = True
            return False
        self.up += x - self.delta
        self.down += x + self.delta
        self.low, self.high = min(self.low, self.up), max(self.high, self.down)
        alarm = self.up - self.low > self.limit or self.high - self.down > self.limit
        if alarm:
            self.up = self.down = self.low = self.high = 0.0
        return alarm


@dataclass
class KolmogorovSmirnov:
    """A sliding window against a reference of equal size; after an alarm the window becomes the reference.

    A row adds one value to the window and takes one out, so the statistic moves by at most one of ``size`` parts: it is
    worked out again only when it can have reached the limit.
    """

    size: int = 100
    reference: list[float] = field(default_factory=list)
    current: list[float] = field(default_factory=list)
    places: list[int] = field(default_factory=list)  # how many of the current values stand before each place of the reference, and not before an earlier one
    wait: int = 0  # full windows until the statistic is looked at again

    def add(self, x: float) -> bool:
        if len(self.reference) < self.size:
            insort(self.reference, x)
            self.places = [0] * (self.size + 1)
            return False
        self.current.append(x)
        self.places[bisect_left(self.reference, x)] += 1
        if len(self.current) > self.size:
            self.places[bisect_left(self.reference, self.current.pop(0))] -= 1
        if len(self.current) < self.size:
            return False
        if self.wait > 1:
            self.wait -= 1
            return False
        limit = 1.36 * sqrt(2 / self.size)
        statistic = max(abs((i + 1) / self.size - n / self.size) for i, n in enumerate(accumulate(self.places[: self.size])))
        if statistic > limit:
            self.reference, self.current, self.places, self.wait = sorted(self.current), [], [0] * (self.size + 1), 0
            return True
        self.wait = int((limit - statistic) * self.size)
        return False


@dataclass
class Cooldown:
    """Lets a row pass if none passed less than ``gap_s`` before."""

    gap_s: float = 1800.0
    last: float | None = None

    def add(self, at: float) -> bool:
        if self.last is not None and at - self.last < self.gap_s:
            return False
        self.last = at
        return True


def folded(df: DataFrame, keys: list[str], order: list[str], value: str, make: Callable, out: str = "alarm", **how) -> DataFrame:
    """Feeds each key's rows in order to make().add and adds its answer.

    A key's chunks of rows are folded at once (``folds.in_order``, which takes ``how``), so one key isn't one task's work.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {out} boolean"

    def feed(state, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(**{out: [state.add(float(x)) for x in rows[value]]})

    return in_order(df, keys, order, make, feed, schema, **how)


def page_hinkley_first(df: DataFrame, keys: list[str], order: list[str], value: str, delta: float = 0.05, limit: float = 50.0, bucket_s: float = DAY) -> DataFrame:
    """Order columns of each key's first alarm.

    Up to the first alarm, the statistics are a max-plus map of what came before: a bucket is summed up by its
    sum and its least and greatest running sum, and what earlier buckets add up to is carried in.
    """
    sums = {"_p": total(F.col(value) - delta), "_q": total(F.col(value) + delta)}
    rows = kept(numbered(df, keys, order, bucket_s=bucket_s).where("_n > 1"))
    rows = kept(running(rows, keys, order, sums, bucket_s=bucket_s))
    rows = running(rows, keys, order, {"_mn": least("_p"), "_mx": greatest("_q")}, bucket_s=bucket_s)
    alarms = rows.where((F.col("_p") - F.least(F.lit(0.0), "_mn") > limit) | (F.greatest(F.lit(0.0), "_mx") - F.col("_q") > limit))
    return alarms.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_f")).select(*keys, "_f.*")


def adwin(df: DataFrame, keys: list[str], order: list[str], value: str, half: int = 25, most: int = 1000, spread: float = 3.0, bucket_s: float = DAY) -> DataFrame:
    """Adds buffer, its length, and drift: the two newest stretches of ``half`` rows differ by more than spread * std of the buffer.

    The buffer holds all rows up to ``most``; one more drops its older half, so
    its length is a function of the row number and its variance a difference of prefix sums,
    of values less the key's first one, so that large values don't cancel.
    """
    keep = most + 1 - (most + 1) // 2
    rows = running(df, keys, order, {"_n": count(), "_f": first(value, order)}, bucket_s=bucket_s).withColumn("_x", F.col(value) - F.col("_f"))
    rows = kept(running(rows, keys, order, {"_s": total("_x"), "_q": total(F.pow("_x", F.lit(2)))}, bucket_s=bucket_s))
    before = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col("_n") + 1).alias("_at"), F.col("_s").alias("_s0"), F.col("_q").alias("_q0"))
    rows = row_frame(rows, keys, order, 2 * half - 1, 0, {"_a": (F.avg(value), 1 - half, 0), "_b": (F.avg(value), 1 - 2 * half, -half)}, bucket_s=bucket_s)
    rows = rows.withColumn("buffer", F.when(F.col("_n") <= most, F.col("_n")).otherwise(keep + (F.col("_n") - most - 1) % (most + 1 - keep)))
    on = F.col("_n") - F.col("buffer") + 1 == F.col("_at")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = rows.join(before.hint("merge"), on, "left").na.fill(0.0, ["_s0", "_q0"])
    mean = (F.col("_s") - F.col("_s0")) / F.col("buffer")
    var = F.greatest(F.lit(0.0), (F.col("_q") - F.col("_q0")) / F.col("buffer") - mean * mean)
    drift = (F.col("buffer") >= 2 * half) & (F.abs(F.col("_a") - F.col("_b")) > spread * F.sqrt(var))
    return joined.select(*df.columns, F.col("buffer").cast("long").alias("buffer"), F.coalesce(drift, F.lit(False)).alias("drift"))


def ks_blocks(df: DataFrame, keys: list[str], order: list[str], value: str, size: int = 100) -> DataFrame:
    """D between each full block of ``size`` rows and the block before it, evaluated at the earlier block's points."""
    rows = numbered(df, keys, order).withColumn("block", F.floor((F.col("_n") - 1) / size))
    full = rows.groupBy(*keys, "block").agg(F.count("*").alias("_n"), F.sort_array(F.collect_list(value)).alias("_v")).where(F.col("_n") == size)
    nxt = full.select(*keys, (F.col("block") - 1).alias("block"), F.col("_v").alias("_c"))
    pairs = full.join(nxt.hint("merge"), [*keys, "block"])
    d = F.array_max(F.transform("_v", lambda x, i: F.abs((i + 1) / size - F.size(F.filter("_c", lambda y: y <= x)) / size)))
    limit = 1.36 * (2 / size) ** 0.5
    return pairs.select(*keys, (F.col("block") + 1).alias("block"), d.alias("statistic"), (1 - d).alias("one_minus_d"), (d > limit).alias("drift"))


def combined(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds page_hinkley, adwin, ks, drift (any of them) and the running count of drifts."""
    out = folded(df, keys, order, value, PageHinkley, "page_hinkley")
    out = kept(folded(out, keys, order, value, KolmogorovSmirnov, "ks"))
    out = adwin(out, keys, order, value).withColumnRenamed("drift", "adwin").drop("buffer")
    out = kept(out.withColumn("drift", F.col("page_hinkley") | F.col("ks") | F.col("adwin")))
    return running(out, keys, order, {"drift_count": total(F.col("drift").cast("int"))})


def system_alerts(alerts: DataFrame, room: str = "room", hour_s: int = 3600, more_than: int = 3, **how) -> DataFrame:
    """Alerts with more than ``more_than`` in the trailing hour, with the distinct rooms among them."""
    from tidelark.operators.temporal import nearby

    found = nearby(alerts, hour_s, 0, {"n_alerts": lambda w: F.count(F.lit(1)).over(w), "_rooms": lambda w: F.collect_set(room).over(w)}, **how)
    return found.where(F.col("n_alerts") > more_than).withColumn("rooms", F.sort_array("_rooms")).drop("_rooms")
