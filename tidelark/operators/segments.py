"""Scans over each key's ordered rows that aren't one task's work for each key.

A key's rows are cut into time buckets.  A bucket is summed up by a mergeable
state (a sum, a count, an extreme, the last value); a second pass over one row for
each bucket carries the states of earlier buckets in; the answer inside a bucket
combines what was carried with a window over the bucket.  So there are as many tasks as
there are (key, bucket), and what one task sees of a whole key is a row for each bucket.

Frames of rows (the last n, the next n) need rows of other buckets.  They go by
row number, which is such a scan: numbers are cut into chunks of equal size, and
only the rows near a chunk's edge are copied to its neighbour.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SECOND = 1_000_000
DAY = 86_400
#: Rows of a chunk of numbered rows, where the frame isn't larger.
CHUNK = 4_096


def key_of(keys) -> Column:
    """One column for any keys; nulls are equal to nulls."""
    return F.struct(*keys) if len(keys) else F.struct(F.lit(0).alias("_0"))


def bucket_of(ts: str | Column, bucket_s: float) -> Column:
    at = F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))
    return F.floor(at / int(bucket_s * SECOND))


@dataclass
class Scan:
    """A running aggregate: of a bucket, of buckets' states, inside a bucket, and of what was carried with what is inside."""

    partial: Column
    merge: Callable[[str], Column]
    inside: Column
    combine: Callable[[Column, Column], Column]


def total(x: Column | str) -> Scan:
    return Scan(F.sum(x), F.sum, F.sum(x), lambda a, b: F.coalesce(a + b, a, b))


def count(x: Column | None = None) -> Scan:
    n = F.count(F.lit(1) if x is None else x)
    return Scan(n, F.sum, n, lambda a, b: F.coalesce(a, F.lit(0)) + b)


def least(x: Column | str) -> Scan:
    return Scan(F.min(x), F.min, F.min(x), F.least)


def greatest(x: Column | str) -> Scan:
    return Scan(F.max(x), F.max, F.max(x), F.greatest)


def first(x: Column | str, order: list[str]) -> Scan:
    """The key's first value, null or not."""
    held = F.struct((F.col(x) if isinstance(x, str) else x).alias("v"))
    return Scan(F.min_by(held, F.struct(*order)), F.first, F.first(held), lambda a, b: F.coalesce(a, b)["v"])


def last(x: Column, order: list[str]) -> Scan:
    """The last value that isn't null."""
    of = F.max_by(x, F.when(x.isNotNull(), F.struct(*order)))
    return Scan(of, lambda c: F.last(c, ignorenulls=True), F.last(x, ignorenulls=True), lambda a, b: F.coalesce(b, a))


def running(df: DataFrame, keys: list[str], order: list[str], outputs: dict[str, Scan], *, bucket_s: float = DAY, upto: int = 0) -> DataFrame:
    """Adds each scan over the key's rows from the first one to the row itself (``upto`` -1: to the one before).

    order[0] is the time that buckets are cut by (a number counts as seconds); the rest breaks ties.  Equal to the
    plain window over the key, but for the order in which floats are summed.  Rows without a time are a bucket of
    their own, before all others.
    """
    rows = df.withColumns({"_sk": key_of(keys), "_sb": F.coalesce(bucket_of(order[0], bucket_s), F.lit(-(2**62)))})
    states = rows.groupBy("_sk", "_sb").agg(*[s.partial.alias(f"_sp{i}") for i, s in enumerate(outputs.values())])
    earlier = W.partitionBy("_sk").orderBy("_sb").rowsBetween(W.unboundedPreceding, -1)
    carried = states.select("_sk", "_sb", *[s.merge(f"_sp{i}").over(earlier).alias(f"_sc{i}") for i, s in enumerate(outputs.values())])
    here = W.partitionBy("_sk", "_sb").orderBy(*order).rowsBetween(W.unboundedPreceding, upto)
    inside = rows.select("*", *[s.inside.over(here).alias(f"_si{i}") for i, s in enumerate(outputs.values())])
    joined = inside.join(carried.hint("merge"), ["_sk", "_sb"])
    return joined.select(*df.columns, *[s.combine(F.col(f"_sc{i}"), F.col(f"_si{i}")).alias(name) for i, (name, s) in enumerate(outputs.items())])


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str = "_n", *, bucket_s: float = DAY) -> DataFrame:
    """Adds the row number of each row in its key, from 1."""
    return running(df, keys, order, {out: count()}, bucket_s=bucket_s)


def row_frame(df: DataFrame, keys: list[str], order: list[str], before: int, after: int, outputs: dict[str, Column | tuple[Column, int, int]], *, chunk: int = CHUNK, bucket_s: float = DAY) -> DataFrame:
    """Adds aggregates over the rows from ``before`` rows earlier to ``after`` rows later, equal to the plain window over the key.

    An output may name its own frame inside that one: (aggregate, first row, last row), relative to the row.
    """
    size = max(chunk, before, after)
    place = lambda shift: F.floor((F.col("_rf_n") + F.lit(shift - 1)) / size)
    rows = numbered(df, keys, order, "_rf_n", bucket_s=bucket_s).withColumn("_rf_own", place(0))
    dealt = rows.withColumn("_rf_c", F.explode(F.sequence(place(-after), place(before))))
    w = W.partitionBy(key_of(keys), "_rf_c").orderBy("_rf_n")
    framed = {name: c if isinstance(c, tuple) else (c, -before, after) for name, c in outputs.items()}
    return dealt.select("*", *[c.over(w.rowsBetween(low, high)).alias(name) for name, (c, low, high) in framed.items()]).where("_rf_c = _rf_own").select(*df.columns, *outputs)
