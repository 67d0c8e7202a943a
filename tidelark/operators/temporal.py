"""Time-series joins and windows that no single task has to hold.

A window over all entities without partitions would move every row to one
task.  Here time is cut into buckets: ``neighbour`` fixes each bucket's first
or last row from a table with one row for each bucket, and ``nearby`` copies
the rows near a bucket's edges.  Interval joins turn into equi-joins on
buckets with the exact condition on top.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelark.operators.segments import SECOND, key_of, last, running


def micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def seconds_between(later: str | Column, earlier: str | Column) -> Column:
    return (micros(later) - micros(earlier)) / float(SECOND)


#: Buckets of ``neighbour`` that one row of its coarse table stands for.
COARSE = 1_000


def neighbour(df: DataFrame, columns: list[str], *, keys: tuple[str, ...] | list[str] = (), ahead: bool = False, bucket_s: int = 86_400, ts: str = "ts", tie: str = "event_id", prefix: str | None = None) -> DataFrame:
    """Adds the columns of the previous row in time (``ahead``: the next one) of all rows or of the same keys, prefixed ``prev_`` or ``next_``.

    Exact across empty buckets.  Bucket edges are carried over in two steps,
    inside stretches of COARSE buckets and from stretch to stretch; only the
    latter is one task's work for each key, with one row for 1,000 buckets of the time
    span, whatever the number of events.  The join back is on the window's own key.
    """
    prefix = prefix or ("next_" if ahead else "prev_")
    order = [F.col(ts), F.col(tie)]
    step, last = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
    given = df.withColumns({"_k": key_of(keys), "_b": F.floor(micros(ts) / (bucket_s * SECOND)), "_row": F.struct(*columns)})
    near = step("_row").over(W.partitionBy("_k", "_b").orderBy(*order))
    edges = given.groupBy("_k", "_b").agg(last("_row", F.struct(*order)).alias("_edge")).withColumn("_c", F.floor(F.col("_b") / COARSE))
    stretches = edges.groupBy("_k", "_c").agg(last("_edge", "_b").alias("_far"))
    stretches = stretches.select("_k", "_c", step("_far").over(W.partitionBy("_k").orderBy("_c")).alias("_far"))
    edges = edges.withColumn("_edge", step("_edge").over(W.partitionBy("_k", "_c").orderBy("_b"))).join(stretches.hint("merge"), ["_k", "_c"])
    joined = given.withColumn("_near", near).join(edges.select("_k", "_b", F.coalesce("_edge", "_far").alias("_edge")).hint("merge"), ["_k", "_b"], "left")
    row = F.coalesce("_near", "_edge")
    return joined.select(*df.columns, *[row[c].alias(f"{prefix}{c}") for c in columns])


#: Rows of a bucket of ``nearby`` that are aimed at, and the most buckets, whose edges are listed in the plan.
PER_BUCKET, MOST_BUCKETS = 20_000, 4_096


@dataclass(frozen=True)
class Counted:
    """An output of ``nearby``: the rows in the range (``when`` it holds) that also agree in ``keys``.

    It is the difference of two running counts, so its work grows with the rows and not with how many are in a range.
    ``before_s`` is a shorter reach than the other outputs have.
    """

    when: Column | None = None
    keys: tuple[str, ...] = ()
    before_s: float | None = None


def time_cuts(df: DataFrame, reach_s: float, *, ts: str = "ts", per_bucket: int = PER_BUCKET, apart: float = 0.25) -> list[int]:
    """Microseconds that cut the rows into buckets of about ``per_bucket`` rows: quantiles of a mergeable sketch of their times.

    Cuts are at least ``apart`` times ``reach_s`` apart, so that a row near them is copied to few buckets.
    """
    n = df.agg(F.count(ts)).first()[0]
    parts = min(MOST_BUCKETS, -(-n // per_bucket))
    if parts < 2:
        return []
    marks = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(micros(ts), marks, 100 * parts).alias("q")).first()["q"]
    cuts: list[int] = []
    for at in sorted(set(found)):
        if not cuts or at - cuts[-1] >= reach_s * SECOND * apart:
            cuts.append(at)
    return cuts


def _in_cuts(df: DataFrame, cuts: list[int], places: dict[str, Column]) -> DataFrame:
    """Adds for each time in microseconds the number of its bucket, a binary search inside the JVM."""
    names = list(places)
    df = df.withColumns({f"{n}_at": c.cast("double") for n, c in places.items()})
    if not cuts:
        return df.withColumns({n: F.when(F.col(f"{n}_at").isNotNull(), 0).cast("long") for n in names}).drop(*[f"{n}_at" for n in names])
    splits = [float("-inf"), *map(float, cuts), float("inf")]
    put = Bucketizer(splitsArray=[splits] * len(names), inputCols=[f"{n}_at" for n in names], outputCols=[f"{n}_in" for n in names], handleInvalid="keep")
    out = put.transform(df)
    return out.withColumns({n: F.when(F.col(f"{n}_at").isNotNull(), F.col(f"{n}_in").cast("long")) for n in names}).drop(*[f"{n}{e}" for n in names for e in ("_at", "_in")])


def nearby(df: DataFrame, before_s: float, after_s: float, outputs: dict, *, bucket_s: float | None = None, keys: tuple[str, ...] = (), ts: str = "ts", per_bucket: int = PER_BUCKET) -> DataFrame:
    """Adds aggregates over the rows from ``before_s`` earlier to ``after_s`` later.

    outputs maps a name to a function from the window to a column, or to (function, further keys of its window), or to ``Counted``.
    Rows are dealt once, by time bucket and ``keys``, whatever the further keys.  Rows near a
    bucket's edge are copied to the neighbour buckets, and the copies dropped
    after the window.  Without ``bucket_s`` the buckets follow the rows' density (``time_cuts``), so a busy hour
    is split; with it they all have that width.  Rows without a time are left out of every window and get nulls or zeros of their own.
    """
    low, high = int(before_s * SECOND), int(after_s * SECOND)
    given = df.withColumn("_t", micros(ts))
    if bucket_s is None:
        counts = all(isinstance(f, Counted) for f in outputs.values())  # their work doesn't grow with a bucket's width
        given = _in_cuts(given, time_cuts(df, max(before_s, after_s), ts=ts, per_bucket=per_bucket, apart=1.0 if counts else 0.25), {"_own": F.col("_t"), "_from": F.col("_t") - high, "_to": F.col("_t") + low})
    else:
        if max(before_s, after_s) > bucket_s:
            raise ValueError("the range is wider than a bucket")
        place = lambda t: F.floor(t / int(bucket_s * SECOND))
        given = given.withColumns({"_own": place(F.col("_t")), "_from": place(F.col("_t") - high), "_to": place(F.col("_t") + low)})
    dealt = given.withColumn("_b", F.explode(F.coalesce(F.sequence("_from", "_to"), F.array(F.lit(None).cast("long"))))).repartition("_b", *keys)
    spec = lambda more: W.partitionBy("_b", *keys, *more).orderBy("_t")

    def made(f) -> Column:
        if not isinstance(f, Counted):
            f, more = f if isinstance(f, tuple) else (f, ())
            return f(spec(more).rangeBetween(-low, high))
        n = F.count(F.lit(1) if f.when is None else F.when(f.when, 1))
        reach = low if f.before_s is None else min(low, int(f.before_s * SECOND))
        earlier = n.over(spec(f.keys).rangeBetween(W.unboundedPreceding, -reach - 1))
        return n.over(spec(f.keys).rangeBetween(W.unboundedPreceding, high)) - F.when(F.col("_t").isNotNull(), earlier).otherwise(0)

    out = dealt.select("*", *[made(f).alias(name) for name, f in outputs.items()])
    return out.where("_b <=> _own").select(*df.columns, *outputs)


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, low_s: float, high_s: float, how: str = "inner", extra=None) -> DataFrame:
    """left and right rows with equal keys and right_ts - left_ts in [low_s, high_s] seconds.

    The right side's columns other than the keys must not clash with the left's.
    ``how``: inner, left_semi or left_anti.  ``extra`` is a further condition.
    A left row is in one bucket and a right row is dealt to the two that it can
    reach, so repeated left rows stay, and a row without a time has no match.
    """
    width = max(high_s - low_s, 1.0) * SECOND
    low, high = low_s * SECOND, high_s * SECOND
    a = left.withColumn("_lt", micros(left_ts)).withColumn("_b", F.floor(F.col("_lt") / F.lit(width)))
    b = right.withColumn("_rt", micros(right_ts)).where("_rt is not null")
    b = b.withColumn("_rb", F.explode(F.sequence(F.floor((F.col("_rt") - F.lit(high)) / F.lit(width)), F.floor((F.col("_rt") - F.lit(low)) / F.lit(width)))))
    for k in keys:
        b = b.withColumnRenamed(k, f"_r_{k}")
    gap = F.col("_rt") - F.col("_lt")
    on = (F.col("_b") == F.col("_rb")) & (gap >= F.lit(low)) & (gap <= F.lit(high))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    if extra is not None:
        on = on & extra
    out = a.join(b.hint("merge"), on, how).drop("_lt", "_b")
    return out.drop("_rt", "_rb", *[f"_r_{k}" for k in keys]) if how == "inner" else out


def latest_before(left: DataFrame, right: DataFrame, key: str, value: str, ts: str = "ts", out: str = "latest", tie: str | None = None, bucket_s: int = 86_400) -> DataFrame:
    """As-of join: the last non-null ``value`` of right at or before each left row's time, by key.

    Both sides are dealt to time buckets; a bucket's last value is carried on, over empty
    buckets too, to the later ones, so a key with most rows is as many tasks as it has buckets.
    Of readings at one time the one with the greatest ``tie`` counts, the greatest value without that.
    """
    names = left.columns
    kind = right.schema[value].dataType
    tied = F.col(tie) if tie else F.col(value)
    tie_kind = right.schema[tie or value].dataType
    a = left.select(*names, F.lit(1).alias("_side"), F.lit(None).cast(tie_kind).alias("_tie"), F.lit(None).cast(kind).alias("_v"))
    blank = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names if c not in (key, ts)]
    b = right.where(F.col(value).isNotNull() & F.col(ts).isNotNull()).select(key, ts, *blank, F.lit(0).alias("_side"), tied.alias("_tie"), F.col(value).alias("_v")).select(*names, "_side", "_tie", "_v")
    order = [ts, "_side", "_tie"]
    found = running(a.unionByName(b), [key], order, {out: last(F.col("_v"), order)}, bucket_s=bucket_s)
    return found.where("_side = 1").drop("_side", "_tie", "_v")


def periods(df: DataFrame, opens: Column, closes: Column, *, keys: list[str], least_min: float, ts: str = "ts", tie: str = "event_id", bucket_s: int = 86_400) -> DataFrame:
    """Gaps and islands: keys, start_ts, end_ts, duration_min of each stretch from an opening row to the next closing one.

    Openings while open and closings while closed are ignored; stretches of
    ``least_min`` minutes or less, and one that never closes, are left out.
    What stood before a bucket, and the closing row after it, are carried from other buckets.
    """
    marked = df.where(opens | closes).select(*keys, ts, tie, opens.alias("_o"))
    how = {"keys": keys, "bucket_s": bucket_s, "ts": ts, "tie": tie}
    turns = neighbour(marked, ["_o"], **how).where("_o <> coalesce(prev__o, false)")
    stays = neighbour(turns, [ts], ahead=True, **how).where("_o").withColumnRenamed(f"next_{ts}", "_end")
    return stays.select(*keys, F.col(ts).alias("start_ts"), F.col("_end").alias("end_ts"), (seconds_between("_end", ts) / 60).alias("duration_min")).where(F.col("duration_min") > least_min)


def lagged(df: DataFrame, keys: list[str], column: str, steps: list[int], ts: str = "ts", tie: str = "event_id") -> DataFrame:
    w = W.partitionBy(*keys).orderBy(ts, tie)
    return df.select("*", *[F.lag(column, n).over(w).alias(f"{column}_lag_{n}") for n in steps])


def trailing_count(df: DataFrame, keys: list[str], span_s: int, out: str, when: Column | None = None, ts: str = "ts") -> DataFrame:
    """Rows of the same keys in the trailing span, the row itself included."""
    return nearby(df, span_s, 0, {out: Counted(when)}, keys=tuple(keys), ts=ts)
