"""Sequences of sensor events: contiguous runs, n-grams, their significance and their absence."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidelark.operators.segments import CHUNK, key_of, numbered, row_frame
from tidelark.operators.temporal import SECOND, micros
from tidelark.sources.tables import kept

#: Minutes of time windows that are not whole hours, besides the first sixty.
BROKEN_HOURS = (90, 105, 135, 150, 165, 270, 330, 450, 510)
#: Minutes of the time windows: whole minutes of an hour, whole hours of a day, whole days of a month, and the broken hours.
WINDOWS = sorted({*range(1, 61), *(60 * h for h in range(1, 25)), *(1440 * d for d in range(1, 30)), *BROKEN_HOURS})

#: Kinds of tokens up to which their table of numbers is broadcast.
SMALL = 100_000


def token(*columns: str) -> Column:
    return F.concat_ws("-", *columns)


def sequences(events: DataFrame, item: Column, longest: int = 5, shortest: int = 2, keys: tuple[str, ...] = ("room",)) -> DataFrame:
    """Each contiguous sequence of shortest..longest events of a key: signature, n, start_ts, span_s."""
    steps = events.select(*keys, "ts", "event_id", F.struct(micros("ts").alias("t"), item.alias("x")).alias("_x"))
    rows = row_frame(steps, list(keys), ["ts", "event_id"], 0, longest - 1, {"_s": F.collect_list("_x")})
    rows = rows.where(F.size("_s") >= shortest).withColumn("n", F.explode(F.sequence(F.lit(shortest), F.size("_s"))))
    part = F.slice("_s", 1, F.col("n"))
    span = (F.element_at(part, -1)["t"] - F.element_at(part, 1)["t"]) / SECOND
    return rows.select(*keys, F.col("ts").alias("start_ts"), "event_id", "n", F.array_join(F.transform(part, lambda s: s["x"]), "->").alias("signature"), span.alias("span_s"))


def smallest_window(span_s: Column) -> Column:
    """Minutes of the least window that a span fits in; null for longer ones."""
    m = F.greatest(F.lit(1), F.ceil(span_s / 60).cast("int"))
    up = lambda step: F.ceil(m / step).cast("int") * step
    broken = F.coalesce(*[F.when(m <= x, x) for x in BROKEN_HOURS])
    return F.when(m <= 60, m).when(m <= 1440, F.least(up(60), broken)).when(m <= 29 * 1440, up(1440))


def windowed_counts(found: DataFrame, keys: tuple[str, ...] = ("room",)) -> DataFrame:
    """For each signature and window in which new occurrences fit, how many fit in that window or a shorter one."""
    counts = found.withColumn("window_min", smallest_window(F.col("span_s"))).where("window_min is not null").groupBy(*keys, "signature", "window_min").agg(F.count("*").alias("n"))
    w = W.partitionBy(*keys, "signature").orderBy("window_min").rowsBetween(W.unboundedPreceding, 0)
    return counts.select(*keys, "signature", "window_min", F.sum("n").over(w).alias("n"))


def uniform_chi_square(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Chi-square of the counts of a key against equal ones, p = 1 / (1 + chi2), 0 with under two counts.

    significant_ref keeps p > 0.05, the least surprising ones; it is kept as a column under that name.
    """
    s = counts.groupBy(*keys).agg(F.count("*").alias("kinds"), F.sum(n).alias("total"), F.sum(F.pow(n, 2)).alias("_q"))
    mean = F.col("total") / F.col("kinds")
    s = s.withColumn("chi2", F.col("_q") / mean - F.col("total")).withColumn("p_value", F.when(F.col("kinds") < 2, 0.0).otherwise(1 / (1 + F.col("chi2"))))
    return s.withColumn("significant_ref", F.col("p_value") > 0.05).drop("_q")


def possible_signatures(kinds: DataFrame, item: str = "x", longest: int = 3, most: int = 10_000_000) -> DataFrame:
    """Signatures of 2 to ``longest`` different kinds; the kinds are a small domain: more than ``most`` signatures are an error.

    Steps are added by joins with the table of kinds, each a task's work for its share of the shorter ones.
    """
    k = kept(kinds.select(F.col(item).alias("_x")).where("_x is not null").distinct())
    n = k.count()
    if sum(math.perm(n, i) for i in range(2, longest + 1)) > most:
        raise ValueError("too many kinds of events to list their sequences")
    grown = k.select(F.array("_x").alias("_s"))
    out = None
    for _ in range(2, longest + 1):
        grown = kept(grown.join(F.broadcast(k), ~F.array_contains("_s", F.col("_x"))).select(F.concat("_s", F.array("_x")).alias("_s")))  # kinds are counted above
        one = grown.select(F.array_join("_s", "->").alias("signature"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else k.select(F.col("_x").cast("string").alias("signature")).limit(0)


def negative_patterns(possible: DataFrame, observed: DataFrame, keys: tuple[str, ...] = (), strength: float = 0.8) -> DataFrame:
    """Possible signatures that no row of ``observed`` has; with ``keys``, for each key that observed has."""
    seen = kept(observed.select(*keys, "signature").distinct())
    wanted = possible
    if keys:
        # a row for each key and possible signature is what the result is made of; neither side is broadcast
        wanted = possible.hint("shuffle_replicate_nl").crossJoin(seen.select(*keys).distinct())
    return wanted.join(seen.hint("merge"), [*keys, "signature"], "left_anti").withColumn("strength", F.lit(strength))


def numbered_tokens(events: DataFrame, item: Column, keys: tuple[str, ...] = ("room",)) -> DataFrame:
    """(_k, _n, x): each key's tokens in order."""
    return kept(numbered(events, list(keys), ["ts", "event_id"]).select(key_of(keys).alias("_k"), "_n", item.alias("x")))


def coded(tokens: DataFrame) -> tuple[DataFrame, int]:
    """Adds _c, the number of the token x among all kinds, from 0 (null for null), and says how many bits it takes."""
    spark, kinds = tokens.sparkSession, tokens.where("x is not null").select("x").distinct()
    schema = StructType([kinds.schema["x"], StructField("_c", LongType())])
    codes = kept(spark.createDataFrame(kinds.rdd.zipWithIndex().map(lambda r: (r[0][0], r[1])), schema))
    n = codes.count()
    return tokens.join(F.broadcast(codes) if n <= SMALL else codes.hint("merge"), "x", "left"), max(1, (n - 1).bit_length())


class Words:
    """N-grams of up to ``longest`` tokens as numbers: ``each`` tokens of ``bits`` bits are a word, the first token highest."""

    def __init__(self, bits: int, longest: int):
        self.bits, self.each = bits, max(1, min(62 // bits, longest))
        self.count = -(-longest // self.each)
        self.columns = [f"_w{j}" for j in range(self.count)]

    def first(self, later: Callable[[str, int], Column]) -> Column:
        """A place's first word; later(c, j) is c at the place j rows later, or null if there is none."""
        parts = [F.shiftleft(F.coalesce(later("_c", j), F.lit(0)), self.bits * (self.each - 1 - j)) for j in range(self.each)]
        return reduce(Column.bitwiseOR, parts)

    def cut(self, n: Column) -> dict[str, Column]:
        """The words of the first n tokens; what comes later is 0."""
        masks = F.array(*[F.lit(-(1 << self.bits * (self.each - r)) if r else 0).cast("long") for r in range(self.each + 1)])
        valid = lambda j: F.greatest(F.lit(0), F.least(F.lit(self.each), n - j * self.each))
        return {name: F.col(name).bitwiseAND(F.element_at(masks, valid(j) + 1)) for j, name in enumerate(self.columns)}


def ngram_counts(tokens: DataFrame, lengths: list[int], least: int = 1) -> DataFrame:
    """(_k, n, _n, frequency) of each n-gram of tokens(_k, _n, x) of these lengths that stands ``least`` times or more; _n is where it first stands.

    Each place has the numbers of its next tokens packed into a few words, made by one pass over chunks of numbered rows, so
    no text of an n-gram is built and equal words are equal n-grams.  Places with the same longest n-gram become one row with
    their count before anything else is counted, so frequent n-grams are no skew.  Counts from the middle length on are windows
    over one sort: n-grams with the same beginning stand together, and where the beginning is too rare, all longer ones are.
    """
    lengths, longest = sorted(lengths), max(lengths)
    middle = lengths[len(lengths) // 2]
    rows, bits = coded(tokens)
    words, size = Words(bits, longest), max(CHUNK, longest)
    chunk = lambda shift: F.floor((F.col("_n") - 1 - shift) / size)
    dealt = rows.select("_k", "_n", "_c", chunk(0).alias("_own"), F.explode(F.sequence(F.greatest(F.lit(0), chunk(longest - 1)), chunk(0))).alias("_in"))
    back = W.partitionBy("_in", "_k").orderBy(F.desc("_n"))  # so later rows are those seen before
    seen = back.rowsBetween(W.unboundedPreceding, 0)
    end = F.coalesce(F.last(F.when(F.col("_c").isNull(), F.col("_n")), ignorenulls=True).over(seen), F.first("_n").over(seen) + 1)
    later = lambda c, j: F.lag(c, j).over(back) if j else F.col(c)
    places = dealt.withColumns({"_w0": words.first(later), "_m": F.least(F.lit(longest), end - F.col("_n")).cast("int")})
    places = places.select("*", *[F.coalesce(later("_w0", j * words.each), F.lit(0)).alias(f"_w{j}") for j in range(1, words.count)])
    places = places.where((F.col("_in") == F.col("_own")) & (F.col("_m") >= lengths[0])).withColumns(words.cut(F.col("_m")))
    whole = kept(places.groupBy("_k", "_m", *words.columns).agg(F.min("_n").alias("_n"), F.count("*").alias("_f")))

    long, short = [n for n in lengths if n >= middle], [n for n in lengths if n < middle]
    nested, done = {}, 0  # what a length adds to the words of the one before
    for n in long:
        nested[n] = {f"_p{n}_{j}": words.cut(F.lit(n))[f"_w{j}"] for j in range(done // words.each, -(-n // words.each))}
        done = n
    ordered = whole.where(F.col("_m") >= middle).select("_k", "_m", "_n", "_f", *[c.alias(name) for added in nested.values() for name, c in added.items()])
    steps = {n: [*added, "_k"] if n == middle else list(added) for n, added in nested.items()}  # numbers first, they sort fastest
    ordered = ordered.repartition(*steps[middle]).sortWithinPartitions(*sum(steps.values(), []))
    by = []
    for n in long:  # each window's order is a beginning of the sort's
        by += steps[n]
        w, fits = W.partitionBy(*by), F.col("_m") >= n
        ordered = ordered.select("*", F.sum(F.when(fits, F.col("_f"))).over(w).alias(f"_f{n}"), F.min(F.when(fits, F.col("_n"))).over(w).alias(f"_n{n}"))
        if n == middle:
            ordered = ordered.where(F.col(f"_f{n}") >= least)
    each = F.array(*[F.when((F.col("_n") == F.col(f"_n{n}")) & (F.col(f"_f{n}") >= least), F.struct(F.lit(n).alias("n"), "_n", F.col(f"_f{n}").alias("frequency"))) for n in long])
    out = ordered.select("_k", F.inline(F.filter(each, lambda x: x.isNotNull())))
    if not short:
        return out
    counted = [F.min("_n").alias("_n"), F.sum("_f").alias("_f")]
    less = whole.withColumn("_m", F.least("_m", F.lit(short[-1])))
    less = less.withColumns(words.cut(F.col("_m"))).groupBy("_k", "_m", *words.columns).agg(*counted)
    less = less.withColumn("n", F.explode(F.filter(F.array(*map(F.lit, short)), lambda x: x <= F.col("_m"))))
    less = less.withColumns(words.cut(F.col("n"))).groupBy("_k", "n", *words.columns).agg(*counted)
    return out.unionByName(less.where(F.col("_f") >= least).select("_k", "n", "_n", F.col("_f").alias("frequency")))


def signatures(found: DataFrame, tokens: DataFrame) -> DataFrame:
    """Adds signature, the n-gram's tokens, to the n-grams of ngram_counts; only their own tokens are read into texts."""
    places = kept(found).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("_at", F.col("_n") + F.col("_i"))
    words = tokens.select("_k", F.col("_n").alias("_at"), "x")
    one = places.join(words.hint("merge"), ["_k", "_at"]).groupBy(*found.columns).agg(F.array_sort(F.collect_list(F.struct("_i", "x"))).alias("_s"))
    return one.withColumn("signature", F.array_join(F.transform("_s", lambda s: s["x"]), "->")).drop("_s")


def repeated_ngrams(events: DataFrame, item: Column, longest: int, shortest: int = 2, keys: tuple[str, ...] = ("room",), least: int = 3, times: float = 2.0, alphabet: int = 4) -> DataFrame:
    """N-grams with enough occurrences and more than ``times`` what chance gives: (N - n + 1) / alphabet^n, N being the key's rows."""
    tokens = numbered_tokens(events, item, keys)
    totals = events.groupBy(key_of(keys).alias("_k")).agg(F.count("*").alias("_total"))
    joined = ngram_counts(tokens, list(range(shortest, longest + 1)), least).join(totals.hint("merge"), "_k")
    expected = (F.col("_total") - F.col("n") + 1) / F.pow(F.lit(float(alphabet)), F.col("n"))
    chosen = joined.withColumn("expected", expected).where(F.col("frequency") > times * F.col("expected"))
    out = signatures(chosen.withColumn("significance", F.least(F.lit(1.0), F.col("frequency") / (0.1 * F.col("_total")))), tokens)
    return out.select(*[F.col("_k")[k].alias(k) for k in keys], "signature", "n", "frequency", "expected", "significance")


def long_sequences(events: DataFrame, item: Column, lengths: list[int], keys: tuple[str, ...] = ("room",)) -> DataFrame:
    """For each key and length, how many sequences there are, of how many kinds, and how often the commonest stands."""
    out = ngram_counts(numbered_tokens(events, item, keys), lengths).groupBy("_k", "n").agg(F.count("*").alias("kinds"), F.sum("frequency").alias("total"), F.max("frequency").alias("most"))
    return out.select(*[F.col("_k")[k].alias(k) for k in keys], "n", "kinds", "total", "most")


def prefix_span(sessions: DataFrame, least_support: float = 0.1, longest: int = 4) -> DataFrame:
    """Frequent ordered sequences of sessions(sequence array<array<string>>)."""
    from pyspark.ml.fpm import PrefixSpan

    found = PrefixSpan(minSupport=least_support, maxPatternLength=longest, sequenceCol="sequence").findFrequentSequentialPatterns(sessions)
    return found.select(F.array_join(F.transform("sequence", lambda s: F.array_join(s, "+")), "->").alias("pattern"), F.col("freq"))


def daily_sessions(events: DataFrame, item: Column) -> DataFrame:
    steps = F.array_sort(F.collect_list(F.struct("ts", "event_id", item.alias("x"))))
    return events.groupBy("room", F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.transform(steps, lambda s: F.array(s["x"])).alias("sequence"))


def overlapping_blocks(events: DataFrame, keys: tuple[str, ...] = ("room",), size: int = 100, step: int = 50) -> DataFrame:
    """Events dealt to windows of ``size`` rows that start every ``step`` rows."""
    rows = numbered(events, list(keys), ["ts", "event_id"]).withColumn("_i", F.col("_n") - 1).drop("_n")
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - (size - 1)) / step)).cast("int")
    return rows.withColumn("block", F.explode(F.sequence(first, F.floor(F.col("_i") / step).cast("int")))).drop("_i")


def pattern_rows(results: DataFrame) -> DataFrame:
    """Usage pattern rows of bathroom results: hour, weekday and outcome as JSON."""
    data = F.to_json(F.struct(F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"), "reason", "occupied"))
    return results.select("room", F.lit("bathroom_usage").alias("pattern_type"), data.alias("pattern_data"), F.col("confidence"), F.col("ts").alias("discovered_at"), "event_id")
