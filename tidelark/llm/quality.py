"""Text quality rules whose cut-offs come from the data, in DataFrame functions only.

Each text's measures are array expressions inside its own row, so nothing is
shuffled to compute them.  For every language and source a combined aggregate
makes mergeable quantile sketches (KLL) of the measures; a hot source is summed
up before the shuffle like any other.  The sketches are stored once and merged
upwards, to languages and to all texts.  Texts that the fixed rules reject have
no part in them, and fences are set from the median and the quartiles, so up to
a quarter of a group can be junk without moving its cut-offs.  Beyond that
share the wider group holds: a source's cut-off is never laxer than its
language's, and a language's rates never than those of all texts.  A group
with fewer than ``least_group`` texts uses its language's cut-offs, and a
language with fewer uses those of all texts.

Counts of a short text scatter more than those of a long one.  So symbols and
characters are compared with what the fence says for the text's length and the
``noise`` of such a count, and no fixed cut-off is left for them.  Most texts
have no equal line and no repeated words at all, so that the sketches of these
two have no spread: only for them a least rate is given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import keep

#: Rates that mean the same in every language, with the least cut-off of those that most texts have none of; never above 1.
RATES = {"symbol_rate": 0.0, "dup_line_rate": 0.2, "repeat_rate": 0.2}
SKETCHED = (*RATES, "word_length")
#: Texts of more words have their repeated windows sorted as pairs of hash and place.
PACKED_WORDS = 1 << 16


def measures(docs: DataFrame) -> DataFrame:
    """Columns of docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs).

    Words are runs of other characters than ASCII white space.  A null text
    has none, and all its counts are 0.  n_repeat_words counts words inside a
    3-word window that the text holds twice or more.
    """
    base = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    base = base.withColumn("_words", F.filter(F.split("_text", r"\s+"), lambda x: x != ""))
    base = base.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.rtrim(x, F.lit(" \t\x0b\f\r")) != ""))
    n = F.size("_words")
    base = base.withColumn("_hashes", F.transform("_words", lambda x: F.xxhash64(x)))
    triple = lambda x, i: F.xxhash64(x, F.get("_hashes", i + 1), F.get("_hashes", i + 2))
    base = base.withColumn("_triples", F.when(n >= 3, F.transform(F.slice("_hashes", 1, n - 2), triple)).otherwise(F.array().cast("array<bigint>")))
    base = base.withColumn("_packed", F.when(n <= PACKED_WORDS, F.sort_array(F.transform("_triples", lambda x, i: x.bitwiseAND(F.lit(-PACKED_WORDS)).bitwiseOR(i.cast("bigint"))))))
    return base.select(
        *docs.columns,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n < 4, F.lit(0)).when(n <= PACKED_WORDS, _covered(_packed_places("_packed", "_triples"))).otherwise(_covered(_sorted_places("_triples"))).cast("long").alias("n_repeat_words"),
    )


def _packed_places(packed: str, triples: str) -> Column:
    """Places of windows that occur twice, from sorted numbers of a hash's upper bits and a place; equal neighbours are compared in full."""
    low = PACKED_WORDS - 1
    place = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    n = F.size(packed)
    same = lambda x, y: x.bitwiseXOR(y).between(0, low) & (F.get(triples, place(x)) == F.get(triples, place(y)))
    both = lambda x, y: F.shiftleft(x.bitwiseAND(F.lit(low)), 16).bitwiseOR(y.bitwiseAND(F.lit(low)))
    pairs = F.zip_with(F.slice(packed, 1, n - 1), F.slice(packed, 2, n - 1), lambda x, y: F.when(same(x, y), both(x, y)).otherwise(F.lit(-1).cast("bigint")))
    return F.flatten(F.transform(F.filter(pairs, lambda x: x >= 0), lambda x: F.array(F.shiftright(x, 16).cast("int"), place(x))))


def _sorted_places(triples: str) -> Column:
    """The same for texts of any length: windows sorted with their places."""
    ordered = F.array_sort(F.transform(triples, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    pair = F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(-1).alias("i"))
    marks = F.zip_with(
        ordered,
        F.concat(F.array(pair), F.slice(ordered, 1, F.size(triples) - 1)),
        lambda now, before: F.struct(now["h"].eqNullSafe(before["h"]).alias("same"), now["i"].alias("i"), before["i"].alias("was")),
    )
    return F.flatten(F.transform(F.filter(marks, lambda x: x["same"]), lambda x: F.array(x["i"], x["was"])))


def _covered(places: Column) -> Column:
    """Words under 3-word windows at these places: steps between them of at most 3, and the last window."""
    ordered = F.sort_array(F.array_distinct(places))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("to"))
    return F.aggregate(ordered, start, lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x + 3 - a["to"])).alias("n"), (x + 3).alias("to")), lambda a: a["n"])


def rates(measured: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return (
        measured.withColumn("symbol_rate", F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)))
        .withColumn("dup_line_rate", 10 * F.col("n_dup_lines") / n)
        .withColumn("repeat_rate", F.col("n_repeat_words") / n)
        .withColumn("word_length", F.col("word_chars") / n)
    )


def sketches(rated: DataFrame, size: int) -> DataFrame:
    """lang, source, n and a sketch of each measure over the group's texts without base_failed."""
    return rated.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(c, F.lit(size)).alias(c) for c in SKETCHED])


def merged(parts: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The sketches of wider groups."""
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(c, F.lit(size)).alias(c) for c in SKETCHED])


def fences(parts: DataFrame, keys: list[str], suffix: str, spread: float) -> DataFrame:
    """n and each measure's fences, named with the suffix: the quartile and ``spread`` times its distance from the median beyond it."""
    out = []
    for name in SKETCHED:
        q = F.kll_sketch_get_quantile_double(name, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        high = q[2] + spread * (q[2] - q[1])
        if name in RATES:
            high = F.least(F.lit(1.0), F.greatest(F.lit(RATES[name]), high))
        else:
            out.append(F.greatest(F.lit(0.0), q[0] - spread * (q[1] - q[0])).alias(f"low_{name}_{suffix}"))
        out.append(high.alias(f"{name}_{suffix}"))
    return parts.select(*keys, F.col("n").alias(f"n_{suffix}"), *out)


def judged(measured: DataFrame, *, spread: float = 6.0, noise: float = 4.0, least_group: int = 100, sketch_size: int = 1024, broadcast_groups: int = 20_000) -> DataFrame:
    """Adds base_failed and kept to the result of measures().

    base_failed: under 50 words, or more than half the words repeated.  kept is
    false for those and for texts beyond a cut-off of their language and
    source; null languages and sources are groups of their own.  An empty
    table has no cut-offs and no rows.  Up to ``sketch_size`` texts of a group
    are sketched exactly; beyond, a rank is right within a third of a percent.
    """
    rated = rates(measured).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    parts = keep(sketches(rated, sketch_size))
    of_tongue = keep(merged(parts, ["lang"], sketch_size))
    overall = fences(merged(of_tongue, [], sketch_size).where("n > 0"), [], "all", spread).first()
    if overall is None:
        return rated.select(*measured.columns, "base_failed", F.lit(False).alias("kept"))
    group = keep(fences(parts, ["lang", "source"], "s", spread))
    tongue = keep(fences(of_tongue, ["lang"], "l", spread))
    hint = "broadcast" if group.count() <= broadcast_groups else "merge"  # a hundred bytes each
    both = rated.join(group.hint(hint), rated.lang.eqNullSafe(group.lang) & rated.source.eqNullSafe(group.source), "left").drop(group.lang).drop(group.source)
    tongue = tongue.withColumnRenamed("lang", "_lang")
    both = both.join(tongue.hint(hint), both.lang.eqNullSafe(tongue._lang), "left").drop("_lang")

    def limit(name: str) -> Column:
        stricter = F.greatest if name.startswith("low_") else F.least
        whole = F.lit(overall[f"{name}_all"]).cast("double")
        mine, wider = F.col(f"{name}_s"), F.col(f"{name}_l")
        wider = F.when(F.col("n_l") >= least_group, stricter(wider, whole) if name in RATES else wider).otherwise(whole)
        return F.when(F.col("n_s") >= least_group, stricter(mine, wider)).otherwise(wider)

    chars, words = F.col("word_chars"), F.col("n_words")
    symbols, most, least = chars * limit("symbol_rate"), words * limit("word_length"), words * limit("low_word_length")
    beyond = [
        F.col("n_symbols") > symbols + noise * F.sqrt(symbols + noise),
        chars > most + noise * F.sqrt(most),
        chars < least - noise * F.sqrt(least),
        F.col("dup_line_rate") > limit("dup_line_rate"),
        F.col("repeat_rate") > limit("repeat_rate"),
    ]
    fails = F.coalesce(reduce(lambda a, b: a | b, beyond), F.lit(False))
    return both.select(*measured.columns, "base_failed", (~F.col("base_failed") & ~fails).alias("kept"))


def quality(docs: DataFrame, **how) -> DataFrame:
    """doc_id, row, lang, source, the five measures, base_failed and kept; the text is dropped early.

    row is the hash of the text, which tells apart rows that share a doc_id.

    The measures are kept in the shared folder: the sketches and the verdicts read them, not the texts.
    """
    slim = measures(docs.select("doc_id", F.xxhash64("text").alias("row"), "lang", "source", "text")).drop("text")
    return judged(keep(slim), **how)
