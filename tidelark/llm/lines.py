"""Lines whose template recurs across unrelated documents.

A fixed-depth tree over lines: the number of tokens, then the leading tokens,
with every token that holds a digit read as a variable.  In a leaf that many
documents reach, token places where one token prevails are the template's
constants and the others are variable fields.  A line belongs to the leaf's
template if it has all its constants; another line's template is its own
masked tokens.

A template is dropped if enough documents have it in enough different
surroundings.  Surroundings are the last words before the line and the first
ones after it: lines of copied documents recur too, but always in the same
place, and are left to the operators for near duplicates.  Documents with
equal texts count as one.  A block of recurring lines is found from its ends:
once a line is known to recur, its neighbours' surroundings are taken from
beyond it, and this is repeated until no more lines are found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytewords as bw
from .frames import keep

LINES = "doc_id long, row long, line int, leaf long, s1 long, s2 long, copy long, nth int, before long, after long, again boolean, tokens binary"
_LINES = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("line", pa.int32()), ("leaf", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("copy", pa.int64()), ("nth", pa.int32()), ("before", pa.int64()), ("after", pa.int64()), ("again", pa.bool_()), ("tokens", pa.binary())])
#: Words on either side that make up a line's surroundings.
NEAR = 2


def _parsed(depth: int):
    def run(batches):
        for whole in batches:
            for part in bw.slices(whole):
                ids = part.column("doc_id").take(pa.array(np.arange(part.num_rows)))
                rows = part.column("row").to_numpy(zero_copy_only=False)
                w = bw.words(part.column("text"), masked=True)
                if not len(w.hash):
                    continue
                offsets = bw.buffer(part.column("text"))[1]
                breaks = np.concatenate([[0], np.cumsum(w.data == 10)])
                doc = w.doc
                number = breaks[w.start] - breaks[offsets[doc]]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])
                lo = np.flatnonzero(new)
                hi = np.append(lo[1:], len(doc))
                one, two = bw.Rolling(w.hash, 1), bw.Rolling(w.hash, 2)
                of, n = doc[lo], hi - lo
                leaf = bw.mix(one.of(lo, np.minimum(lo + depth, hi)) + n.astype(bw.U), 3)
                s1, s2 = one.of(lo, hi), two.of(lo, hi)
                head, tail = one.of(lo, np.minimum(lo + NEAR, hi)), one.of(np.maximum(hi - NEAR, lo), hi)
                same = of[1:] == of[:-1]
                before, after = np.zeros(len(lo), bw.U), np.zeros(len(lo), bw.U)
                before[1:][same] = tail[:-1][same]
                after[:-1][same] = head[1:][same]
                first = np.ones(len(of), bool)
                first[1:] = ~same
                begins = np.flatnonzero(first)
                ends = np.append(begins[1:], len(of)) - 1
                nth = np.arange(len(of)) - np.repeat(begins, ends - begins + 1)
                copy = np.repeat(bw.mix(one.of(lo[begins], hi[ends]) + bw.mix(two.of(lo[begins], hi[ends]), 5), 6), ends - begins + 1)
                order = np.lexsort((lo, s2, s1, of))
                again = np.zeros(len(lo), bool)
                x, y = order[1:], order[:-1]
                again[x] = (of[x] == of[y]) & (s1[x] == s1[y]) & (s2[x] == s2[y])
                short = pa.py_buffer(w.hash.astype("<u2").tobytes())
                tokens = pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(np.append(lo, len(doc)).astype(np.int32) * 2), short])
                yield bw.batch(_LINES, ids.take(pa.array(of)), rows[of], number[lo].astype(np.int32), bw.signed(leaf), bw.signed(s1), bw.signed(s2), bw.signed(copy), nth.astype(np.int32), bw.signed(before), bw.signed(after), again, tokens)

    return run


def _places(batches):
    """(leaf, at, token, docs) of each token of a template."""
    schema = pa.schema([("leaf", pa.int64()), ("at", pa.int32()), ("token", pa.int32()), ("docs", pa.int64())])
    for b in batches:
        tokens = [np.frombuffer(t, "<u2") for t in b.column("tokens").to_pylist()]
        n = np.array([len(t) for t in tokens], dtype=np.int64)
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        yield bw.batch(schema, b.column("leaf").to_numpy()[row], at.astype(np.int32), np.concatenate([np.zeros(0, "<u2"), *tokens]).astype(np.int32), b.column("docs").to_numpy()[row])


def _matched(batches):
    """Adds whether a line has all its leaf's constants."""
    for b in batches:
        out = []
        for t, constants in zip(b.column("tokens").to_pylist(), b.column("constants").to_pylist(), strict=True):
            x = np.frombuffer(t, "<u2")
            out.append(constants is not None and all(x[c["at"]] == c["token"] for c in constants))
        yield pa.RecordBatch.from_arrays([b.column("leaf"), b.column("s1"), b.column("s2"), pa.array(out, pa.bool_())], names=["leaf", "s1", "s2", "general"])


def _spread(places: DataFrame) -> DataFrame:
    """(template, places, docs): how many different surroundings each template has, in how many different texts."""
    once = places.groupBy("template", "copy").agg(F.min(F.xxhash64("before", "after")).alias("place"))
    return once.groupBy("template", "place").agg(F.count("*").alias("docs")).groupBy("template").agg(F.count("*").alias("places"), F.sum("docs").alias("docs"))


def _beyond(places: DataFrame) -> DataFrame:
    """places with the surroundings of each line taken from beyond the adjacent lines that are ``known``."""
    doc = Window.partitionBy("copy")
    out = places
    for side, order, step in (("before", F.col("nth").asc(), 1), ("after", F.col("nth").desc(), -1)):
        w = doc.orderBy(order)
        hidden = F.coalesce(F.lag("known").over(w) & (F.lag("nth").over(w) + step == F.col("nth")), F.lit(False))
        out = out.withColumn("_own", F.when(~hidden, F.col(side)))
        out = out.withColumn(side, F.last("_own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_own")
    return out


def _in_runs(texts: DataFrame, least_docs: int, enough, together: float = 0.8) -> DataFrame:
    """Templates of the runs that recur: adjacent lines, each pair of which makes up ``together`` of both lines' places.

    One grouping of pairs and one of runs, whatever a run's length; a run is the same if all its lines are.
    """
    doc = Window.partitionBy("copy").orderBy("nth")
    step = texts.withColumn("next", F.when(F.lead("nth").over(doc) == F.col("nth") + 1, F.lead("template").over(doc)))
    step = keep(step)
    pairs = step.where("next is not null").groupBy("template", "next").agg(F.count("*").alias("n"))
    often = keep(step.groupBy("template").agg(F.count("*").alias("all")))
    first, second = often.withColumnRenamed("all", "of_one"), often.select(F.col("template").alias("next"), F.col("all").alias("of_next"))
    close = pairs.where(F.col("n") >= least_docs).join(first.hint("merge"), "template").join(second.hint("merge"), "next").where(F.col("n") >= together * F.greatest("of_one", "of_next"))
    close = keep(close.select("template", "next", F.lit(True).alias("close")))
    tied = keep(step.join(close.hint("merge"), ["template", "next"], "left"))
    begins = F.when(F.coalesce(F.lag("close").over(doc), F.lit(False)) & (F.lag("nth").over(doc) + 1 == F.col("nth")), 0).otherwise(1)
    numbered = tied.withColumn("_new", begins).withColumn("run", F.sum("_new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    placed = numbered.withColumn("_at", F.col("nth") - F.min("nth").over(Window.partitionBy("copy", "run")))
    placed = keep(placed.select("copy", "run", "nth", "_at", "before", "after", "template"))
    runs = placed.groupBy("copy", "run").agg(F.count("*").alias("lines"), F.bit_xor(F.xxhash64("template", "_at")).alias("x"), F.bit_xor(F.xxhash64("_at", "template")).alias("y"), F.min_by("before", "nth").alias("before"), F.max_by("after", "nth").alias("after")).where("lines > 1")
    runs = keep(runs.withColumn("template", F.struct("lines", "x", "y")))
    good = keep(_spread(runs).where((F.col("docs") >= least_docs) & enough).select("template"))
    chosen = runs.join(good.hint("merge"), "template", "left_semi").select("copy", "run")
    return placed.join(keep(chosen).hint("merge"), ["copy", "run"], "left_semi").select("template").distinct()


def recurring_lines(docs: DataFrame, *, depth: int = 2, least_docs: int = 10, variety: float = 0.5, constant_share: float = 0.6, fixed_part: float = 0.6) -> DataFrame:
    """doc_id, row (the text's hash) and ``drop``, the numbers (from 0) of its lines whose template recurs; other rows are absent.

    Rows are told apart by doc_id and text: rows that share a doc_id are judged and cut each by their own text, and
    repeated rows, of one doc_id and text, have one row here.  A template recurs if at least ``least_docs`` different surroundings and at
    least ``variety`` times as many as different texts have it.  A leaf has a template
    of its own if at least ``fixed_part`` of its places are constant, each with
    one token in ``constant_share`` of its documents.  Blank lines never recur;
    null and empty texts have none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    parsed = docs.mapInArrow(_parsed(depth), LINES)
    count = F.sum((~F.col("again")).cast("long"))
    leaves = keep(parsed.drop("tokens").groupBy("leaf").agg(F.min("row").alias("a"), F.max("row").alias("b"), count.alias("docs")).where(f"a < b and docs >= {int(least_docs)}").select("leaf"))
    found = keep(parsed.join(leaves.hint("merge"), "leaf"))

    masked = found.groupBy("leaf", "s1", "s2").agg(count.alias("docs"), F.min("tokens").alias("tokens"))
    masked = keep(masked)
    mixed = masked.groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("docs").alias("all_docs")).where("kinds > 1")
    mixed = keep(mixed)
    spread = masked.join(mixed.hint("merge"), "leaf").select("leaf", "tokens", "docs").mapInArrow(_places, "leaf long, at int, token int, docs long")
    top = spread.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("docs")).groupBy("leaf", "at").agg(F.max(F.struct("docs", "token")).alias("top"))
    general = top.join(mixed.hint("merge"), "leaf").groupBy("leaf").agg(
        F.count("*").alias("places"),
        F.collect_list(F.when(F.col("top.docs") >= constant_share * F.col("all_docs"), F.struct("at", F.col("top.token").alias("token")))).alias("constants"),
    )
    general = keep(general.where(F.size("constants") >= fixed_part * F.col("places")).select("leaf", "constants"))
    kinds = keep(masked.join(general.hint("merge"), "leaf").select("leaf", "s1", "s2", "tokens", "constants").mapInArrow(_matched, "leaf long, s1 long, s2 long, general boolean").where("general").select("s1", "s2", "general"))

    template = F.when(F.col("general"), F.struct(F.col("leaf").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(True).alias("z"))).otherwise(F.struct(F.col("s1").alias("x"), F.col("s2").alias("y"), F.lit(False).alias("z")))
    places = found.drop("tokens").join(kinds.hint("merge"), ["s1", "s2"], "left").select("doc_id", "row", "line", "copy", "nth", "before", "after", template.alias("template"))
    places = keep(places)
    often = keep(_spread(places).where(F.col("docs") >= least_docs))
    places = keep(places.join(often.hint("merge"), "template", "left_semi"))  # a template of fewer texts never recurs
    texts = keep(places.select("copy", "nth", "before", "after", "template").distinct())
    enough = F.col("places") >= F.greatest(F.lit(least_docs), variety * F.col("docs"))
    recurs = keep(often.where(enough).select("template").unionByName(_in_runs(texts, least_docs, enough)).distinct())
    n, was = recurs.count(), 0
    while n > was:
        known = recurs.withColumn("known", F.lit(True))
        marked = keep(texts.join(known.hint("merge"), "template", "left").withColumn("known", F.col("known").isNotNull()))
        more = _spread(_beyond(marked).where(~F.col("known"))).where(enough).select("template")
        recurs = keep(recurs.unionByName(more))
        n, was = recurs.count(), n
    return places.join(recurs.hint("merge"), "template").groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("line")).alias("drop"))


def without_recurring_lines(docs: DataFrame, **how) -> DataFrame:
    """docs with those lines taken out of ``text``, and new columns n_lines and n_dropped.

    A text that keeps all its lines is unchanged, null included; one that loses
    all is empty.  n_lines counts the parts between line feeds, 0 for null.
    Columns of docs with those two names are replaced.  Rows that share a doc_id
    lose lines of their own text only; null ids are ids like any other.
    """
    docs = docs.drop("n_lines", "n_dropped")
    drop = keep(recurring_lines(docs, **how)).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.col("drop").alias("_drop"))
    joined = docs.join(drop.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_row")), "left").drop("_id", "_row")
    names = docs.columns

    def run(batches):
        for b in batches:
            texts, lines, dropped = [], [], []
            for text, drop in zip(b.column("text").to_pylist(), b.column("_drop").to_pylist(), strict=True):
                if drop:
                    rows, gone = text.split("\n"), set(drop)
                    texts.append("\n".join(r for i, r in enumerate(rows) if i not in gone))
                    lines.append(len(rows))
                else:
                    texts.append(text)
                    lines.append(0 if text is None else text.count("\n") + 1)
                dropped.append(len(drop or ()))
            columns = [pa.array(texts, b.column(c).type) if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(run, f"{kind}, n_lines long, n_dropped long")
