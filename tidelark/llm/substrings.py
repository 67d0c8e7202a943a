"""Repeated word spans across documents, by a compacted De Bruijn graph.

Every window of ``window`` words is an edge of the graph.  A window's least
``anchor``-gram (by hash) names it, and the windows in a row that share an
anchor are one path, so a document has about one path for thirteen words
instead of an edge for each.  Spark then

1. groups anchors and keeps those that two documents have,
2. groups equal paths and takes the least document of each: for any later
   document the whole path is repeated, however many windows it has,
3. opens only the paths at anchors where the graph branches, in the one
   document that holds the path first, and compares those window by window,
4. brings the source coordinates back to the text, which is shuffled once.

Each grouping is a minimum, combined before the shuffle, and each join back is
a plain equi-join, so a passage that a third of all documents hold costs one
row for each occurrence and Spark can split its partition.  Paths and windows
are compared by 128-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .frames import keep

PATHS = "doc_id long, row long, anchor long, s1 long, s2 long, lo int, n int"
_PATHS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("anchor", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("lo", pa.int32()), ("n", pa.int32())])
_WINDOWS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64()), ("lo", pa.int32())])


def _paths_of(window: int, anchor: int):
    def run(batches):
        for whole in batches:
            for part in bw.slices(whole):
                ids, row = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "row"))
                w = bw.words(part.column("text"))
                if len(w.hash) < window:
                    continue
                one, two = bw.Rolling(w.hash, 1), bw.Rolling(w.hash, 2)
                grams = one.grams(anchor)
                least = bw.argmin(grams, window - anchor + 1)
                at = np.flatnonzero(bw.whole(w.first, window)[: len(least)])
                if not len(at):
                    continue
                m = least[at]
                new = np.ones(len(at), bool)
                new[1:] = (m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1)
                lo = at[new]
                n = np.diff(np.append(np.flatnonzero(new), len(at)))
                doc = np.searchsorted(w.first, lo, "right") - 1
                end = lo + n + window - 1
                yield bw.batch(_PATHS, ids[doc], row[doc], bw.signed(grams[m[new]]), bw.signed(one.of(lo, end)), bw.signed(two.of(lo, end)), (lo - w.first[doc]).astype(np.int32), n.astype(np.int32))

    return run


def _windows_of(window: int):
    """Hash of each window in the spans (lo, n) of a text."""

    def run(batches):
        for whole in batches:
            for part in bw.slices(whole):
                ids, row = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "row"))
                spans = part.column("open").to_pylist()
                w = bw.words(part.column("text"))
                one, two = bw.Rolling(w.hash, 1), bw.Rolling(w.hash, 2)
                at = [np.arange(x["lo"], x["lo"] + x["n"]) + w.first[d] for d, each in enumerate(spans) for x in each]
                if at:
                    at = np.concatenate(at)
                    doc = np.searchsorted(w.first, at, "right") - 1
                    yield bw.batch(_WINDOWS, ids[doc], row[doc], bw.signed(one.of(at, at + window)), bw.signed(two.of(at, at + window)), (at - w.first[doc]).astype(np.int32))

    return run


def repeated_spans(docs: DataFrame, window: int = 50, anchor: int = 25) -> DataFrame:
    """docs(doc_id, text) with ``spans``: word places (start, end) that earlier documents hold too.

    A window counts if the same words also start in a document with a smaller
    doc_id.  Spans may overlap and are sorted; null or short texts have none.
    Rows that share a doc_id are never repeats of each other; each has the
    spans of its own text.  Extra columns are dropped.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    paths = docs.mapInArrow(_paths_of(window, anchor), PATHS)
    shared = paths.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), (F.min("s1") < F.max("s1")).alias("branches")).where("a < b").select("anchor", "branches")
    shared = keep(shared)  # as a table, so that Spark can split a hot anchor's partition in the join
    found = keep(paths.join(shared.hint("merge"), "anchor"))
    first = keep(found.groupBy("s1", "s2").agg(F.min("doc_id").alias("holder")))
    held = found.join(first.hint("merge"), ["s1", "s2"]).where("doc_id > holder or branches").select("doc_id", "row", "lo", "n", (F.col("doc_id") > F.col("holder")).alias("repeated"))
    each = F.struct("lo", "n")
    of_doc = held.groupBy("doc_id", "row").agg(F.collect_set(F.when(F.col("repeated"), each)).alias("paths"), F.collect_set(F.when(~F.col("repeated"), each)).alias("open"))
    joined = docs.join(of_doc.hint("merge"), ["doc_id", "row"], "left")
    windows = keep(joined.where(F.size("open") > 0).mapInArrow(_windows_of(window), "doc_id long, row long, w1 long, w2 long, lo int"))
    earliest = keep(windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("last")).where("holder < last"))
    later = windows.join(earliest.hint("merge"), ["w1", "w2"]).where("doc_id > holder").groupBy("doc_id", "row").agg(F.collect_set(F.struct("lo", F.lit(1).alias("n"))).alias("single"))
    none = F.array().cast("array<struct<lo:int,n:int>>")
    spans = F.transform(F.array_sort(F.concat(F.coalesce("paths", none), F.coalesce("single", none))), lambda x: F.struct(x["lo"].alias("start"), (x["lo"] + x["n"] + (window - 1)).alias("end")))
    return joined.join(later.hint("merge"), ["doc_id", "row"], "left").select("doc_id", "text", spans.alias("spans"))


def cut_spans(texts_and_spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: the words outside the spans, joined by one space."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def run(batches):
        for whole in batches:
            for part in bw.slices(whole):
                out = []
                for doc, text, spans in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                    words = (text or "").encode().split()
                    kept, to = [], 0
                    for x in spans or ():
                        kept += words[to : x["start"]]
                        to = max(to, x["end"])
                    kept += words[to:]
                    out.append((doc, len(words), len(words) - len(kept), b" ".join(kept).decode()))
                yield bw.batch(schema, *zip(*out, strict=True))

    return texts_and_spans.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


