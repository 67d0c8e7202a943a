"""Benchmark passages in documents, found by winnowed word k-grams.

A text's fingerprints are the least k-gram hashes of every ``window`` words, so
two texts that share ``window`` words in a row share a fingerprint.  The items'
fingerprints are folded into a bitmap of bounded size that goes to every task:
a document's window is passed on only if its fingerprint may be an item's.
Those windows are joined with the items' in Spark on the fingerprint and a
128-bit hash of the whole window, and the hits are extended to word spans.
Items shorter than a window are compared whole, for each length that occurs;
such a window is its own fingerprint.  Texts are read once and never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .frames import keep

FOUND = "doc_id long, row long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
WINDOWS = "id string, size int, mark long, w1 long, w2 long"
_WINDOWS = pa.schema([("id", pa.string()), ("size", pa.int32()), ("mark", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64())])
NEAR = "doc_id long, row long, n_words long, near array<struct<size:int,mark:long,w1:long,w2:long,lo:int>>"
_NEAR = pa.struct([("size", pa.int32()), ("mark", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64()), ("lo", pa.int32())])
#: Bits of one row of Spark's bitmap aggregates.
_ROW_BITS = 32_768


def _marks(w: bw.Words, one: bw.Rolling, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of whole windows, and the hash that winnowing picks for each."""
    grams = one.grams(k)
    least = bw.argmin(grams, window - k + 1)
    at = np.flatnonzero(bw.whole(w.first, window)[: len(least)])
    return at, grams[least[at]] if len(at) else np.zeros(0, bw.U)


def item_windows(items: DataFrame, window: int, k: int) -> DataFrame:
    """Every window of every item with its fingerprint and hashes; a short item is one window."""

    def run(batches):
        for whole in batches:
            for part in bw.slices(whole):
                ids = part.column("item_id").to_numpy(zero_copy_only=False)
                w = bw.words(part.column("text"), bw.ALNUM)
                one, two = bw.Rolling(w.hash, 1), bw.Rolling(w.hash, 2)
                at, mark = _marks(w, one, window, k)
                n = np.diff(w.first)
                short = np.flatnonzero((n > 0) & (n < window))
                at, mark = np.concatenate([at, w.first[short]]), np.concatenate([mark, one.of(w.first[short], w.first[short + 1])])
                doc = np.searchsorted(w.first, at, "right") - 1
                size = np.minimum(n[doc], window)
                yield bw.batch(_WINDOWS, ids[doc], size.astype(np.int32), bw.signed(mark), bw.signed(one.of(at, at + size)), bw.signed(two.of(at, at + size)))

    return items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").mapInArrow(run, WINDOWS)


def _bitmap(windows: DataFrame, bits: int) -> np.ndarray:
    """Which remainders by ``bits`` the fingerprints have; made by a combined aggregate, so bits / 8 bytes reach the driver."""
    rest = F.pmod("mark", F.lit(bits))
    rows = windows.groupBy(F.bitmap_bucket_number(rest).alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(rest)).alias("bits")).collect()
    out = np.zeros(bits + 2 * _ROW_BITS, bool)
    for r in rows:  # rows count from 1 and hold the numbers from (row - 1) * _ROW_BITS + 1 on; 0 is in row 0
        at = (r.row - 1) * _ROW_BITS + 1
        set_here = np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")) + at
        out[np.maximum(set_here, 0)] = True
    return np.packbits(out[:bits], bitorder="little")


def _near_windows(docs: DataFrame, bitmap: np.ndarray, bits: int, short: list[int], window: int, k: int) -> DataFrame:
    """Each document's windows whose fingerprint the bitmap has."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        known = shared.value
        for whole in batches:
            for part in bw.slices(whole):
                ids, row = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "row"))
                w = bw.words(part.column("text"), bw.ALNUM)
                one, two = bw.Rolling(w.hash, 1), bw.Rolling(w.hash, 2)
                ats, sizes, marks = [], [], []
                for n in (*short, window):
                    if n == window:
                        at, mark = _marks(w, one, window, k)
                    else:
                        at = np.flatnonzero(bw.whole(w.first, n))
                        mark = one.of(at, at + n)
                    bit = np.mod(bw.signed(mark), bits)
                    on = np.flatnonzero(known[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                    ats.append(at[on])
                    marks.append(mark[on])
                    sizes.append(np.full(len(on), n, np.int32))
                at, mark, size = np.concatenate(ats), np.concatenate(marks), np.concatenate(sizes)
                order = np.argsort(at, kind="stable")
                at, mark, size = at[order], mark[order], size[order]
                doc = np.searchsorted(w.first, at, "right") - 1
                fields = [pa.array(size, pa.int32()), *(pa.array(bw.signed(x), pa.int64()) for x in (mark, one.of(at, at + size), two.of(at, at + size))), pa.array((at - w.first[doc]).astype(np.int32), pa.int32())]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(ids) + 1)), pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_NEAR)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(row, pa.int64()), pa.array(np.diff(w.first), pa.int64()), lists], names=["doc_id", "row", "n_words", "near"])

    return docs.mapInArrow(run, NEAR)


def _extended(batches):
    """Word spans and their length from each document's hits."""
    for b in batches:
        spans, n_hit = [], []
        for hits in b.column("hits").to_pylist():
            mine: list[list[int]] = []
            for lo, to in sorted((x["lo"], x["lo"] + x["size"]) for x in hits or ()):
                if mine and lo <= mine[-1][1]:
                    mine[-1][1] = max(to, mine[-1][1])
                else:
                    mine.append([lo, to])
            spans.append([{"start": a, "end": e} for a, e in mine])
            n_hit.append(sum(e - a for a, e in mine))
        items = b.column("items")
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), b.column("n_words"), pa.array(n_hit, pa.int64()), items, pa.array(spans, _SPAN)], names=["doc_id", "row", "n_words", "n_hit", "items", "spans"])


def benchmark_hits(docs: DataFrame, items: DataFrame, *, window: int = 10, k: int = 5, most_bits: int = 1 << 27) -> DataFrame:
    """For each document: row (its text's hash), n_words, n_hit, the items that occur in it (ids as strings, sorted) and the word spans they cover.

    Words are lower-cased runs of letters and digits (any non-ASCII character
    counts as a letter).  Null or empty texts and items have none and hit
    nothing; equal items are all listed, one without an id as the empty
    string; documents that share an id keep a row each, judged by its own
    text.  Other columns are dropped.  The bitmap has 16 bits for each window
    of the items, ``most_bits`` (16 MB) at most: a larger benchmark passes more
    windows on to the join and changes no result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")  # equal rows of one id have equal results
    windows = keep(item_windows(items, window, k))
    sizes = windows.groupBy("size").count().collect()  # at most ``window`` rows
    wanted = max(_ROW_BITS, 16 * sum(r["count"] for r in sizes))
    bits = min(most_bits, 1 << (wanted - 1).bit_length())
    near = keep(_near_windows(docs, _bitmap(windows, bits), bits, sorted(r["size"] for r in sizes if r["size"] < window), window, k))

    grouped = windows.groupBy("size", "mark", "w1", "w2").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    named = keep(grouped.withColumn("names", F.xxhash64("ids")))  # windows of one passage have the same items
    names = keep(named.groupBy("names").agg(F.first("ids").alias("ids")))
    opened = near.where(F.size("near") > 0).select("doc_id", "row", F.explode("near").alias("x")).select("doc_id", "row", "x.*")
    hits = keep(opened.join(named.drop("ids").hint("merge"), ["size", "mark", "w1", "w2"]).select("doc_id", "row", "lo", "size", "names"))
    of_doc = hits.groupBy("doc_id", "row")
    places = of_doc.agg(F.collect_set(F.struct("lo", "size")).alias("hits"))
    found = hits.select("doc_id", "row", "names").distinct().join(names.hint("merge"), "names").select("doc_id", "row", F.explode("ids").alias("id"))
    listed = found.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("id")).alias("items"))  # no more than the result has
    joined = near.drop("near").join(keep(places).hint("merge"), ["doc_id", "row"], "left").join(keep(listed).hint("merge"), ["doc_id", "row"], "left")
    return joined.select("doc_id", "row", "n_words", "hits", F.coalesce("items", F.array().cast("array<string>")).alias("items")).mapInArrow(_extended, FOUND)
