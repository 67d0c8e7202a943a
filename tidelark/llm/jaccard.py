"""Near-duplicate texts: MinHash banding, then exact Jaccard similarity of word n-gram sets.

Texts with the same words in the same order are one class of copies and only
the one with the least id goes on.  Band hashes are shuffled; each band's
texts are tied to its least one, which gives clusters outside of which no pair
shares a band.  Every cluster's texts are shuffled once and compared on their
full n-gram sets.  A large cluster is dealt out by hash in blocks, and each
pair of blocks is its own task, so no task holds more than two blocks.  Tasks
return counts of links and each text's least linked one, never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .frames import keep, linked_groups


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """The least number of bands that finds a pair of this similarity with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def shingles(w: bw.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the distinct word n-grams of each text, in order; a shorter text has itself as one."""
    one = bw.Rolling(w.hash, 1)
    at = np.flatnonzero(bw.whole(w.first, n))
    size = np.diff(w.first)
    short = np.flatnonzero((size > 0) & (size < n))
    at, end = np.concatenate([at, w.first[short]]), np.concatenate([at + n, w.first[short + 1]])
    doc = np.searchsorted(w.first, at, "right") - 1
    h = one.of(at, end)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def _signatures(n: int, bands: int, rows: int):
    salts = bw.mix(np.arange(bands * rows, dtype=bw.U), 31)
    factors = (salts >> bw.U(32)).astype(np.uint32) | np.uint32(1)
    masks = salts.astype(np.uint32)
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("n_shingles", pa.int32()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for whole in batches:
            for part in bw.slices(whole):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                w = bw.words(part.column("text"))
                one, two = bw.Rolling(w.hash, 1), bw.Rolling(w.hash, 2)
                h, doc = shingles(w, n)
                count = np.bincount(doc, minlength=len(ids))
                full = np.flatnonzero(count)
                begin = (np.cumsum(count) - count)[full]
                low = (h ^ (h >> bw.U(32))).astype(np.uint32)
                key = np.zeros((bands, len(ids)), bw.U)
                for b in range(bands if len(full) else 0):
                    for r in range(b * rows, (b + 1) * rows):
                        v = (low ^ masks[r]) * factors[r]
                        key[b, full] = bw.mix(key[b, full] + np.minimum.reduceat(v ^ (v >> np.uint32(15)), begin).astype(bw.U), r)
                yield bw.batch(schema, ids, part.column("row").to_numpy(zero_copy_only=False), bw.signed(one.of(w.first[:-1], w.first[1:])), bw.signed(two.of(w.first[:-1], w.first[1:])), count.astype(np.int32), pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(ids) + 1, bands), pa.int32()), pa.array(bw.signed(key.T.ravel()))))

    return run


def _intersections(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int], width: int = 4096) -> np.ndarray:
    """Sizes of the common n-gram sets of all texts of a and of b, over the n-grams that both have."""
    (ha, da, na), (hb, db, nb) = a, b
    out = np.zeros((na, nb), np.float32)
    common = np.intersect1d(ha, hb)
    ia, ib = np.searchsorted(common, ha), np.searchsorted(common, hb)
    for h, i in ((ha, ia), (hb, ib)):
        i[common[np.minimum(i, len(common) - 1)] != h if len(common) else slice(None)] = -1
    for k in range(0, len(common), width):
        x, y = np.zeros((na, width), np.float32), np.zeros((nb, width), np.float32)
        for m, i, d in ((x, ia, da), (y, ib, db)):
            on = (i >= k) & (i < k + width)
            m[d[on], i[on] - k] = 1
        out += x @ y.T
    return out


def _stars(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """(row, row of the group's least id) of every other row that the pairs (a, b) of row numbers join to it."""
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(rank[a].tolist(), rank[b].tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            up[max(p, q)] = min(p, q)
    return order[np.array([(x, top(x)) for x in list(up) if top(x) != x], np.int64).reshape(-1, 2)]


FOUND = "doc_id long, row long, n_links long, to_doc long, to_row long"
_FOUND = pa.schema([(name, pa.int64()) for name in ("doc_id", "row", "n_links", "to_doc", "to_row")])


def _compare(n: int, least: float):
    def side(rows: pa.Table):
        w = bw.words(rows.column("text").combine_chunks() if isinstance(rows.column("text"), pa.ChunkedArray) else rows.column("text"))
        h, doc = shingles(w, n)
        ids = np.stack([rows.column(c).to_numpy() for c in ("doc_id", "row")], 1)
        return (h, doc, rows.num_rows), np.bincount(doc, minlength=rows.num_rows), ids

    def run(rows: pa.Table) -> pa.Table:
        first = rows.column("first").to_numpy()
        own = bool(rows.column("same")[0].as_py())
        a, size_a, id_a = side(rows if own else rows.filter(pa.array(first)))
        b, size_b, id_b = (a, size_a, id_a) if own else side(rows.filter(pa.array(~first)))
        if not len(id_a) or not len(id_b):
            return _FOUND.empty_table()
        both = _intersections(a, b)
        alike = (both >= least * (size_a[:, None] + size_b[None, :] - both) * (1 - 1e-7)) & (both > 0)
        if own:
            np.fill_diagonal(alike, False)
        links = np.concatenate([alike.sum(1), [] if own else alike.sum(0)]).astype(np.int64)
        ids = id_a if own else np.concatenate([id_a, id_b])
        i, j = np.nonzero(np.triu(alike) if own else alike)
        tree = _stars(i, j if own else j + len(id_a), ids)
        some = np.flatnonzero(links)
        left = np.concatenate([ids[some], ids[tree[:, 0]]])
        count = np.concatenate([links[some], np.zeros(len(tree), np.int64)])
        right = [pa.array([None] * len(some) + ids[tree[:, 1], c].tolist(), pa.int64()) for c in (0, 1)]
        return pa.Table.from_arrays([pa.array(left[:, 0]), pa.array(left[:, 1]), pa.array(count), *right], schema=_FOUND)

    return run


def near_duplicates(docs: DataFrame, *, n: int = 5, similarity: float = 0.8, rows: int = 4, recall: float = 0.9999, block_shingles: int = 200_000, block_docs: int = 400) -> DataFrame:
    """One row per document: doc_id, row, class_id, class_row, n_links, n_copies.

    row is the hash of the text, which tells apart rows that share a doc_id.
    class_id is the least doc_id of the texts that links join, directly or
    over others, and class_row that text's row.  n_links counts the different texts with at least this
    similarity to the document's own; n_copies counts the documents with the
    same words, itself included.  A text of fewer than n words has itself as
    its only n-gram.  A document without words (null, empty, white space) is a
    class of its own with no links.  Different texts under one doc_id are
    different texts, and each row has the result of its own.  The bands find a
    pair just at the threshold with the probability ``recall``, closer ones
    with more; pairs of one cluster are all compared, whether they share a
    band or not.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    bands = bands_for(similarity, rows, recall)
    marks = keep(docs.mapInArrow(_signatures(n, bands, rows), "doc_id long, row long, t1 long, t2 long, n_shingles int, bands array<long>"))
    worded = marks.where("n_shingles > 0")
    # a text is known by its first row: the least doc_id, and the hash of what stands there
    copies = keep(worded.groupBy("t1", "t2").agg(F.min(F.struct("doc_id", "row")).alias("node"), F.count("*").alias("n_copies")))
    mine = F.struct("doc_id", "row") == F.col("node")
    reps = keep(worded.join(copies.hint("merge"), ["t1", "t2"]).where(mine).select("node", "n_shingles", "bands").dropDuplicates(["node"]))

    banded = reps.select("node", F.posexplode("bands").alias("band", "hash"))
    buckets = keep(banded.groupBy("band", "hash").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").drop("most"))
    edges = banded.join(buckets.hint("merge"), ["band", "hash"]).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    cluster = keep(linked_groups(edges).join(reps.select("node", "n_shingles").hint("merge"), "node"))

    weight = F.greatest(F.col("n_shingles") / block_shingles, F.lit(1.0 / block_docs))
    sized = keep(cluster.groupBy("root").agg(F.ceil(F.sum(weight)).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = cluster.join(sized.hint("merge"), "root").select("node", "root", "blocks", block.alias("block"))
    dealt = dealt.select("node", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("node.*", F.col("root.doc_id").alias("root_doc"), F.col("root.row").alias("root_row"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("first"), (F.col("block") == F.col("other")).alias("same"))
    pair = ["root_doc", "root_row", "i", "j"]
    texts = docs.join(dealt.hint("merge"), ["doc_id", "row"]).dropDuplicates(["doc_id", "row", *pair])
    found = keep(texts.groupBy(*pair).applyInArrow(_compare(n, similarity), FOUND))

    links = found.where("to_doc is null").groupBy(F.struct("doc_id", "row").alias("node")).agg(F.sum("n_links").alias("n_links"))
    joined = linked_groups(found.where("to_doc is not null").select(F.struct("doc_id", "row").alias("a"), F.struct(F.col("to_doc").alias("doc_id"), F.col("to_row").alias("row")).alias("b")))
    known = copies.join(links.hint("merge"), "node", "left").join(joined.hint("merge"), "node", "left")
    known = keep(known.select("t1", "t2", F.coalesce("root", "node")["doc_id"].alias("class_id"), F.coalesce("root", "node")["row"].alias("class_row"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"))
    out = worded.select("doc_id", "row", "t1", "t2").join(known.hint("merge"), ["t1", "t2"]).select("doc_id", "row", "class_id", "class_row", "n_links", "n_copies")
    alone = marks.where("n_shingles = 0").select("doc_id", "row", F.col("doc_id").alias("class_id"), F.col("row").alias("class_row"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return out.unionByName(alone)
