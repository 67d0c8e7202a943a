"""Hard negatives by exact scores from Four-Russians tables.

Vectors become integers.  Candidates are stored in blocks of one label, as bit
planes: of each plane, the bits of eight dimensions are packed into a byte.  For
an anchor, and each eight dimensions, the sums of all 256 subsets of its
components are computed once; a candidate's score is then a lookup for each
byte, added up plane by plane with a shift between planes (the highest plane, the sign's, counts
negative).  These are whole scores, in integers, not estimates.

A stated set of anchors meets all rows in blocks: each anchor block is sent to
every block of candidates, and first only to those of its own label, which
gives the positives.  Every block returns the few rows that can be among the
first, so that what the last windows sort grows with blocks, not with pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import keep

#: Rows of a candidate block and of an anchor block that are aimed at.
CANDIDATES, ANCHORS = 1024, 512
#: Pairs are scored so many at a time, for the processor's caches.
_TILE_ROWS, _TILE_ANCHORS = 256, 256
_NO_ID = np.iinfo(np.int64).max  # a null id comes last among ties


def usable(vector: str | Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def packed(values: np.ndarray) -> np.ndarray:
    """Bit planes of the rows' two's complement: bytes[plane, eight dimensions, row], the lowest plane first; as many planes as the values need."""
    n, d = values.shape
    values = np.pad(values, ((0, 0), (0, -d % 8)))
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    planes = max((-low - 1).bit_length() if low < 0 else 0, high.bit_length() if high > 0 else 0) + 1
    out = np.empty((planes, values.shape[1] // 8, n), np.uint8)
    for b in range(planes):
        out[b] = np.packbits(((values >> b) & 1).astype(np.uint8), axis=1, bitorder="little").T
    return out


def subset_sums(anchors: np.ndarray, dtype: type = np.int64) -> np.ndarray:
    """table[eight dimensions, byte, anchor]: the sum of the anchor's components whose bits are set in the byte."""
    n, d = anchors.shape
    parts = np.pad(anchors, ((0, 0), (0, -d % 8))).T.reshape(-1, 8, n)
    table = np.zeros((len(parts), 1, n), np.int64)
    for k in range(8):
        table = np.concatenate([table, table + parts[:, k : k + 1]], axis=1)
    return table.astype(dtype)


def scores(anchors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products [row, anchor] of int64 anchors with packed rows, exact as long as they fit 64 bits."""
    n = planes.shape[2]
    groups = min(planes.shape[1], -(-anchors.shape[1] // 8))  # components that one side lacks are zeros
    reach = int(np.abs(anchors).astype(object).sum(axis=1).max()) if anchors.size else 0
    dtype = np.int32 if reach << planes.shape[0] < 2**31 else np.int64
    out = np.zeros((n, len(anchors)), np.int64)
    for a in range(0, len(anchors), _TILE_ANCHORS):
        table = subset_sums(anchors[a : a + _TILE_ANCHORS], dtype)
        wide = table.shape[2]
        for r in range(0, n, _TILE_ROWS):
            tile = planes[:, :, r : r + _TILE_ROWS]
            total, part = np.zeros((tile.shape[2], wide), dtype), np.empty((tile.shape[2], wide), dtype)
            for b in range(len(tile) - 1, -1, -1):
                for g in range(groups):
                    np.take(table[g], tile[b, g], axis=0, out=part, mode="clip")
                    if b == len(tile) - 1:
                        total -= part
                    else:
                        total += part
                if b:
                    total <<= 1
            out[r : r + _TILE_ROWS, a : a + wide] = total
    return out


def _matrix(vectors) -> np.ndarray:
    """int64 rows; shorter vectors end in zeros."""
    rows = [np.asarray(v, np.int64) for v in vectors]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _ids(values) -> np.ndarray:
    return np.array([_NO_ID if v is None or v != v else int(v) for v in values], np.int64)


def _best(found: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (anchor, row, score), each anchor's first ``most``, higher scores first and then smaller ids."""
    a, r, s = found
    order = np.lexsort((ids[r], -s, a))
    a, r, s = a[order], r[order], s[order]
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    place = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
    return a[place < most], r[place < most], s[place < most]


_BLOCK = "label long, block long, n int, rows binary, ids binary, planes binary, shape array<int>"


def _candidate_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    ids = _ids(rows["id"])
    planes = packed(_matrix(rows["vector"]))
    return pd.DataFrame({"label": [key[0]], "block": [key[1]], "n": [len(rows)], "rows": [rows["row"].to_numpy(np.int64).tobytes()], "ids": [ids.tobytes()], "planes": [planes.tobytes()], "shape": [list(planes.shape)]})


_QUERY = "anchor_label long, anchor_block long, anchor_rows binary, vectors binary, width int, bands binary"


def _anchor_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """bands: (positive's place, its id, its score) of up to 5 positives for each anchor, as int64, flattened with the anchor's index."""
    vectors = _matrix(rows["vector"])
    bands = [(i, p["place"], p["id"], p["score"]) for i, ps in enumerate(rows["positives"]) for p in (ps if ps is not None else ())]
    bands = np.array(bands, np.int64).reshape(-1, 4)
    return pd.DataFrame({"anchor_label": [key[0]], "anchor_block": [key[1]], "anchor_rows": [rows["row"].to_numpy(np.int64).tobytes()], "vectors": [vectors.tobytes()], "width": [vectors.shape[1]], "bands": [bands.tobytes()]})


_FOUND = "row long, place int, id long, score long"
_FOUND_ARROW = pa.schema([("row", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def _arrow(row, place, ids, score) -> pa.RecordBatch:
    return pa.record_batch([pa.array(row, pa.int64()), pa.array(place, pa.int32()), pa.array(ids, pa.int64(), mask=ids == _NO_ID), pa.array(score, pa.int64())], schema=_FOUND_ARROW)


def _pairs(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for x in batch.to_pylist():
            vectors = np.frombuffer(x["vectors"], np.int64).reshape(-1, x["width"]) if x["width"] else np.zeros((len(x["anchor_rows"]) // 8, 0), np.int64)
            planes = np.frombuffer(x["planes"], np.uint8).reshape(x["shape"])
            yield x, scores(vectors, planes), np.frombuffer(x["anchor_rows"], np.int64), np.frombuffer(x["rows"], np.int64), np.frombuffer(x["ids"], np.int64)


def _first_positives(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, score, mine, rows, ids in _pairs(batches):
            a, r = np.nonzero(mine[:, None] != rows[None, :])
            a, r, s = _best((a, r, score[r, a]), ids, most)
            yield _arrow(mine[a], np.zeros(len(a), np.int32), ids[r], s)

    return run


def _first_negatives(most: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, score, mine, rows, ids in _pairs(batches):
            bands = np.frombuffer(x["bands"], np.int64).reshape(-1, 4)
            bands = bands[bands[:, 3] >= 0]  # no score is between a half and 0.95 of a negative one
            # whole-number bounds of the band, as Python ints so that large scores don't overflow
            least = np.array([-(-low * int(s) // 100) for s in bands[:, 3]], np.int64)
            above = np.array([high * int(s) // 100 for s in bands[:, 3]], np.int64)
            for place in np.unique(bands[:, 1]):
                one = bands[:, 1] == place
                at, lo, hi = bands[one, 0], least[one], above[one]
                part = score[:, at]
                r, k = np.nonzero((part >= lo) & (part <= hi))
                k, r, s = _best((k, r, part[r, k]), ids, most)
                yield _arrow(mine[at[k]], np.full(len(k), place, np.int32), ids[r], s)

    return run


def _firsts(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Each key's first rows; Spark cuts each task's share to ``most`` before the shuffle."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _dealt(anchors: DataFrame, blocks: DataFrame, labels: str) -> DataFrame:
    """Each anchor block beside the candidate blocks of its own label, or of all others.  Only keys are paired before the payload joins."""
    keys = blocks.select("label", "block")
    mine = anchors.select("anchor_label", "anchor_block")
    on = F.col("anchor_label") == F.col("label") if labels == "own" else F.col("anchor_label") != F.col("label")
    # a row for each pair of blocks, a hundred bytes for half a million scores
    cells = keep(mine.join(keys, on) if labels == "own" else mine.crossJoin(keys).where(on))
    cells = cells.join(anchors.hint("merge"), ["anchor_label", "anchor_block"])
    return cells.join(blocks.hint("merge"), ["label", "block"])


def hard_negatives(vectors: DataFrame, anchor: Column, *, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = CANDIDATES, anchor_block: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), for each row where ``anchor`` holds.

    A row's score is the inner product of whole numbers, floor(scale * component).
    An anchor's positives are its first ``positives`` other rows of the same label;
    for each, the first ``negatives`` rows of other labels whose score is from
    ``low`` to ``high`` hundredths of the positive's are returned.  Higher scores come first, ties by smaller id.

    Rows with a null label or vector, or a null or non-finite component, take no
    part; null ids do, after all others among ties, but are no anchors.  Shorter vectors end in
    zeros, and empty ones score 0.  Repeated rows are rows of their own: each is
    an anchor if it qualifies, and the others are among its positives.  An empty
    table, or one without anchors, gives no rows.  Components beyond 64 bits are
    cut to the largest; scores beyond 64 bits wrap.  Other columns aren't read.
    """
    v = F.col(vector)
    rows = vectors.where(F.col(label).isNotNull() & usable(v)).select(
        F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("row")
    )
    rows = keep(rows)  # from here on a row's number is fixed
    sizes = keep(rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if("anchor").alias("a")))
    dealt = rows.join(sizes.hint("merge"), "label")
    place = lambda count, size: F.pmod(F.xxhash64("row"), F.ceil(F.col(count) / size))
    blocks = keep(dealt.withColumn("block", place("n", block)).select("label", "block", "id", "row", "vector").groupBy("label", "block").applyInPandas(_candidate_block, _BLOCK))
    asked = dealt.where("anchor and id is not null").withColumn("anchor_block", place("a", anchor_block)).withColumnRenamed("label", "anchor_label").select("anchor_label", "anchor_block", "id", "row", "vector")
    none = F.lit(None).cast("array<struct<place int, id long, score long>>")
    queries = lambda df: df.groupBy("anchor_label", "anchor_block").applyInPandas(_anchor_block, _QUERY)

    own = _dealt(keep(queries(asked.withColumn("positives", none))), blocks, "own").mapInArrow(_first_positives(positives), _FOUND)
    best = _firsts(own, ["row"], positives).select("row", F.struct(F.col("rank").alias("place"), F.coalesce("id", F.lit(int(_NO_ID))).alias("id"), "score").alias("p"))
    best = keep(best.groupBy("row").agg(F.sort_array(F.collect_list("p")).alias("positives")))  # ``positives`` at most for each anchor
    asked = keep(asked.join(best.hint("merge"), "row"))
    other = _dealt(keep(queries(asked)), blocks, "other").mapInArrow(_first_negatives(negatives, low, high), _FOUND)
    chosen = _firsts(other, ["row", "place"], negatives).withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
    known = asked.select("row", F.col("id").alias("anchor_id"), F.explode("positives").alias("p")).select("row", "anchor_id", "p.*")
    out = keep(chosen).join(keep(known).hint("merge"), ["row", "place"])
    return out.select("anchor_id", F.nullif("id", F.lit(int(_NO_ID))).alias("positive_id"), "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")
