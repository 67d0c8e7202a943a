"""Shards that all hold the mixture of sources, by proportional stratified interleaving.

Within each source, rows are put in the order of a seeded hash, and row r of n
gets the fractional rank (r - 1/2) / n.  All rows, sorted by that fraction, are
cut into stretches whose counts differ by one at most, so a source's share of a
shard differs from its share of the whole by less than two rows.  Both ranks
are counts of earlier buckets plus a row number inside a bucket, so neither a
source with a third of all rows nor the sort over all rows is one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import keep

#: Rows of a bucket that are aimed at, and the most buckets of a source or of the whole; beyond it buckets get larger.
#: So a table with a row for each bucket of the whole has at most ``MOST`` rows, which is what may be broadcast.
BUCKET, MOST = 64, 65_536


def _earlier(counts: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Adds before, the rows of the key's earlier buckets, and total, the key's rows."""
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = F.sum("n").over(w.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1))
    return counts.select(*keys, bucket, F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(w).alias("total"))


def _utf8(text: str) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def assign(docs: DataFrame, shards: int = 24, *, seed: int = 0, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, row, copy, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs`` (doc_id, text, source, ...).

    The law is ``rows``: shards' counts are at most one apart; grown_shard is
    null, as a shard more would move rows between all of them.  Slots of a
    shard are gapless from 0, in the order of the fractional ranks.  size is the
    text's UTF-8 bytes and 8.  ``row`` is the hash of the text and ``copy``
    numbers equal (doc_id, text, source), so that write_shards can find each row.

    A null text is empty, a null source is a source of its own, and null doc_ids are
    ids like any other.  Rows of equal text, repeated rows too, are each placed by
    their own order; equal rows can't be told apart, and take neighbouring places.
    An empty table gives no rows, fewer rows than shards leave shards empty, and
    other columns of ``docs``, whatever their names, aren't read.
    """
    raw = _utf8("text")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.crc32(raw).cast("string")))
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("row"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), order.alias("_h"))
    rows = rows.withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))  # one join key, null or not
    # from here on texts are gone: two narrow copies, each dealt once by a key of small groups
    rows = keep(rows)
    n = rows.count()
    buckets = max(1, min(MOST, n // bucket))
    rows = rows.withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * buckets / 2**32))
    within = W.partitionBy("_s", "_b").orderBy("_h", "doc_id", "text_crc32", "row", "size")
    offsets = _earlier(rows.groupBy("_s", "_b").agg(F.count("*").alias("n")), ["_s"], "_b")
    ranked = rows.withColumn("_r", F.row_number().over(within)).join(offsets.hint("merge"), ["_s", "_b"])
    rank = (F.col("before") + F.col("_r")).cast("double")
    ranked = ranked.withColumn("_f", (rank - 0.5) / F.col("total")).withColumn("copy", F.row_number().over(W.partitionBy("_s", "_b", "_h", "doc_id", "row").orderBy("_r")))
    ranked = keep(ranked.withColumn("_c", F.floor(F.col("_f") * buckets)).drop("_s", "_b", "before", "total", "_r"))
    placed = F.broadcast(_earlier(ranked.groupBy("_c").agg(F.count("*").alias("n")), [], "_c"))
    inside = F.row_number().over(W.partitionBy("_c").orderBy("_f", "_h", "source", "doc_id", "row", "copy"))
    out = ranked.withColumn("_p", inside).join(placed, "_c").withColumn("_p", F.col("before") + F.col("_p") - 1)
    shard = F.expr(f"_p * {shards} div total").cast("int")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    out = out.withColumn("shard", shard)
    return out.select("doc_id", "source", "row", "copy", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_p") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, *, seed: int = 0, rows_per_file: int = 100_000) -> DataFrame:
    """Writes every row of ``docs`` to the folder of its shard, in files of ``rows_per_file`` rows in the order of their slots.

    Texts are dealt twice: once to meet their places, once to their files.
    Each file is a task's work, so a shard isn't.  Columns of docs named like
    those of ``assign``, but for doc_id, text and source, are replaced.  Returns the placement.
    """
    placed = keep(assign(docs, shards, seed=seed))
    own = [c for c in docs.columns if c in ("doc_id", "source") or c not in placed.columns]
    rows = docs.select(*own).withColumn("row", F.xxhash64("text"))
    rows = rows.withColumn("copy", F.row_number().over(W.partitionBy("doc_id", "row", "source").orderBy("row")))
    places = placed.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("row").alias("_r"), F.col("copy").alias("_c"), "shard", "slot").hint("merge")
    met = rows.join(places, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("row") == F.col("_r")) & (F.col("copy") == F.col("_c")))
    met = met.withColumn("_file", F.floor(F.col("slot") / rows_per_file)).repartition("shard", "_file").sortWithinPartitions("shard", "slot")
    met.drop("_d", "_s", "_r", "_c", "_file", "row", "copy").write.partitionBy("shard").mode("overwrite").parquet(path)
    return placed
