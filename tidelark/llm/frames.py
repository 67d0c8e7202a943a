"""What the operators share: reading tables, keeping intermediate results, groups of linked rows."""

from __future__ import annotations

import contextlib
import contextvars
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of the copies made inside the innermost ``temporary``.
_copies: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("copies", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # a union that keeps its sides' partitioning splits a key where the sides were coalesced differently at run time
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return modest_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode, as in tests, the warehouse where that is unset.

    On a cluster an unset folder is an error: a driver's own one would not be seen by the executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.startswith("local"):
        named = spark.conf.get("spark.sql.warehouse.dir")
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named


def keep(df: DataFrame, *, of: list[str] | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    The copy cuts the lineage, survives a lost executor and has a true size.
    Its path is appended to ``of``; without that, an enclosing ``temporary``
    deletes it.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tidelark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    of = _copies.get() if of is None else of
    if of is not None:
        of.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a copy that keep() made and nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Copies that operators keep inside are deleted at the end, so what they return has to be written before that."""
    paths: list[str] = []
    token = _copies.set(paths)
    try:
        yield
    finally:
        _copies.reset(token)
        for path in paths:
            discard(spark, path)


def sampled(docs: DataFrame, rows: int) -> DataFrame:
    """docs with ``sample``: true for about ``rows`` of its rows, all of a smaller table.

    Those are the rows whose hashed doc_id is below a share of its range, so
    the choice is the same in every run, and nothing is sorted or sent to the
    driver to make it.
    """
    n = docs.count()
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    return docs.withColumn("sample", place < F.lit(int((1 << 63) * (rows / n)))) if n > rows else docs.withColumn("sample", F.lit(True))


def modest_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches that leave room beside the heap even with very long texts; a user's own settings stay."""
    for key, default, ours in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", "67108864b", "16m")):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key) == default:
            spark.conf.set(key, ours)
    return spark


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node u has a single edge to a v that has none itself; v is less than u."""
    roles = edges.select(F.col("u").alias("node"), F.lit(1).alias("leaves"), F.lit(0).alias("enters")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("leaves"), F.lit(1).alias("enters")))
    return roles.groupBy("node").agg(F.sum("leaves").alias("leaves"), F.max("enters").alias("enters")).where("leaves > 1 or leaves = 1 and enters = 1").isEmpty()


def linked_groups(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) of every node that an edge touches; root is the least node of its group.

    Alternates two local steps until every edge leads from a node to its
    group's least one: every node's greater neighbours go to its least
    neighbour, then its lesser ones do.  An edge
    set is never larger than the one before, and is kept in the shared folder.
    """
    paths: list[str] = []
    now = keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), of=paths)
    for _ in range(rounds):
        if _all_stars(now):
            break
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        extra: list[str] = []  # as tables, so that Spark can split a hot node's rows in the joins
        least = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), of=extra)
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = keep(large, of=extra)
        low = keep(large.groupBy("u").agg(F.min("v").alias("m")), of=extra)
        small = large.join(low.hint("merge"), "u").select("u", "v", "m")
        now = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = keep(now, of=paths)
        for path in (paths.pop(0), *extra):
            discard(now.sparkSession, path)
    else:
        raise RuntimeError(f"groups not found in {rounds} rounds")
    if (outer := _copies.get()) is not None:
        outer += paths
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
