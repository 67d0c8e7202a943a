"""Latest rows, top-k, best choices and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The newest row of each key, by a combined aggregate instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_r")).select(*keys, "_r.*")


def top(df: DataFrame, keys: list[str], by: list[Column], n: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*by)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def prune_least(importances: DataFrame, share: float = 0.2, more_than: int = 25, score: str = "importance", name: str = "feature") -> DataFrame:
    """Adds pruned: the lowest share of all rows, once there are over ``more_than``."""
    n = importances.count()
    cut = int(n * share) if n > more_than else 0
    lowest = importances.orderBy(score, name).limit(cut).select(name, F.lit(True).alias("pruned"))
    return importances.join(lowest, name, "left").na.fill(False, ["pruned"])


def select_features(features: DataFrame, ranks: DataFrame, most: int) -> DataFrame:
    """Ranked features first, then the others by name, up to ``most``."""
    return features.join(ranks, "feature", "left").orderBy(F.asc_nulls_last("rank"), "feature").limit(most)


def best_candidates(candidates: DataFrame, keys: list[str]) -> DataFrame:
    score = 0.6 * F.col("perf") + 0.2 / F.col("cost") + 0.2 / F.col("complexity")
    scored = candidates.withColumn("score", score)
    rest = [c for c in scored.columns if c not in keys]
    return scored.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("score", "model_type")).alias("_r")).select(*keys, "_r.*")


#: Weights of horizons by what they are good for.
UTILITY = {15: 1.5, 30: 1.2, 60: 1.0, 120: 1.5, 180: 1.0}


def useful_horizons(accuracy: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    weight = F.create_map(*[x for h, w in UTILITY.items() for x in (F.lit(h), F.lit(w))])
    scored = accuracy.withColumn("utility", F.col("accuracy") * F.try_element_at(weight, F.col("horizon_minutes").cast("int"))).where("utility is not null")
    return top(scored, keys, [F.desc("utility"), F.col("horizon_minutes")], most)


def registry_versions(registry: DataFrame, most: int = 5) -> DataFrame:
    """Adds is_latest (the newest active version of a room) and expired (beyond ``most`` versions of a room and type)."""
    by_type = W.partitionBy("room", "model_type").orderBy(F.desc("version"))
    newest = F.max(F.when(F.col("is_active"), F.struct("version", "model_type"))).over(W.partitionBy("room"))
    mine = F.struct("version", "model_type")
    return registry.withColumn("expired", F.row_number().over(by_type) > most).withColumn("is_latest", F.coalesce(F.col("is_active") & (mine == newest), F.lit(False)))
