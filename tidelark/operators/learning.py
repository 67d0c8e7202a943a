"""Classifiers per horizon on MLlib, their search, refits and registry."""

from __future__ import annotations

import datetime as dt
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelark.functions import enrich
from tidelark.operators import movement, occupancy, temporal
from tidelark.operators.rollups import within
from tidelark.sources.tables import discard, kept

NUMERIC = ["hour", "day_of_week", "minute_of_day", "is_weekend", "is_morning", "is_afternoon", "is_evening", "is_night", "hour_sin", "hour_cos", "day_sin", "day_cos", "hour_x_day", "state_x_hour", "active", "delta_s", "room_30m", "type_30m", "concurrent", "cross_room", "is_full_zone", "is_subzone", "coverage"]


def feature_vector(events: DataFrame) -> DataFrame:
    """The flat features of every event, without nulls."""
    out = temporal.lagged(events, ["entity_id"], "ts", [1])
    out = out.withColumn("delta_s", temporal.seconds_between("ts", "ts_lag_1")).drop("ts_lag_1")
    out = temporal.nearby(out, 1800, 0, {"room_30m": temporal.Counted(keys=("room",)), "type_30m": temporal.Counted(keys=("sensor_type",))})
    out = movement.concurrent_counts(out)
    out = out.join(movement.zone_coverage(events), "room", "left")
    zone = {"is_full_zone": (F.col("zone_type") == "full").cast("int"), "is_subzone": (F.col("zone_type") == "subzone").cast("int")}
    out = out.withColumns({**enrich.calendar(), **enrich.cyclical(), **enrich.interactions(), "active": enrich.is_active(), **zone})
    return out.select("event_id", "ts", "room", "sensor_type", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in NUMERIC])


def labelled(events: DataFrame, occupancy_rows: DataFrame, horizons: list[int]) -> DataFrame:
    """Features and label of each event and horizon whose outcome is known.

    They are written to the shared folder once, as every pass of a fit and every scoring reads them.
    """
    labels = occupancy.horizon_labels(events, occupancy_rows, horizons).where("label is not null")
    return kept(feature_vector(events).join(labels.hint("merge"), "event_id").withColumn("label", F.col("label").cast("double")))


def pipeline(kind: str, **params) -> Pipeline:
    models = {
        "forest": lambda: RandomForestClassifier(numTrees=10, featureSubsetStrategy="sqrt", seed=1),
        "tree": lambda: DecisionTreeClassifier(seed=1),
        "logistic": lambda: LogisticRegression(regParam=0.1),
    }
    model = models[kind]().setParams(featuresCol="features", labelCol="label", **params)
    index = StringIndexer(inputCols=["room", "sensor_type"], outputCols=["room_i", "type_i"], handleInvalid="keep")
    gather = VectorAssembler(inputCols=[*NUMERIC, "room_i", "type_i"], outputCol="raw")
    return Pipeline(stages=[index, gather, StandardScaler(inputCol="raw", outputCol="features"), model])


def fit_ensemble(train: DataFrame, kinds=("forest", "tree", "logistic")) -> dict[str, PipelineModel]:
    return {k: pipeline(k).fit(train) for k in kinds}


def score(models: dict[str, PipelineModel], rows: DataFrame) -> DataFrame:
    """Long form: one probability of each model for each row."""
    out = None
    keep = [c for c in ("event_id", "ts", "room", "horizon_minutes", "label") if c in rows.columns]
    for name, model in models.items():
        p = model.transform(rows).select(*keep, F.lit(name).alias("model_name"), vector_to_array("probability")[1].alias("p"))
        out = p if out is None else out.unionByName(p)
    return out


def split_by_time(rows: DataFrame, share: float = 0.75, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Earlier and later rows, so that no model is judged on what precedes its training."""
    first, last = rows.agg(F.min(temporal.micros(ts)), F.max(temporal.micros(ts))).first()
    cut = int((first or 0) + share * ((last or 0) - (first or 0)))
    return rows.where(temporal.micros(ts) <= cut), rows.where(temporal.micros(ts) > cut)


def accuracy(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(F.avg(((F.col("p") > 0.5) == (F.col("label") > 0.5)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def needs_retraining(results: DataFrame, as_of: Column, least: float = 0.6, more_than: int = 100) -> DataFrame:
    """Rooms with over ``more_than`` rows in 7 days whose last day's accuracy is under ``least``."""
    day = F.when(F.col("ts") > as_of - F.make_dt_interval(days=F.lit(1)), F.col("accuracy_score"))
    out = within(results, as_of, 7).groupBy("room").agg(F.count("*").alias("n"), F.avg(day).alias("accuracy"))
    return out.where((F.col("n") > more_than) & (F.col("accuracy") < least))


# fixed values: the settings that are searched
FOREST_TREES = (5, 10, 15)
FOREST_FEATURES = ("sqrt", "log2", "all")
TREE_ROWS = (100, 200, 500)
L2 = (0.001, 0.01, 0.1, 1.0)
L1 = (0.0, 0.001, 0.01, 0.1)
#: All combinations; a tree's least rows of a leaf stand for the rows that an online one waits for before a split.
GRID = {
    "forest": [{"numTrees": n, "featureSubsetStrategy": f} for n in FOREST_TREES for f in FOREST_FEATURES],
    "tree": [{"minInstancesPerNode": n} for n in TREE_ROWS],
    "logistic": [{"regParam": a + b, "elasticNetParam": b / (a + b)} for a in L2 for b in L1],
}


def search(rows: DataFrame, grid=None, parallelism: int = 4) -> DataFrame:
    """Validated accuracy and fit time of every configuration, on a split by time.

    ``parallelism`` configurations are fitted at once, so a fit time includes
    what the others took of the cluster.
    """
    train, test = (x.persist() for x in split_by_time(rows))

    def tried(kind: str, params: dict) -> tuple:
        began = time.monotonic()
        model = pipeline(kind, **params).fit(train)
        cost = time.monotonic() - began
        got = accuracy(score({kind: model}, test), ["model_name"]).first()
        return kind, ",".join(f"{k}={v}" for k, v in sorted(params.items())), float(got.accuracy) if got else None, cost

    with ThreadPoolExecutor(parallelism) as pool:
        runs = [pool.submit(inheritable_thread_target(rows.sparkSession)(tried), kind, params) for kind, settings in (grid or GRID).items() for params in settings]
        out = [run.result() for run in runs]
    train.unpersist()
    test.unpersist()
    return rows.sparkSession.createDataFrame(out, "model_type string, params string, perf double, cost double")


def model_path(folder: str, model_type: str, created_at: dt.datetime) -> str:
    """Where a fitted pipeline is kept: one for all rooms that were fitted together, named after its kind and time."""
    return f"{folder.rstrip('/')}/{model_type}/{created_at:%Y%m%dT%H%M%S}"


def refit(rows: DataFrame, results: DataFrame, registry: DataFrame, as_of: dt.datetime, folder: str, kind: str = "forest", least: float = 0.6, more_than: int = 100) -> DataFrame:
    """The registry after a refit of the rooms that ``needs_retraining`` opens.

    ``rows`` are labelled; those of the last 7 days train one pipeline, which
    is saved in ``folder`` (one that driver and executors share) and registered
    for each of these rooms that has rows, with their number as its metrics and
    their first and last time as its train range.
    Without such rows nothing is fitted or added.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    due = needs_retraining(results, now, least, more_than).select("room")
    recent = within(rows, now, 7).join(due, "room", "left_semi").persist()
    entry = recent.groupBy("room").agg(F.count("*").cast("double").alias("metrics"), F.min("ts").alias("train_start"), F.max("ts").alias("train_end"))
    entry = entry.select("room", F.lit(kind).alias("model_type"), "metrics", now.alias("created_at"), "train_start", "train_end")
    if not recent.isEmpty():
        pipeline(kind).fit(recent).write().overwrite().save(model_path(folder, kind, as_of))
    return register(registry, entry)


def load_active(registry: DataFrame, folder: str, room: str, model_type: str) -> PipelineModel:
    """The pipeline of the registry's active version."""
    active = registry.where((F.col("room") == room) & (F.col("model_type") == model_type) & F.col("is_active")).select("created_at").first()
    if active is None:
        raise LookupError(f"no active {model_type} model for {room}")
    return PipelineModel.load(model_path(folder, model_type, active.created_at))


def register(registry: DataFrame, entry: DataFrame) -> DataFrame:
    """Appends entries (room, model_type, metrics, created_at) with the next version of each and makes them the active ones.

    train_start and train_end are null where entries or the registry don't have them.
    """
    ranged = lambda df: df.withColumns({c: F.lit(None).cast("timestamp_ntz") for c in ("train_start", "train_end") if c not in df.columns})
    newest = registry.groupBy("room", "model_type").agg(F.max("version").alias("_v"))
    w = W.partitionBy("room", "model_type").orderBy("created_at")
    added = ranged(entry).join(newest, ["room", "model_type"], "left").withColumn("version", (F.coalesce("_v", F.lit(0)) + F.row_number().over(w)).cast("long"))
    added = added.withColumn("parent", F.when(F.col("version") > 1, F.concat_ws("_", "room", "model_type", F.concat(F.lit("v"), (F.col("version") - 1).cast("string")))))
    added = added.select(F.concat_ws("_", "room", "model_type", F.concat(F.lit("v"), F.col("version").cast("string"))).alias("model_id"), "room", "model_type", "version", "parent", "metrics", "created_at", "train_start", "train_end")
    both = ranged(registry).select(*added.columns).unionByName(added)
    return both.withColumn("is_active", F.col("version") == F.max("version").over(W.partitionBy("room", "model_type")))


def newest_versions(registry: DataFrame, most: int = 10) -> DataFrame:
    """The ``most`` newest versions of each room and model type."""
    w = W.partitionBy("room", "model_type").orderBy(F.desc("version"))
    return registry.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= most).drop("_i")


def prune(registry: DataFrame, folder: str, most: int = 10) -> DataFrame:
    """The registry without versions beyond the ``most`` newest; pipelines that no row is left of are deleted.

    Rooms that were fitted together share a pipeline: it stays as long as one of them is kept.
    """
    left = kept(newest_versions(registry, most))
    fitted = lambda df: df.select("model_type", "created_at").distinct()
    for r in fitted(registry).join(fitted(left).hint("merge"), ["model_type", "created_at"], "left_anti").toLocalIterator():
        discard(registry.sparkSession, model_path(folder, r.model_type, r.created_at))
    return left
