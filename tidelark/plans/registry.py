"""All registered queries of the sensor-event operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelark.operators import occupancy
from tidelark.plans import aggregate_queries, join_queries, pattern_queries, projection_queries, ranking_queries, scan_queries, scoring_queries, stream_queries, window_queries  # noqa: F401
from tidelark.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
from tidelark.sources import fixtures


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied minutes and mean stay per room and day, from raw events."""
    stays = occupancy.presence_periods(fixtures.sensor_events(spark, sf_dir))
    day = F.date_trunc("day", "start_ts").cast("date").alias("day")
    return stays.groupBy("room", day).agg(F.count("*").alias("stays"), F.round(F.sum("duration_min"), 6).alias("occupied_min"), F.round(F.avg("duration_min"), 6).alias("mean_stay_min"))
