"""How queries are registered: a function over the fixture views and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelark.sources import fixtures

#: Queries that need a clock take this one, within the events' month.
AS_OF = "2024-01-29 12:00:00"
#: A date from which nearly all events count as recent.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


@dataclass
class Views:
    """Lazily built views of one data folder."""

    spark: SparkSession
    sf_dir: str

    def __post_init__(self) -> None:
        # a union that keeps its sides' partitioning fails where the sides were coalesced differently at run time
        self.spark.conf.set("spark.sql.unionOutputPartitioning", "false")

    @cached_property
    def se(self) -> DataFrame:
        return fixtures.sensor_events(self.spark, self.sf_dir)

    @cached_property
    def oc(self) -> DataFrame:
        return fixtures.room_occupancy(self.se)

    @cached_property
    def pr(self) -> DataFrame:
        return fixtures.predictions(self.se)

    @cached_property
    def res(self) -> DataFrame:
        return fixtures.prediction_results(self.pr)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register f(views) under ``name``; sql follows the views' WITH clause."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = f"WITH RECURSIVE {fixtures.VIEWS}\n{sql.strip()}"
        return f

    return put


def when_is(stamp: str = AS_OF) -> Column:
    return F.lit(stamp).cast("timestamp_ntz")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
