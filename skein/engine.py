"""Facade: one object over a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import recommend as R
from .plans import catalogue
from .plans.tables import listings, table


def session(master: str = "local[*]", **config: str) -> SparkSession:
    """A session with adaptive execution, and UTC; config overrides."""
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"} | config
    builder = SparkSession.builder.master(master).appName("skein")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


class Engine:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def query(self, name: str) -> DataFrame:
        return catalogue.queries()[name](self.spark, self.folder)

    def recommend(self, budget: float, **search) -> DataFrame:
        return R.recommend(R.with_typical_price(listings(self.spark, self.folder)), R.Search(budget=budget, **search))
