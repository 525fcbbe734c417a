"""Registry of the runnable queries: Spark plan and, where SQL can say it, the same result in ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: A session may name a number of partitions here, so that test tables of one row group use all cores; clusters leave it unset.
SPREAD_SETTING = "spark.veilspan.spread"
#: Rows of a part of a table that texts are rendered from.
DEALT_ROWS = 10_000
TEXT_TABLES = {"documents", "pages", "conversations", "orders", "customer"}


class Tables:
    """Lazy access to the parquet tables of one folder and to the views rendered from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        """One table, read as it is cut."""
        rows = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        spread = self.spark.conf.get(SPREAD_SETTING, None)
        return rows.repartition(int(spread)) if spread and name in TEXT_TABLES else rows

    def dealt(self, name: str) -> DataFrame:
        """A table of numbers that texts are rendered from, dealt out so that no task renders more than about
        ``DEALT_ROWS`` texts, however few parts the file is cut into. Only the columns in use travel, no text."""
        return self.table(name).repartition(self.parts(name))

    def parts(self, name: str) -> int:
        """How many parts that takes, counted from the file's footers."""
        return max(1, -(-self.spark.read.parquet(f"{self.folder}/{name}.parquet").count() // DEALT_ROWS))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(text, **frames)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under an operator id."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
