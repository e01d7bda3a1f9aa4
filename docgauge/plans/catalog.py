"""Registry of the runnable queries and the SQL each must agree with."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` with its equivalent SQL."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            # count_if sums to a wider integer and is NULL without rows
            ORACLES[name] = sql.replace("count_if(", "count(*) FILTER (WHERE ")
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
