"""Pages of a sorted table by position and by key.

A table is ranged by its whole sort key and written in order, one folder for each range;
a small table of bounds keeps how many rows come before a range and its last key. A page
is then found in the bounds, and only the ranges that hold its rows are opened, so page a
million costs what page one does.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgauge.operators.serving import PAGE_SIZE
from docgauge.sources.sinks import staged

#: The whole key: what the caller sorts by, and then what tells any two issues apart.
UNIQUE = ["doc_id", "pos"]
_LOW_BITS = (1 << 33) - 1


def write_pages(issues: DataFrame, folder: str, filters: dict[str, str] | None = None, sort: list[str] | None = None) -> None:
    """Write the filtered issues in order, with their bounds.

    They are written once as they come: ranging looks at its input twice, and would score it twice.
    """
    kept = reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), (filters or {}).items(), issues)
    order = [*(sort or ["severity", "issue_type"]), *UNIQUE]
    with staged(kept, f"{folder}/found") as found:
        _write_ranges(found, folder, order)


def _write_ranges(found: DataFrame, folder: str, order: list[str]) -> None:
    ranged = found.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS)).alias("seq"))
    ranged.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/rows")
    spark, key = found.sparkSession, F.struct(*order)
    spark.createDataFrame([], ranged.schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/columns")  # for a table without rows
    rows = spark.read.schema(ranged.schema).parquet(f"{folder}/rows")
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max_by(key, "seq").alias("last"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    bounds = sizes.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    bounds.coalesce(1).write.mode("overwrite").parquet(f"{folder}/bounds")


def _rows(spark: SparkSession, folder: str, bounds: DataFrame, shown: Column) -> DataFrame:
    """The rows of the chosen ranges with their place in the whole order."""
    chosen = [(r["part"], r["first"]) for r in bounds.where(shown).select("part", "first").collect()]  # a few ranges
    rows = spark.read.schema(spark.read.parquet(f"{folder}/columns").schema).parquet(f"{folder}/rows")
    if not chosen:
        return rows.where("false").withColumn("place", F.lit(0).cast("long"))
    first = F.coalesce(*[F.when(F.col("part") == p, F.lit(f)) for p, f in chosen])
    return rows.where(F.col("part").isin([p for p, _ in chosen])).withColumn("place", first + F.col("seq"))


def page(spark: SparkSession, folder: str, number: int, page_size: int = PAGE_SIZE) -> DataFrame:
    """Page ``number`` (from 0) in order; empty beyond the last one."""
    low, high = number * page_size, (number + 1) * page_size
    bounds = spark.read.parquet(f"{folder}/bounds")
    rows = _rows(spark, folder, bounds, (F.col("first") < high) & (F.col("first") + F.col("n") > low))
    return rows.where((F.col("place") >= low) & (F.col("place") < high)).orderBy("place").drop("part", "seq", "place")


def page_after(spark: SparkSession, folder: str, key: dict, page_size: int = PAGE_SIZE) -> DataFrame:
    """The rows that follow the row with this key (sort columns, doc_id and pos by name)."""
    bounds = spark.read.parquet(f"{folder}/bounds")
    names = bounds.schema["last"].dataType.names
    last = F.struct(*[F.lit(key[n]).cast(bounds.schema["last"].dataType[n].dataType).alias(n) for n in names])
    # the range that holds the next row; rows missing at its end are in the ranges after it
    after = bounds.where(F.col("last") > last).orderBy("first")
    begin = after.select("first", "n").first()
    if begin is None:
        return _rows(spark, folder, bounds, F.lit(False)).drop("part", "seq", "place")
    rows = _rows(spark, folder, bounds, (F.col("first") >= begin["first"]) & (F.col("first") < begin["first"] + begin["n"] + page_size))
    return rows.where(F.struct(*names) > last).orderBy("place").limit(page_size).drop("part", "seq", "place")
