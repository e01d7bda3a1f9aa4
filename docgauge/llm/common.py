"""Small helpers that the operators share."""

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words in every operator here.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only on one machine (tests) a new temporary folder is set where there is none; on a
    cluster, whose executors would not find it, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jsc.isDefined():
            folder = jsc.get()
        elif spark.sparkContext.master.startswith("local"):
            folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def give_back() -> None:
    """Return freed memory of a Python worker to the system, where its C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def by_position(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Columns renamed ``c0, c1, ...`` so that no name clashes, and the first place of each name."""
    names = [f"c{i}" for i in range(len(df.columns))]
    places: dict[str, str] = {}
    for name, place in zip(df.columns, names, strict=True):
        places.setdefault(name, place)
    return df.toDF(*names), places


def back(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns ``c0, c1, ...`` of df under their old names."""
    return df.select(*[f"c{i}" for i in range(len(columns))]).toDF(*columns)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the text, whatever else the table has."""
    df, places = by_position(docs)
    return df.select(F.col(places[id_col]).alias("doc_id"), F.col(places[text_col]).cast("string").alias("text"))


def id_type(docs: DataFrame, id_col: str = "doc_id") -> str:
    return next(f.dataType.simpleString() for f in docs.schema.fields if f.name == id_col)


def most_frequent(counts: DataFrame, count_col: str, limit: int) -> DataFrame:
    """The rows of the highest counts, ``limit`` at most; rows of one count class are in or out together.

    Classes are exact below 64 and eighths of a doubling above, so only a short
    histogram is gathered and no task sorts or holds all rows.
    """
    n = F.col(count_col)
    grade = F.when(n < 64, n).otherwise(64 + F.floor(8 * F.log2(n / 64))).cast("long")
    total, least = 0, None
    for row in sorted(counts.groupBy(grade.alias("g")).count().collect(), reverse=True):
        total += row[1]
        if total > limit:
            break
        least = row[0]
    return counts.where(F.lit(False) if least is None else grade >= least)
