"""Evaluation sink: evaluations, their issues and rejected files, by batch, committed together.

Each attempt at a batch writes its three tables to folders of its own and then creates one
empty file whose name says which attempt holds the batch. Readers look at these names
only, so a batch changes from one attempt to the next at once, for all tables, and a write
broken off anywhere leaves the earlier attempt as it was. Batch ids are text. Names number
one per batch and attempt; ``vacuum`` removes what no reader sees any more.

Evaluations are clustered by a hash of their id: a lookup opens the files of one bucket of
each batch, and Parquet bloom filters on the id skip the row groups without it. An evaluation
is many times its document, so large batches deal out the documents (``dealt``).
"""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgauge.operators.serving import issues_of

#: Buckets of ids in a batch; large buckets are split over several files.
BUCKETS = 64
TABLES = ("evaluations", "issues", "rejected")
#: A filter grows with the ids of its row group; by default each takes a megabyte.
STORED = {"compression": "zstd", "parquet.bloom.filter.adaptive.enabled": "true"}
REJECTED = "path string, filename string, size long, reason string"


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it wants it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _folder(root: str, table: str, batch: str, attempt: str) -> str:
    return f"{root}/{table}/batch_id={batch}/attempt={attempt}"


def bucket_of(doc_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


def dealt(documents: DataFrame, doc_id: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """Documents dealt to tasks by the bucket of their id: at least as many tasks as a shuffle has, each with one bucket.

    For ``write_batch`` of their evaluations. The order by bucket changes nothing within a task;
    it tells the writer that it need not sort the evaluations.
    """
    bucket = bucket_of(F.col(doc_id), buckets)
    each = -(-int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets)
    task = bucket * each + F.pmod(F.hash(doc_id), F.lit(each))
    return documents.repartitionById(buckets * each, task).sortWithinPartitions(bucket)


def _placed(evaluations: DataFrame, buckets: int, by_bucket: bool) -> DataFrame:
    """Evaluations with their bucket, one bucket to a task."""
    placed = evaluations.withColumn("id_bucket", bucket_of(F.col("doc_id"), buckets))
    return placed if by_bucket else placed.hint("rebalance", "id_bucket")


def _commits(spark: SparkSession, root: str) -> dict[str, tuple[str, str, int]]:
    """Newest (sequence, attempt, buckets) of each batch, batches as they stand in folder names."""
    store, path = _files(spark, f"{root}/_commits/*/*")
    found: dict[str, tuple[str, str, int]] = {}
    for status in store.globStatus(path) or []:
        name = status.getPath().getName()
        if name.startswith("."):
            continue
        sequence, attempt, buckets = name.split("-")
        batch = status.getPath().getParent().getName().removeprefix("batch_id=")
        found[batch] = max(found.get(batch, ("", "", 0)), (sequence, attempt, int(buckets)))
    return found


def _commit(spark: SparkSession, root: str, batch: str, attempt: str, buckets: int) -> None:
    sequence = int(_commits(spark, root).get(batch, ("0",))[0]) + 1
    folder = f"{root}/_commits/batch_id={batch}"
    store, hidden = _files(spark, f"{folder}/.{attempt}")
    store.create(hidden, True).close()
    if not store.rename(hidden, _files(spark, f"{folder}/{sequence:010d}-{attempt}-{buckets}")[1]):
        raise OSError(f"batch {unquote(batch)} could not be committed")


@contextmanager
def staged(rows: DataFrame, folder: str) -> Iterator[DataFrame]:
    """The rows written once and read back, as long as the context lasts."""
    spark = rows.sparkSession
    rows.write.parquet(folder)
    try:
        yield spark.read.schema(rows.schema).parquet(folder)
    finally:
        store, path = _files(spark, folder)
        store.delete(path, True)


def write_batch(evaluations: DataFrame, root: str, batch_id, rejected: DataFrame | None = None, buckets: int = BUCKETS,
                by_bucket: bool = False) -> None:
    """Write one batch in place of its earlier attempts.

    Issues are read back from the written evaluations, so scores are computed once. All
    batches of a root have as many buckets as the first. ``by_bucket`` says that the
    documents were ``dealt``; else the evaluations are shuffled.
    """
    spark = evaluations.sparkSession
    batch, attempt = quote(str(batch_id), safe=""), uuid.uuid4().hex
    buckets = next((c[2] for c in _commits(spark, root).values()), buckets)
    folder = {t: _folder(root, t, batch, attempt) for t in TABLES}
    placed = _placed(evaluations, buckets, by_bucket).write.options(**STORED).partitionBy("id_bucket")
    placed.option("parquet.bloom.filter.enabled#doc_id", "true").parquet(folder["evaluations"])
    stored = spark.read.schema(evaluations.schema).parquet(folder["evaluations"])
    issues_of(stored).write.options(**STORED).parquet(folder["issues"])
    rejected = spark.createDataFrame([], REJECTED) if rejected is None else rejected
    rejected.write.parquet(folder["rejected"])
    _commit(spark, root, batch, attempt, buckets)


def write_evaluations(evaluations: DataFrame, root: str, batch_id) -> None:
    """A batch without rejected files."""
    write_batch(evaluations, root, batch_id)


def _read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The committed batches of a table, the batch id as text ("007" is not 7)."""
    folders = [_folder(root, table, batch, attempt) for batch, (_, attempt, _) in _commits(spark, root).items()]
    if not folders:
        raise FileNotFoundError(f"no batch in {root}")
    of_base = spark.read.option("basePath", f"{root}/{table}")
    text = {"batch_id", "attempt"}
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in text else f for f in of_base.parquet(folders[0]).schema])
    return spark.read.option("basePath", f"{root}/{table}").schema(schema).parquet(*folders).drop("attempt")


def read_evaluations(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, "evaluations").drop("id_bucket")


def read_issues(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, "issues")


def read_rejected(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, "rejected")


def lookup(spark: SparkSession, root: str, doc_id) -> DataFrame:
    """The stored evaluations of one document, from the files of its bucket alone; nothing is evaluated."""
    stored = _read(spark, root, "evaluations")
    buckets = next(c[2] for c in _commits(spark, root).values())
    wanted = F.lit(doc_id).cast(stored.schema["doc_id"].dataType)
    return stored.where((F.col("id_bucket") == bucket_of(wanted, buckets)) & (F.col("doc_id") == wanted)).drop("id_bucket")


def vacuum(spark: SparkSession, root: str) -> int:
    """Removes the attempts that are not committed or were replaced; returns their number. Run it while nothing writes."""
    current, removed = {(b, c[1]) for b, c in _commits(spark, root).items()}, 0
    for table in TABLES:
        store, path = _files(spark, f"{root}/{table}/*/*")
        for status in store.globStatus(path) or []:
            batch, attempt = status.getPath().getParent().getName(), status.getPath().getName()
            if (batch.removeprefix("batch_id="), attempt.removeprefix("attempt=")) not in current:
                store.delete(status.getPath(), True)
                removed += 1
    return removed
