"""Readers: files to the common document columns.

One whole-text scan covers every text format; the extension decides, per row,
how text is extracted. Every file has one outcome: accepted, or rejected with
its reason; none is lost.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge import rules
from docgauge.functions import text as X
from docgauge.operators.records import with_flat_text

FILE_SCHEMA = "value string"
#: Extensions whose text is extracted here; the other supported ones need text or tokens as input.
TEXT_EXTENSIONS = (".txt", ".csv", ".json", ".xml", ".html", ".htm", ".eml")


def is_supported(path: Column) -> Column:
    return X.extension(path).isin(rules.SUPPORTED_EXTENSIONS)


def fits(size: Column, limit: int | None = rules.MAX_FILE_BYTES) -> Column:
    return F.lit(True) if limit is None else size <= limit


def csv_row_text(line: Column) -> Column:
    """Cells of one delimited line joined by a space (quotes removed)."""
    return csv_to_text(line)


# a quoted cell may hold commas, line feeds and doubled quotes; quotes inside a bare cell are plain characters
_QUOTED = r'"([^"]*+(?:""[^"]*+)*+)"?'
_CELL = rf'\G(?!(?<!,)\z)(?:{_QUOTED}[^,\n]*+|[^,\n]*+)(?:[,\n]|\z)'


def csv_to_text(raw: Column) -> Column:
    """Rows as lines, cells joined by a space, quotes removed; a quoted cell may span lines."""

    def plain(cell: Column) -> Column:
        end = F.right(cell, F.lit(1))
        body = F.regexp_replace(cell, r"[,\n]\z", "")
        quoted = F.concat(
            F.replace(F.regexp_extract(body, rf"(?s)\A{_QUOTED}", 1), F.lit('""'), F.lit('"')),
            F.regexp_extract(body, rf"(?s)\A{_QUOTED}(.*)\z", 2))
        return F.concat(
            F.when(body.startswith('"'), quoted).otherwise(body),
            F.when(end == ",", " ").when(end == "\n", "\n").otherwise(""))

    cells = F.regexp_extract_all(F.regexp_replace(raw, r"\r\n?", "\n"), F.lit(_CELL), F.lit(0))
    return F.array_join(F.transform(cells, plain), "")


def with_text(df: DataFrame, raw: str = "raw", ext: str = "ext") -> DataFrame:
    """Add the extracted (not yet normalized) text; NULL when it cannot be read."""
    content, kind = F.col(raw), F.col(ext)
    flat = with_flat_text(df, raw, "_flat", when=kind == ".json")
    text = (
        F.when(kind == ".json", F.col("_flat"))
        .when(kind == ".csv", csv_to_text(content))
        .when(kind == ".xml", X.xml_to_text(content))
        .when(kind.isin(".html", ".htm"), X.html_to_text(content))
        .when(kind == ".eml", X.mail_to_text(content))
        .when(kind == ".txt", content)
    )
    return flat.withColumn("text", text).drop("_flat")


def file_rows(files: DataFrame) -> DataFrame:
    """Path, name, size and raw text of a whole-text scan (batch or stream)."""
    path = F.col("_metadata.file_path")
    return files.select(
        F.sha2(F.concat_ws("\u0001", path, "value"), 256).alias("doc_id"),
        path.alias("path"),
        F.col("_metadata.file_name").alias("filename"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("created_at"),
        F.col("value").alias("raw"),
    ).withColumn("ext", X.extension(F.col("filename")))


def with_outcome(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Add ``text`` and ``outcome``: accepted, or why a file is not evaluated.

    There is no size limit unless the caller gives one, in bytes.
    """
    kind = F.col("ext")
    outcome = (
        F.when(~is_supported(F.col("filename")), "unsupported type")
        .when(~fits(F.col("size"), limit), "too large")
        .when(~kind.isin(*TEXT_EXTENSIONS), "no decoder")
        .when(F.col("text").isNull(), "unreadable")
        .when(~X.non_blank(F.col("text")), "blank")
        .otherwise("accepted")
    )
    return with_text(rows).withColumn("outcome", outcome)


def split_outcomes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted files as documents, and every other file with its reason."""
    left_out = rows.where("outcome <> 'accepted'").select("path", "filename", "size", F.col("outcome").alias("reason"))
    return rows.where("outcome = 'accepted'").drop("outcome"), left_out


def to_documents(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Accepted files as documents."""
    return split_outcomes(with_outcome(rows, limit))[0]


def rejected(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Quarantine: every file that ``to_documents`` leaves out, with the reason."""
    return split_outcomes(with_outcome(rows, limit))[1]


def spread(df: DataFrame, partitions: int | None = None, key: str | None = None) -> DataFrame:
    """Deal the rows of a scan to so many tasks, if the caller or ``spark.docgauge.scanPartitions`` gives a number.

    Text rules cost far more than reading, so a few small files are worth dealing out.
    Without a number rows are dealt by ``key``, if it is given, to as many tasks as a shuffle has;
    else the scan's own splits are used, whatever their size. A row group is never split, so
    slim rows that cost much may all lie in one; and dealt by size they would make few tasks.
    """
    conf = df.sparkSession.conf
    given = partitions or conf.get("spark.docgauge.scanPartitions", None)
    if given:
        return df.repartition(int(given))
    return df.repartition(int(conf.get("spark.sql.shuffle.partitions")), key) if key else df


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return file_rows(spark.read.text(path, wholetext=True, recursiveFileLookup=True))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return to_documents(read_files(spark, path))
