"""Table-grain quality: the same rules over whole DataFrames.

Per-column facts come from one aggregation pass over the table (map-side
combined, one row per task is shuffled). Keyed checks pre-aggregate the big
side by key before joining, so a key that holds a large share of the rows is
reduced in its own tasks first and never collected as a group.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge import rules
from docgauge.functions import values as V
from docgauge.functions.scoring import clamp_score, exact_sum, share, status_of
from docgauge.functions.text import bind, non_blank, strip
from docgauge.operators.core import matches_format
from docgauge.operators.tabular import header_findings


#: Salts of a key in ``unverified_rows``.
SALTS = 16


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def _filled(name: str) -> Column:
    return F.coalesce(non_blank(_text(name)), F.lit(False))


def _per_column(df: DataFrame, names: list[str], facts) -> DataFrame:
    """One pass: ``facts(name)`` gives named aggregates; one output row per column."""
    one_row = df.agg(F.array(*[
        F.struct(F.lit(n).alias("column_name"), *[c.alias(k) for k, c in facts(n).items()]) for n in names
    ]).alias("columns"))
    return one_row.select(F.inline("columns"))


def _scored(df: DataFrame, part: str, whole: str, empty: float = 100.0) -> DataFrame:
    raw = share(F.col(part), F.col(whole), empty)
    return df.withColumns({"score": clamp_score(raw), "status": status_of(raw)})


def completeness(df: DataFrame, required: list[str]) -> DataFrame:
    facts = lambda n: {"filled": F.count_if(_filled(n)), "total": F.count("*")}
    return _scored(_per_column(df, required, facts), "filled", "total")


def validity(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """``formats`` maps a column to email, phone, date, amount, url, currency_amount or postal_code."""
    value = lambda n: strip(_text(n))
    facts = lambda n: {
        "checked": F.count_if(_filled(n)),
        "passed": F.count_if(_filled(n) & matches_format(F.lit(formats[n]), value(n))),
    }
    return _scored(_per_column(df, list(formats), facts), "passed", "checked")


def sum_consistency(parents: DataFrame, children: DataFrame, key: str, total: str, part: str,
                    tolerance: float = rules.AMOUNT_TOLERANCE) -> DataFrame:
    """Per parent: does the total equal the sum of the children?

    Columns: key, total, child_sum, consistent. Parents without children are
    compared with NULL and count as inconsistent.
    """
    sums = children.groupBy(key).agg(exact_sum(part).alias("child_sum"))
    agrees = F.coalesce(F.abs(F.col("child_sum") - F.col(total)) < tolerance, F.lit(False))
    return parents.select(key, F.col(total)).join(sums, key, "left").withColumn("consistent", agrees)


def order_consistency(df: DataFrame, start: str, end: str, weight: Column | None = None) -> DataFrame:
    """Share of rows whose start is not after their end; unknown dates pass.

    ``weight`` is the number of rows that a row of df stands for, where they were counted first.
    """
    both = F.col(start).isNotNull() & F.col(end).isNotNull()
    number = F.lit(1) if weight is None else weight
    count = lambda test: F.coalesce(F.sum(F.when(test, number)), F.lit(0)).cast("long")
    counts = df.agg(count(both).alias("checked"), count(both & (F.col(start) <= F.col(end))).alias("passed"))
    return _scored(counts, "passed", "checked")


def timeliness(df: DataFrame, column: str, as_of: str, max_age_days: int = rules.MAX_AGE_DAYS) -> DataFrame:
    """Share of known timestamps within the age limit and not after ``as_of``."""
    now = F.lit(as_of).cast("timestamp_ntz")
    oldest = now - F.expr(f"INTERVAL '{max_age_days}' DAY")
    at = F.col(column)
    counts = df.agg(
        F.count(at).alias("checked"),
        F.count_if((at >= oldest) & (at <= now)).alias("current"),
        F.count_if(at < oldest).alias("outdated"),
        F.count_if(at > now).alias("future"),
    )
    return _scored(counts, "current", "checked")


def uniqueness(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct keys and the duplicate penalty of a table."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    counts = groups.agg(
        F.sum("n").alias("n_rows"),
        F.count("*").alias("n_distinct"),
        F.count_if(F.col("n") > 1).alias("n_repeated_keys"),
    )
    return _scored(counts, "n_distinct", "n_rows")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def accuracy_ref(df: DataFrame, key: str, master: DataFrame, master_key: str) -> DataFrame:
    """Rows whose key occurs in the master table.

    Keys are counted first: the join handles one row per distinct key.
    """
    keys = df.groupBy(F.col(key).alias("ref_key")).agg(F.count("*").alias("n"))
    known = master.select(F.col(master_key).alias("ref_key")).distinct().withColumn("known", F.lit(True))
    joined = keys.join(known, "ref_key", "left")
    counts = joined.agg(
        F.sum("n").alias("checked"),
        F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("verified"),
        F.count_if(F.col("known").isNull()).alias("unknown_keys"),
    )
    return _scored(counts, "verified", "checked")


def unverified_rows(df: DataFrame, key: str, master: DataFrame, master_key: str) -> DataFrame:
    """Rows without a master row.

    The distinct keys are checked first; the rows then meet the unknown keys under
    SALTS salts each, so the rows of one hot key are spread over many tasks.
    """
    unknown = df.select(key).distinct().join(master.select(F.col(master_key).alias(key)).distinct(), key, "left_anti")
    spread = unknown.select(F.col(key).alias("_key"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_of"))
    salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return salted.join(spread, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_of")), "left_semi").drop("_salt")


def plausibility(df: DataFrame, columns: list[str], low: float = 0.0, high: float = rules.PLAUSIBLE_MAX) -> DataFrame:
    facts = lambda n: {
        "checked": F.count(F.col(n)),
        "negative": F.count_if(F.col(n) < low),
        "too_large": F.count_if(F.col(n) > high),
        "plausible": F.count_if(F.col(n).between(low, high)),
    }
    return _scored(_per_column(df, columns, facts), "plausible", "checked")


# ---------------------------------------------------------------- tabular family over tables

def row_completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    whole = F.forall(F.array(*[F.coalesce(_text(n), F.lit("")) for n in columns]), non_blank)
    return _scored(df.agg(F.count_if(whole).alias("complete"), F.count("*").alias("total")), "complete", "total", 50.0)


def type_consistency(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: values, numbers, dates and whether one type exceeds 80 %."""
    value = lambda n: strip(_text(n))
    facts = lambda n: {
        "filled": F.count_if(_filled(n)),
        "numbers": F.count_if(_filled(n) & V.is_numeric(value(n))),
        "dates": F.count_if(_filled(n) & V.is_date_like(value(n))),
    }
    other = F.col("filled") - F.col("numbers") - F.col("dates")
    best = F.greatest(F.col("numbers"), F.col("dates"), other)
    return _per_column(df, columns, facts).withColumn(
        "consistent", (F.col("filled") > 0) & (best / F.greatest(F.col("filled"), F.lit(1)) > 0.8)
    )


def header_quality(df: DataFrame) -> DataFrame:
    """Header rules on the column names; one row, no scan of the data."""
    names = F.array(*[F.lit(n.strip()) for n in df.columns])
    raw = header_findings(names)
    return df.sparkSession.range(1).select(
        bind(raw, lambda r: F.struct(
            clamp_score(r["score"]).alias("score"), status_of(r["score"]).alias("status"), r["details"].alias("details")
        )).alias("r")
    ).select("r.*")


def null_ratio(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cells that are null, blank or spell a null word, per column."""
    empty = lambda n: F.coalesce(F.lower(strip(_text(n))).isin(rules.NULL_WORDS), F.lit(True))
    facts = lambda n: {"empty": F.count_if(empty(n)), "total": F.count("*")}
    raw = (1 - F.col("empty") / F.greatest(F.col("total"), F.lit(1))) * 100.0
    return _per_column(df, columns, facts).withColumns({"score": clamp_score(raw), "status": status_of(raw)})
