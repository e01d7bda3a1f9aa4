"""Language of lines and documents by rank profiles of letter trigrams.

A profile holds a language's most frequent trigrams of lower-case letters (a space at
the ends of a word); the r-th of n counts n + 1 - r. A line, or a document, is in the
language whose trigrams add up to the most. Trigrams meet the profiles in a broadcast
join and are summed by line before rows are shuffled.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docgauge.functions.text import strip

#: Trigrams of a profile.
PROFILE_SIZE = 300
#: Rows that all profiles may have together, since they go to every task.
MOST_ROWS = 200_000
#: Language of what holds no trigram of any profile.
UNKNOWN = "und"


def trigrams(text: Column) -> Column:
    """Trigrams around each letter, repeats included, in order; none for a null text."""
    letters = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\P{L}+", " ")
    padded = F.concat(F.lit(" "), letters, F.lit(" "))
    return F.regexp_extract_all(padded, F.lit(r"(?=([ \p{L}]\p{L}[ \p{L}]))"), F.lit(1))


def learn_profiles(labelled: DataFrame, lang_col: str, text_col: str, size: int = PROFILE_SIZE) -> DataFrame:
    """lang, gram, weight of the ``size`` most frequent trigrams of each language.

    Counts are over all rows; of equal counts the smaller trigram comes first. Rows
    without a language are not used. The result has a checked size and is fixed, so it
    is learned once however often it is used.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.explode_outer(trigrams(F.col(text_col))).alias("gram"))
    counts = rows.where("lang IS NOT NULL AND gram IS NOT NULL").groupBy("lang", "gram").count()
    order = Window.partitionBy("lang").orderBy(F.col("count").desc(), "gram")
    ranked = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size)
    found = ranked.select("lang", "gram", (F.lit(size + 1) - F.col("r")).cast("long").alias("weight")).limit(MOST_ROWS + 1).collect()
    if len(found) > MOST_ROWS:
        raise ValueError(f"the profiles have more than {MOST_ROWS} rows: give fewer languages or a smaller size")
    return labelled.sparkSession.createDataFrame(found, "lang string, gram string, weight long")


def _best(sums: dict[str, Column]) -> Column:
    """Name of the greatest sum; of equal ones the first in the order of names."""
    most = reduce(lambda a, b: F.greatest(a, b), sums.values(), F.lit(0).cast("long"))
    out = F.lit(UNKNOWN)
    for name, c in sorted(sums.items(), reverse=True):
        out = F.when(c == most, name).otherwise(out)
    return F.when(most > 0, out).otherwise(UNKNOWN)


def line_languages(docs: DataFrame, id_col: str, text_col: str, profiles: DataFrame) -> DataFrame:
    """id, line (from 0), language and the sum of every language, a row for each line with text.

    Ids are to be unique: equal lines of rows with one id would be added up. Lines
    without trigrams are ``und``.
    """
    names = [r[0] for r in profiles.select("lang").distinct().orderBy("lang").collect()]
    weights = profiles.groupBy("gram").agg(F.count("*").alias("n"), *[
        F.sum(F.when(F.col("lang") == n, F.col("weight")).otherwise(0)).alias(f"w{i}") for i, n in enumerate(names)])
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode_outer(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("line", "part"))
    grams = lines.where(strip(F.col("part")) != "").select("id", "line", F.explode_outer(trigrams(F.col("part"))).alias("gram"))
    met = grams.join(F.broadcast(weights), "gram", "left")
    summed = met.groupBy("id", "line").agg(
        F.count("gram").alias("n_grams"), *[F.coalesce(F.sum(f"w{i}"), F.lit(0)).alias(f"w{i}") for i in range(len(names))])
    sums = {n: F.col(f"w{i}") for i, n in enumerate(names)}
    by_name = F.create_map(*[x for n, c in sums.items() for x in (F.lit(n), c)]) if sums else F.create_map().cast("map<string,bigint>")
    return summed.select(F.col("id").alias(id_col), "line", _best(sums).alias("language"), by_name.alias("sums"))


def document_languages(lines: DataFrame, id_col: str, names: list[str], english: str = "en") -> DataFrame:
    """id, n_lines, lang_share (lines in English), language (of the sums of all lines).

    Documents without a line of text have no row.
    """
    held = [F.sum(F.coalesce(F.col("sums")[n], F.lit(0))).alias(f"s{i}") for i, n in enumerate(names)]
    out = lines.groupBy(id_col).agg(
        F.count("*").alias("n_lines"), F.avg(F.when(F.col("language") == english, 1.0).otherwise(0.0)).alias("lang_share"), *held)
    return out.select(id_col, "n_lines", "lang_share", _best({n: F.col(f"s{i}") for i, n in enumerate(names)}).alias("language"))


def with_lang_share(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with ``lang_share``, which the evaluation then uses instead of function words; null without lines."""
    names = [r[0] for r in profiles.select("lang").distinct().orderBy("lang").collect()]
    shares = document_languages(line_languages(docs, id_col, text_col, profiles), id_col, names)
    return docs.drop("lang_share").join(shares.select(id_col, "lang_share"), id_col, "left")
