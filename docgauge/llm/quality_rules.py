"""Quality rules: a threshold table compiled into one projection.

Every measure is a column expression over the row's own text, so a corpus is
judged in its scan: no shuffle, no user function. A null text counts as an
empty one. Repeats are found by sorting the row's word windows, n log n in the
length of the text, so long texts stay cheap.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.llm.common import SPACE, SPACE_CHARS, by_position

#: Words of common use; a text with few of them is not running prose.
STOP_WORDS = {
    "en": "the of and to in a is that for it was on are as with be by this at from or an he".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au plus avec la".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch".split(),
    "es": "de la que el en y a los se del las un por con una su para es al lo como".split(),
}

#: (measure, least, most); None is open. Rows within all bounds are kept.
THRESHOLDS = [
    ("n_words", 50, None),
    ("mean_word_chars", 3.0, 10.0),
    ("symbol_ratio", None, 0.1),
    ("mark_ratio", None, 0.1),
    ("stop_word_ratio", 0.06, None),
    ("dup_line_ratio", None, 0.4),
    ("ellipsis_line_ratio", None, 0.3),
    ("bullet_line_ratio", None, 0.9),
]

SYMBOLS = r"[#*$%&|<>]"
WORD = r"[^\x20\x09-\x0D]"


def stop_forms(words=None) -> list[str]:
    """Stop words as they stand in texts: lower and capitalised, bare or before a mark."""
    plain = sorted({w for group in (words or STOP_WORDS).values() for w in group})
    return [form + mark for w in plain for form in dict.fromkeys((w, w.capitalize())) for mark in ("", ",", ".")]


def _per(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def with_measures(df: DataFrame, text: str, stop_words=None) -> DataFrame:
    """df with the measures of column ``text``; names that start with ``q_`` are scratch."""
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACE_CHARS))
    df = df.withColumn("q_text", t).withColumn("q_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)))
    word = lambda i: F.get("q_words", i)

    def window(i):
        three = [word(i), word(i + 1), word(i + 2)]
        return F.struct(F.xxhash64(*three).alias("h"), F.concat_ws(" ", *three).alias("s"), i.alias("i"))

    n = F.size("q_words")
    df = df.withColumns({
        # equal windows stand together; the hash decides most comparisons, the words the rest
        "q_sorted": F.when(n > 2, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window))),
        "q_lines": F.filter(F.split("q_text", "\n"), lambda x: x.rlike(WORD)),
    })
    at = lambda k: F.get("q_sorted", k)["s"]
    places = F.filter(F.sequence(F.lit(0), F.size("q_sorted") - 1), lambda k: (at(k) == F.coalesce(at(k - 1), F.lit(""))) | (at(k) == F.coalesce(at(k + 1), F.lit(""))))
    df = df.withColumn("q_again", F.when(n > 2, F.sort_array(F.transform(places, lambda k: F.get("q_sorted", k)["i"]))))
    covered = F.aggregate(
        "q_again", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"])
    stops = stop_forms(stop_words)
    long = lambda c: c.cast("long")
    df = df.withColumns({
        "n_words": long(n),
        "word_chars": long(F.length(F.array_join("q_words", ""))),
        "n_symbols": long(F.regexp_count("q_text", F.lit(SYMBOLS))),
        "n_marks": long(F.regexp_count("q_text", F.lit("[!?]"))),
        "n_lines": long(F.size("q_lines")),
        "n_dup_lines": long(F.size("q_lines") - F.size(F.array_distinct("q_lines"))),
        "n_repeat_words": long(F.coalesce(covered, F.lit(0))),
        "n_stop_words": long(F.size(F.filter("q_words", lambda w: w.isin(stops)))),
        "n_ellipsis_lines": long(F.size(F.filter("q_lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$")))),
        "n_bullet_lines": long(F.size(F.filter("q_lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-•*‣]")))),
    })
    words, lines = F.col("n_words"), F.col("n_lines")
    return df.withColumns({
        "mean_word_chars": _per(F.col("word_chars"), words),
        "symbol_ratio": _per(F.col("n_symbols"), words),
        "mark_ratio": _per(F.col("n_marks"), words),
        "stop_word_ratio": _per(F.col("n_stop_words"), words),
        "dup_line_ratio": _per(F.col("n_dup_lines"), lines),
        "ellipsis_line_ratio": _per(F.col("n_ellipsis_lines"), lines),
        "bullet_line_ratio": _per(F.col("n_bullet_lines"), lines),
        "base_failed": (words < 50) | (100 * F.col("n_repeat_words") > 50 * words),
    })


def verdict(thresholds=None) -> Column:
    """One boolean expression from the base rule and the threshold table.

    The row id in it, which is never negative, keeps a later filter above the
    measures: pushed below, it would repeat their expressions for every use.
    """
    tests = [~F.col("base_failed"), F.monotonically_increasing_id() >= 0]
    for name, least, most in thresholds or THRESHOLDS:
        if least is not None:
            tests.append(F.col(name) >= least)
        if most is not None:
            tests.append(F.col(name) <= most)
    return reduce(lambda a, b: a & b, tests)


def judge(docs: DataFrame, thresholds=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measures, ``base_failed`` and ``kept`` of each row of docs.

    A null or empty text has no words and fails. Repeated rows are judged each;
    other columns are not read. An empty table gives an empty result.
    """
    df, at = by_position(docs)
    df = df.select(F.col(at[id_col]).alias("doc_id"), F.col(at[text_col]).cast("string").alias("q_in"))
    df = with_measures(df, "q_in").withColumn("kept", verdict(thresholds))
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *[m for m, _, _ in THRESHOLDS if m != "n_words"])


def keep(docs: DataFrame, thresholds=None, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    df, at = by_position(docs)
    own = df.columns
    df = with_measures(df, at[text_col]).withColumn("q_kept", verdict(thresholds)).where("q_kept")
    return df.select(*own).toDF(*docs.columns)
