"""Metrics of delimited text held in one column (one table per row).

The same rules over real DataFrame tables are in ``operators.table``.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgauge import rules
from docgauge.functions import values as V
from docgauge.functions.scoring import finding, metric
from docgauge.functions.text import bind, content_lines, delimiter_of, flag, non_blank, percent, split_literal, strip

FEW_LINES = 50.0


def _table(text: Column, fn) -> Column:
    """Hand the cells of every line (header first) to ``fn``."""
    lines = content_lines(F.coalesce(text, F.lit("")))
    return bind(
        bind(lines, lambda ls: F.struct(ls.alias("lines"), delimiter_of(F.get(ls, F.lit(0))).alias("delimiter"))),
        lambda t: bind(F.transform(t["lines"], lambda line: split_literal(line, t["delimiter"])), fn),
    )


def _data_rows(rows: Column) -> Column:
    return F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))


def _row_completeness(rows: Column) -> Column:
    complete = F.size(F.filter(_data_rows(rows), lambda r: F.forall(r, non_blank)))
    n = F.size(rows) - 1
    counts = F.struct(complete.alias("complete"), n.alias("n"))
    return F.when(F.size(rows) < 2, finding(F.lit(FEW_LINES), F.lit("Insufficient rows to analyze"))).otherwise(
        bind(counts, lambda c: finding(
            c["complete"] / c["n"] * 100.0,
            F.concat(F.format_string("%d/%d rows are fully complete (", c["complete"], c["n"]),
                     percent(c["complete"] / c["n"]), F.lit(").")),
        ))
    )



def _one_type(cells: Column) -> Column:
    """More than 80 % of the values are numbers, or dates, or neither."""

    def judged(c: Column) -> Column:
        other = c["n"] - c["numbers"] - c["dates"]
        return (c["n"] > 0) & (F.greatest(c["numbers"], c["dates"], other) / F.greatest(c["n"], F.lit(1)) > 0.8)

    return bind(
        F.struct(
            F.size(cells).alias("n"),
            F.size(F.filter(cells, V.is_numeric)).alias("numbers"),
            F.size(F.filter(cells, V.is_date_like)).alias("dates"),
        ),
        judged,
    )


def _column_type_consistency(rows: Column) -> Column:
    width = F.size(F.get(rows, F.lit(0)))
    column = lambda i: F.filter(
        F.transform(_data_rows(rows), lambda r: strip(F.get(r, i))),
        lambda c: F.coalesce(c != "", F.lit(False)),
    )
    typed = F.size(F.filter(
        F.sequence(F.lit(0), width - 1), lambda i: _one_type(column(i))
    ))
    return F.when(F.size(rows) < 3, finding(F.lit(FEW_LINES), F.lit("Insufficient data to analyze"))).otherwise(
        bind(F.struct(typed.alias("typed"), width.alias("width")), lambda c: finding(
            c["typed"] / c["width"] * 100.0,
            F.format_string("%d/%d columns have consistent types.", c["typed"], c["width"]),
        ))
    )



def header_findings(headers: Column) -> Column:
    """Score of a header row given as an array of stripped names."""
    named = F.filter(headers, lambda h: h != "")
    facts = F.struct(
        F.size(headers).alias("n"),
        (F.size(headers) - F.size(named)).alias("empty"),
        (F.size(headers) - F.size(F.array_distinct(F.transform(headers, F.lower)))).alias("repeated"),
        F.size(F.filter(named, V.is_numeric)).alias("numeric"),
        F.size(F.filter(named, lambda h: (F.length(h) < 2) | (F.length(h) > 50))).alias("odd"),
    )

    def scored(f: Column) -> Column:
        mostly_numeric = f["numeric"] > f["n"] * 0.5
        penalty = (
            flag(f["empty"] > 0) * 30 + flag(f["repeated"] > 0) * 20 + flag(mostly_numeric) * 25 + flag(f["odd"] > 0) * 10
        )
        say = lambda n, what: F.concat(n.cast("string"), F.lit(what))
        notes = F.concat_ws(
            "; ",
            F.when(f["empty"] > 0, say(f["empty"], " empty header(s)")),
            F.when(f["repeated"] > 0, say(f["repeated"], " duplicate header(s)")),
            F.when(mostly_numeric, say(f["numeric"], " numeric headers (may not be real headers)")),
            F.when(f["odd"] > 0, say(f["odd"], " header(s) with unusual length")),
        )
        return finding(
            F.greatest(F.lit(0), 100 - penalty),
            F.concat(F.lit("Analyzed "), f["n"].cast("string"), F.lit(" headers. "),
                     F.when(notes == "", "All headers look good.").otherwise(notes)),
        )

    return bind(facts, scored)


def _header_quality(rows: Column) -> Column:
    headers = F.transform(F.get(rows, F.lit(0)), strip)
    return F.when(F.size(rows) == 0, finding(F.lit(0.0), F.lit("No data found"))).otherwise(header_findings(headers))



def _null_empty_ratio(rows: Column) -> Column:
    cells = F.flatten(_data_rows(rows))
    empty = F.size(F.filter(cells, lambda c: F.lower(strip(c)).isin(rules.NULL_WORDS)))
    counts = F.struct(empty.alias("empty"), F.size(cells).alias("n"))
    return F.when(F.size(rows) < 2, finding(F.lit(FEW_LINES), F.lit("Insufficient data"))).otherwise(
        bind(counts, lambda c: finding(
            (1 - c["empty"] / F.greatest(c["n"], F.lit(1))) * 100.0,
            F.concat(F.format_string("%d/%d cells are null/empty (", c["empty"], c["n"]),
                     percent(c["empty"] / F.greatest(c["n"], F.lit(1)), 1), F.lit(").")),
        ))
    )



RULES = {
    "Row Completeness": _row_completeness,
    "Column Type Consistency": _column_type_consistency,
    "Header Quality": _header_quality,
    "Null/Empty Ratio": _null_empty_ratio,
}


def tabular_metric(text: Column, name: str) -> Column:
    """One metric of the table held in ``text``."""
    return metric("tabular", name, _table(text, RULES[name]))


def metrics(text: Column) -> Column:
    """All four metrics; the text is split into cells once."""
    return _table(text, lambda rows: F.array(*[metric("tabular", n, rule(rows)) for n, rule in RULES.items()]))
