"""Insight rules: score bands that turn metrics into findings and advice.

The rules are a fixed table of 22 rows. ``match_rules`` joins it to long metric rows
(broadcast; its size never grows with the data). ``in_row`` applies the same
rows to scores already sitting in one document row.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge import rules
from docgauge.functions.scoring import count_severity, lookup
from docgauge.functions.text import bind, flag, literal, strip, total

RULE_SCHEMA = (
    "ord int, scope string, metric string, lo double, hi double, severity string, "
    "issue string, impact string, recommendation string"
)


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rules.INSIGHT_RULES)], RULE_SCHEMA)


def scope_of(document_type: Column) -> Column:
    """Rule scope of a document type; NULL when it has no rules of its own."""
    spellings = {s: scope for scope, names in rules.INSIGHT_SCOPES.items() for s in names}
    return lookup(F.lower(strip(document_type)), spellings)


def match_rules(scores: DataFrame, id_column: str) -> DataFrame:
    """``scores``: id, scope, metric, score. One row per rule that applies."""
    table = F.broadcast(rules_table(scores.sparkSession)).alias("r")
    s = scores.alias("s")
    in_band = (
        (F.col("s.scope") == F.col("r.scope")) & (F.col("s.metric") == F.col("r.metric"))
        & (F.col("s.score") >= F.col("r.lo")) & (F.col("s.score") < F.col("r.hi"))
    )
    return s.join(table, in_band).select(
        f"s.{id_column}", "r.ord", "r.scope", "r.metric", "s.score", "r.severity", "r.issue", "r.impact", "r.recommendation"
    )


def in_row(core_scores: dict[str, Column], type_metrics: Column, document_type: Column) -> Column:
    """Array of the insights of one document, in rule order."""
    entry = lambda scope, name, score: F.struct(
        F.concat(scope, F.lit("/"), name).alias("key"), score.alias("score"))
    known = F.concat(
        F.array(*[entry(F.lit("core"), F.lit(n), c) for n, c in core_scores.items()]),
        F.transform(type_metrics, lambda m: entry(F.coalesce(scope_of(document_type), F.lit("none")), m["name"], m["score"])),
    )
    rows = literal([(f"{scope}/{metric}", lo, hi, severity, issue, impact, advice)
                    for scope, metric, lo, hi, severity, issue, impact, advice in rules.INSIGHT_RULES])

    def matched(scores: Column) -> Column:
        hits = F.filter(
            rows,
            lambda r: F.coalesce((scores[r["v0"]] >= r["v1"]) & (scores[r["v0"]] < r["v2"]), F.lit(False)),
        )
        return F.transform(hits, lambda r: F.struct(
            r["v4"].alias("issue"), r["v5"].alias("impact"), r["v6"].alias("recommendation"), r["v3"].alias("severity")
        ))

    return bind(F.map_from_entries(known), matched)


def core_count(core_scores: dict[str, Column], severity: str) -> Column:
    """Number of the core insights of one severity, where their texts are not needed."""
    return total([F.lit(0), *[
        flag((core_scores[metric] >= lo) & (core_scores[metric] < hi))
        for scope, metric, lo, hi, of, *_ in rules.INSIGHT_RULES if scope == "core" and of == severity]])


def risk_text(critical: Column, warnings: Column, n_issues: Column) -> Column:
    parts = F.concat_ws(
        " and ",
        F.when(critical > 0, F.concat(critical.cast("string"), F.lit(" critical risk(s)"))),
        F.when(warnings > 0, F.concat(warnings.cast("string"), F.lit(" warning(s)"))),
    )
    level = F.when(critical >= 2, "HIGH").when(critical >= 1, "MODERATE").otherwise("LOW")
    return F.when(parts == "", rules.NO_RISK_TEXT).otherwise(F.concat(
        F.lit("Risk Level: "), level, F.lit(". Detected "), parts, F.lit(" across "), n_issues.cast("string"),
        F.lit(" total issue(s). Review recommendations before proceeding."),
    ))


def risk_summary(insights: Column, n_issues: Column) -> Column:
    return risk_text(count_severity(insights, "critical"), count_severity(insights, "warning"), n_issues)


def executive_summary(document_type: Column, mean_score: Column, top_issues: Column, n_insights: Column,
                      n_issues: Column) -> Column:
    """Summary text from the mean core score, the first issues and the counts."""
    shown = F.concat(F.format_string("%.0f", mean_score), F.lit("%"))
    return F.when(
        (mean_score >= rules.GOOD_AT) & (n_insights == 0),
        F.concat(F.lit("The "), document_type, F.lit(" document demonstrates excellent data quality with an average core metric score of "),
                 shown, F.lit(". No significant issues detected.")),
    ).otherwise(F.concat(
        F.lit("Quality analysis of "), document_type, F.lit(" document completed. Average core metric score: "), shown, F.lit(". "),
        F.when(n_issues > 0, F.concat(n_issues.cast("string"), F.lit(" issue(s) were identified. "))).otherwise(""),
        F.when(n_insights > 0, F.concat(F.lit("Key findings: "), F.array_join(top_issues, " "))).otherwise(""),
    ))


def recommendations(insights: Column) -> Column:
    return F.transform(insights, lambda i: i["recommendation"])


def prefer_supplied(supplied: Column, local: Column) -> Column:
    """Supplied text unless it is empty."""
    return F.coalesce(F.nullif(supplied, F.lit("")), local)
