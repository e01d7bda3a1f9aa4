"""Queries over stored evaluations and chart-ready aggregates."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge import rules
from docgauge.functions.scoring import lookup, score_band

SUMMARY = ["doc_id", "filename", "document_type", "overall_score", "overall_status", "created_at"]
LISTING_SIZE = 20
PAGE_SIZE = 10


def issues_of(evaluations: DataFrame) -> DataFrame:
    """One row per issue with its position inside the evaluation.

    The outer form keeps the optimizer from adding a non-empty test on the
    array below the generator, which would compute a derived array twice.
    """
    rows = evaluations.select("doc_id", F.posexplode_outer("issues").alias("pos", "issue"))
    return rows.where("pos IS NOT NULL").select("doc_id", "pos", "issue.*")


def evaluation_by_id(evaluations: DataFrame, issues: DataFrame, doc_id) -> DataFrame:
    """Summary of one evaluation with its issues, kept when there are none.

    The id filter sits on both inputs, so each scan is pruned before the join.
    """
    head = evaluations.where(F.col("doc_id") == doc_id).select(*SUMMARY)
    return head.join(issues.where(F.col("doc_id") == doc_id), "doc_id", "left")


def latest(evaluations: DataFrame, n: int = LISTING_SIZE) -> DataFrame:
    """Newest evaluations first; the id breaks ties."""
    return evaluations.select(*SUMMARY).orderBy(F.col("created_at").desc(), "doc_id").limit(n)


def severity_distribution(issues: DataFrame) -> DataFrame:
    """Critical, warning and minor issue counts, zeros kept, with the total."""
    severity = F.lower("severity")
    return issues.agg(
        F.count_if(severity == "critical").alias("critical"),
        F.count_if(severity == "warning").alias("warning"),
        F.count_if(severity == "good").alias("minor"),
        F.count("*").alias("total"),
    )


def severity_by_document(issues: DataFrame) -> DataFrame:
    return issues.groupBy("doc_id").pivot("severity", rules.SEVERITIES).count().na.fill(0)


def issues_by_metric(issues: DataFrame) -> DataFrame:
    """Issue counts per core metric and severity; unknown types fall under Other."""
    name = F.coalesce(lookup(F.col("issue_type"), rules.ISSUE_METRIC), F.lit("other"))
    return issues.groupBy(name.alias("metric"), "severity").agg(F.count("*").alias("n"))


def _color(status: Column) -> Column:
    return F.coalesce(lookup(status, rules.STATUS_COLORS), F.lit(rules.PRIMARY_COLOR))


def metric_bars(evaluations: DataFrame) -> DataFrame:
    return evaluations.select("doc_id", F.inline_outer("metrics")).select(
        "doc_id", "name", "score", "weight", "status", _color(F.col("status")).alias("color")
    )


def metric_vector(evaluations: DataFrame, closed: bool = False) -> DataFrame:
    """Labels and scores of the radar chart; ``closed`` repeats the first point."""
    labels, scores = F.col("metrics.name"), F.col("metrics.score")
    if closed:
        labels, scores = F.concat(labels, F.slice(labels, 1, 1)), F.concat(scores, F.slice(scores, 1, 1))
    return evaluations.select("doc_id", labels.alias("labels"), scores.alias("scores"))


def score_bands(evaluations: DataFrame) -> DataFrame:
    return evaluations.groupBy(score_band(F.col("overall_score")).alias("band")).agg(
        F.count("*").alias("n"), F.round(F.avg("overall_score"), 1).alias("mean_score")
    )


def issues_page(issues: DataFrame, page: int, filters: dict[str, str] | None = None,
                sort: list[str] | None = None, page_size: int = PAGE_SIZE) -> DataFrame:
    """One page of the filtered, multi-column sorted issue table (pages from 0)."""
    kept = reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), (filters or {}).items(), issues)
    order = (sort or ["severity", "issue_type"]) + ["doc_id", "pos"]
    return kept.orderBy(*order).offset(page * page_size).limit(page_size)


def chart_parts() -> dict[str, Column]:
    """Gauge, radar, bar and severity data of an evaluation; a field taken from one in the same step computes only that field."""
    severity = lambda s: F.size(F.filter("issues", lambda i: F.lower(i["severity"]) == s))
    gauge = F.struct(
        F.col("overall_score").alias("value"), F.lit(100).alias("max"),
        _color(F.col("overall_status")).alias("color"), score_band(F.col("overall_score")).alias("band"),
    )
    radar = F.struct(
        F.col("metrics.name").alias("labels"), F.col("metrics.score").alias("scores"),
    )
    bars = F.transform("metrics", lambda m: F.struct(
        m["name"].alias("name"), m["score"].alias("score"), m["weight"].alias("weight"),
        m["status"].alias("status"), _color(m["status"]).alias("color")))
    distribution = F.struct(
        severity("critical").alias("critical"), severity("warning").alias("warning"),
        severity("good").alias("minor"), F.size("issues").alias("total"),
    )
    return {"gauge": gauge, "radar": radar, "bar": bars, "severity": distribution}


def chart_bundle(evaluations: DataFrame, doc_id=None) -> DataFrame:
    """Gauge, radar, bar and severity data in one row per evaluation."""
    one = evaluations if doc_id is None else evaluations.where(F.col("doc_id") == doc_id)
    return one.select("doc_id", *[c.alias(n) for n, c in chart_parts().items()])


def rollup(evaluations: DataFrame) -> DataFrame:
    """Counts and mean scores by document type and status with subtotals."""
    return evaluations.rollup("document_type", "overall_status").agg(
        F.count("*").alias("n"),
        F.round(F.avg("overall_score"), 1).alias("mean_overall"),
        F.round(F.avg("type_specific_score"), 1).alias("mean_type_score"),
    )
