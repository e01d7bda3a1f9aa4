"""Scores, status bands, weights, blending and the metric record."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgauge import rules
from docgauge.functions.text import bind, literal_map, total


def exact_sum(name: str) -> Column:
    """Sum that does not depend on the order of rows: in decimals, where every value is one."""
    value = F.col(name)
    exact = value.try_cast("decimal(28,6)")
    return F.when(F.count(value) == F.count(exact), F.coalesce(F.try_sum(exact).cast("double"), F.sum(value))).otherwise(F.sum(value))


def clamp_score(score: Column) -> Column:
    """One decimal, within 0 to 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(score.cast("double"), 1)))


def status_of(score: Column) -> Column:
    return (
        F.when(score >= rules.GOOD_AT, "good")
        .when(score >= rules.WARNING_AT, "warning")
        .otherwise("critical")
    )


def share(part: Column, whole: Column, empty: float = 100.0) -> Column:
    """``part / whole`` in percent, ``empty`` when there is nothing to check."""
    return F.when(whole == 0, F.lit(empty)).otherwise(part / F.nullif(whole, F.lit(0)) * 100.0)


def finding(score: Column, details: Column) -> Column:
    """What a metric rule computes; ``metric`` turns it into a full record."""
    return F.struct(score.cast("double").alias("score"), details.alias("details"))


def metric(family: str, name: str, raw: Column) -> Column:
    """Metric record: the status looks at the score before rounding."""
    description = next(d for n, _, _, d in rules.TYPE_METRICS[family] if n == name)
    return bind(
        raw,
        lambda r: F.struct(
            F.lit(name).alias("name"),
            clamp_score(r["score"]).alias("score"),
            F.lit(description).alias("description"),
            status_of(r["score"]).alias("status"),
            r["details"].alias("details"),
            F.lit(family).alias("document_type"),
        ),
    )


def blend_scores(deterministic: Column, semantic: Column,
                 deterministic_share: float = rules.DETERMINISTIC_SHARE) -> Column:
    return clamp_score(
        clamp_score(deterministic) * deterministic_share
        + clamp_score(semantic) * (1.0 - deterministic_share)
    )


def overall_score(scores: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum in weight order; a missing metric counts as 0."""
    weights = weights or rules.CORE_WEIGHTS
    parts = [clamp_score(F.coalesce(scores.get(m, F.lit(0.0)), F.lit(0.0))) * w for m, w in weights.items()]
    scale = sum(weights.values())
    weighted = total(parts)
    return clamp_score(weighted if abs(scale - 1.0) <= 0.001 else weighted / scale)


def type_score(metrics: Column, weighted: bool = False) -> Column:
    """Mean of the metric scores of one document, or the declared weighted mean."""
    if not weighted:
        summed = F.aggregate(metrics, F.lit(0.0), lambda acc, m: acc + m["score"])
        return F.when(F.size(metrics) > 0, F.round(summed / F.size(metrics), 1))
    table = literal_map({
        f"{family}/{name}": weight for family, rows in rules.TYPE_METRICS.items() for name, _, weight, _ in rows
    })

    def weight(m: Column) -> Column:
        return F.coalesce(table[F.concat_ws("/", m["document_type"], m["name"])], F.lit(0.0))

    top = F.aggregate(metrics, F.lit(0.0), lambda acc, m: acc + m["score"] * weight(m))
    bottom = F.aggregate(metrics, F.lit(0.0), lambda acc, m: acc + weight(m))
    return F.when(bottom > 0, F.round(top / bottom, 1))


def count_severity(issues: Column, severity: str) -> Column:
    return F.size(F.filter(issues, lambda i: i["severity"] == severity))


def status_message(name: Column, score: Column, issues: Column) -> Column:
    """Readable status of one core metric from its score and its issues."""
    n = F.size(issues)
    critical, moderate = count_severity(issues, "critical"), count_severity(issues, "warning")
    return message_from_counts(name, score, n, critical, moderate)


def message_from_counts(name: Column, score: Column, n: Column, critical: Column, moderate: Column) -> Column:
    clean = literal_map(rules.CLEAN_MESSAGES)
    counts = F.concat_ws(
        " and ",
        F.when(critical > 0, F.concat(critical.cast("string"), F.lit(" critical"))),
        F.when(moderate > 0, F.concat(moderate.cast("string"), F.lit(" moderate"))),
    )
    number = n.cast("string")
    return (
        F.when((status_of(score) == "good") & (n == 0),
               F.coalesce(clean[name], F.concat(name, F.lit(" meets quality standards"))))
        .when(status_of(score) == "good", F.concat(number, F.lit(" minor observation(s) noted")))
        .when(counts != "", F.concat(counts, F.lit(" issue(s) detected")))
        .otherwise(F.concat(number, F.lit(" issue(s) requiring review")))
    )


def score_band(score: Column) -> Column:
    """Gauge band of a score."""
    return F.when(score >= rules.GOOD_AT, "Good").when(score >= rules.WARNING_AT, "Moderate").otherwise("Critical")


def lookup(key: Column, table: dict) -> Column:
    """Small fixed table as a map literal."""
    return literal_map(table)[key]
