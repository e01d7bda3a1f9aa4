"""The earlier, simpler scoring formulas, kept beside the main ones."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge import rules
from docgauge.functions import values as V
from docgauge.functions.text import bind, flag, lower_text, non_blank, total
from docgauge.operators.records import is_object
from docgauge.operators.social import english_share


def _share_of(low: Column, words) -> Column:
    return total(flag(F.contains(low, F.lit(w))) for w in words) / F.lit(len(words)) * 100.0


def contract(text: Column) -> Column:
    def judged(low: Column) -> Column:
        hits = total(flag(F.contains(low, F.lit(w))) for w in rules.PROTO_RISKS)
        return F.struct(
            _share_of(low, rules.PROTO_CLAUSES).alias("clause_completeness"),
            F.when(low.rlike("signature|signed"), 100.0).otherwise(0.0).alias("signature_presence"),
            _share_of(low, rules.PROTO_META).alias("metadata_completeness"),
            F.greatest(F.lit(0.0), 100.0 - hits * 30.0).alias("risk_clause_detection"),
        )

    return bind(lower_text(text), judged)


def invoice(text: Column) -> Column:
    """First number after each word; ``total`` also hits inside ``subtotal``."""

    def number(low: Column, word: str) -> Column:
        return F.nullif(F.regexp_extract(low, rf"{word}[: ](\d+)", 1), F.lit("")).try_cast("decimal(38,0)")

    def judged(low: Column) -> Column:
        subtotal, tax, total_ = number(low, "subtotal"), number(low, "tax"), number(low, "total")
        known = subtotal.isNotNull() & tax.isNotNull() & total_.isNotNull()
        return F.struct(
            _share_of(low, rules.PROTO_INVOICE_WORDS).alias("field_completeness"),
            F.lit(rules.PROTO_OCR).alias("ocr_confidence"),
            F.when(~known, 80.0).when(subtotal + tax != total_, 0.0).otherwise(100.0).alias("amount_consistency"),
        )

    return bind(lower_text(text), judged)


def records(df: DataFrame, group: str, payload: str) -> DataFrame:
    """Record rules per group of JSON rows.

    Only sums and a distinct count are kept per group, so groups of any size
    are combined map-side.
    """
    value = V.parse_json(F.col(payload))
    parsed = df.select(F.col(group), V.variant_fields(F.when(is_object(value), value)).alias("r"))
    has_key = lambda k: F.map_contains_key("r", F.lit(k))
    text = lambda k: V.value_of(F.col("r"), k)
    number = lambda k: F.when(has_key(k), V.to_number(text(k), r"\s")).otherwise(0.0)
    every = lambda cs: reduce(lambda a, b: a & b, cs)
    keys = rules.PROTO_RECORD_KEYS
    facts = parsed.select(
        group,
        every(has_key(k) for k in keys).alias("has_keys"),
        every(F.coalesce(text(k) != "", F.lit(False)) for k in keys).alias("filled"),
        number("amount").alias("amount"), number("tax").alias("tax"), number("total").alias("total"),
        text("order_id").alias("order_id"),
    )
    typed = F.col("amount").isNotNull() & F.col("tax").isNotNull() & F.col("total").isNotNull()
    counts = facts.groupBy(group).agg(
        F.count("*").alias("n"),
        F.count_if("has_keys").alias("with_keys"),
        F.count_if("filled").alias("complete"),
        F.count_if(typed).alias("typed"),
        F.count_if(typed & (F.col("amount") + F.col("tax") == F.col("total"))).alias("consistent"),
        # a missing id counts as one more value
        (F.count_distinct("order_id") + F.max(flag(F.col("order_id").isNull()))).alias("ids"),
    )
    rate = lambda c: F.col(c) / F.col("n") * 100.0
    return counts.select(
        group,
        rate("with_keys").alias("schema_compliance"),
        rate("complete").alias("completeness"),
        rate("typed").alias("type_validation"),
        rate("consistent").alias("cross_field_consistency"),
        rate("ids").alias("uniqueness"),
        F.lit(100.0).alias("schema_drift_rate"),
        (F.col("n") - F.col("typed")).cast("double").alias("type_mismatch_count"),
    )


def social(df: DataFrame, group: str, text: str) -> DataFrame:
    """Comment rules per group; each non-blank line of the text is a comment."""
    lines = df.select(F.col(group), F.explode_outer(F.split(F.col(text), "\n")).alias("line"))
    comments = lines.select(group, F.regexp_replace("line", r"(?U)^\s+|\s+$", "").alias("c")).where(non_blank(F.col("c")))
    # equal comments are merged before anything is counted per group
    merged = comments.groupBy(group, "c").agg(F.count("*").alias("n"))
    low = F.lower("c")
    weigh = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    counts = merged.groupBy(group).agg(
        F.sum("n").alias("n"),
        F.count("*").alias("distinct"),
        weigh(english_share(F.col("c")) == 1.0).alias("english"),
        weigh(F.contains(low, F.lit("stupid"))).alias("offensive"),
        weigh(F.contains(low, F.lit("http"))).alias("links"),
    )
    rate = lambda c: c / F.col("n") * 100.0
    return counts.select(
        group,
        F.lit(100.0).alias("completeness"),
        rate(F.col("n") - F.col("distinct")).alias("duplicate_rate"),
        rate(F.col("english")).alias("language_consistency"),
        rate(F.col("offensive")).alias("offensive_rate"),
        rate(F.col("links")).alias("spam_rate"),
    )


def dq_score(metrics: list[Column]) -> Column:
    """Plain mean of every numeric metric, counts and rates included."""
    return reduce(lambda a, b: a + b, metrics) / F.lit(len(metrics))


def insight(doc_type: Column, scores: dict[str, Column]) -> Column:
    """Issue, impact and recommendation text of the first formulas.

    ``scores`` maps a metric name to its column; missing metrics never match.
    """
    hits = []
    for kind, metric, limit, *texts in rules.PROTO_INSIGHTS:
        if metric not in scores:
            continue
        bad = scores[metric] < limit if limit > 0 else scores[metric] == 0
        hits.append(F.when((doc_type == kind) & bad, F.struct(*[
            F.lit(t).alias(n) for n, t in zip(("issue", "impact", "recommendation"), texts)])))
    part = lambda found, n: F.array_join(F.transform(found, lambda h: h[n]), " ")
    return bind(F.array_compact(F.array(*hits)), lambda h: F.when(F.size(h) == 0, rules.PROTO_CLEAN).otherwise(F.concat(
        F.lit("\nAI Insight\n\nIssue\n"), part(h, "issue"), F.lit("\n\nImpact\n"), part(h, "impact"),
        F.lit("\n\nRecommendation\n"), part(h, "recommendation"), F.lit("\n"),
    )))
