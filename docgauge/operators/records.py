"""JSON metrics: schema compliance, types, cross-field logic, drift.

Document grain: the payload is one VARIANT per row and every metric is a
column expression. Payloads nested to any depth are read token by token in one
fold inside the row (``functions.json_fold``), so no row is multiplied, nothing is
shuffled and the plan does not depend on the data. Record grain (``profile_records``): the
records are table rows; they are first reduced to their distinct shapes per
group, which keeps a group holding a large share of the rows cheap.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge import rules
from docgauge.functions import json_fold as J
from docgauge.functions import values as V
from docgauge.functions.scoring import clamp_score, finding, metric, share, status_of
from docgauge.functions.text import bind, flag, non_blank
from docgauge.functions.values import is_array, is_object

EMPTY_VARIANTS = "array<variant>"


def type_name(v: Column) -> Column:
    """NoneType, bool, int, float, str, dict or list."""
    scalar = lambda: bind(
        F.coalesce(F.schema_of_variant(v), F.lit("VOID")),
        lambda s: F.when(s == "VOID", "NoneType")
        .when(s == "BOOLEAN", "bool")
        .when(s == "STRING", "str")
        .when(s == "BIGINT", "int")
        .when(s.rlike(r"^DECIMAL\(\d+,0\)$") & (F.regexp_extract(s, r"\((\d+)", 1).try_cast("int") >= 19), "int")
        .otherwise("float"),
    )
    # told from the spelling, as the schema of a container would be built from all that it holds; numbers that are
    # not finite are spelled as strings
    return bind(F.to_json(v), lambda j: F.when(j.startswith("{"), "dict").when(j.startswith("["), "list")
                .when(j.startswith('"') & ~j.isin('"Infinity"', '"-Infinity"', '"NaN"'), "str").otherwise(scalar()))


def _elements(v: Column) -> Column:
    return v.cast("array<variant>")


def _entries(v: Column) -> Column:
    return v.cast("map<string,variant>")


def _is_list(v: Column) -> Column:
    return F.coalesce(F.size(F.try_variant_get(v, "$", "array<variant>")) > 1, F.lit(False))


def _missing_payload() -> Column:
    return finding(F.lit(0.0), F.lit("No JSON data provided"))


def _blank_value(v: Column) -> Column:
    """Null or blank text; containers are never blank."""
    return ~F.coalesce(non_blank(v.cast("string")), F.lit(False))


def schema_compliance(payload: Column) -> Column:
    def keys(v: Column) -> Column:
        return F.when(is_object(v), F.map_keys(_entries(v))).otherwise(F.array().cast("array<string>"))

    def of_list(items: Column) -> Column:
        def judged(first: Column) -> Column:
            others = F.filter(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), is_object)
            credit = F.aggregate(
                others,
                F.lit(0.0),
                lambda acc, o: acc + bind(
                    keys(o),
                    lambda k: F.when(
                        (F.size(F.array_except(first, k)) == 0) & (F.size(F.array_except(k, first)) == 0), 1.0
                    ).otherwise(
                        F.size(F.array_intersect(first, k)) / F.greatest(F.size(F.array_union(first, k)), F.lit(1))
                    ),
                ),
            )
            return F.struct(credit.alias("passed"), F.size(others).alias("done"))

        return bind(keys(F.get(items, F.lit(0))), judged)

    def of_object(entries: Column) -> Column:
        filled = F.filter(F.map_values(entries), lambda v: ~_blank_value(v))
        return F.struct(F.size(filled).cast("double").alias("passed"), F.size(entries).alias("done"))

    counts = (
        F.when(_is_list(payload), bind(_elements(payload), of_list))
        .when(is_object(payload), bind(_entries(payload), of_object))
        .otherwise(F.struct(F.lit(0.0).alias("passed"), F.lit(0).alias("done")))
    )
    raw = bind(
        counts,
        lambda c: finding(
            share(c["passed"], c["done"]),
            F.when(c["done"] == 0, "JSON structure is valid").otherwise(
                F.format_string("Passed %.0f/%d schema checks.", c["passed"], c["done"])
            ),
        ),
    )
    return metric("json", "Schema Compliance", F.when(payload.isNull(), _missing_payload()).otherwise(raw))


def with_type_checks(df: DataFrame, payload: str, text: str | None = None) -> DataFrame:
    """Add ``type_checks`` (struct<done, passed, issues>) of the VARIANT column ``payload``; NULL without one.

    The rules are those of ``json_fold.type_checks``. ``text`` names the column that the
    payload was parsed from; without it the payload is spelled out again.
    """
    spelled = F.col(text) if text else F.col(payload).cast("string")
    marked = df.withColumn("_tokens", F.when(F.col(payload).isNotNull(), J.tokens(spelled)))
    checks = F.when(F.col("_tokens").isNotNull(), J.type_checks("_tokens"))
    return marked.withColumn("type_checks", checks).drop("_tokens")


def type_validation(payload: Column, checks: Column) -> Column:
    """Share of entries whose type fits, from ``with_type_checks``; the text shows three issues, ``type_checks.issues`` has all."""
    raw = bind(
        checks,
        lambda c: finding(
            share(c["passed"], c["done"]),
            F.when(c["done"] == 0, "No type issues detected").otherwise(
                F.concat(
                    F.lit("Validated "), c["done"].cast("string"), F.lit(" fields."),
                    F.when(F.size(c["issues"]) == 0, " All types correct.").otherwise(
                        F.concat(F.lit(" Issues: "), F.array_join(F.slice(c["issues"], 1, 3), "; "))),
                )
            ),
        ),
    )
    return metric("json", "Type Validation", F.when(payload.isNull(), _missing_payload()).otherwise(raw))


def cross_field_consistency(payload: Column) -> Column:
    """Date pairs compared as text; keys with ``total`` against their components."""
    first = F.get(F.when(is_array(payload), _elements(payload)), F.lit(0))
    target = F.when(is_object(payload), payload).when(is_object(first), first)

    def judged(fields: Column) -> Column:
        def pair(start: str, end: str) -> Column:
            due = V.is_truthy(fields, start) & V.is_truthy(fields, end)
            return F.struct(
                flag(due).alias("done"),
                flag(due & (V.value_of(fields, start) <= V.value_of(fields, end))).alias("passed"),
            )

        entries = F.transform(
            F.map_entries(fields),
            lambda e: F.struct(e["key"].alias("key"), V.parse_json_amount(e["value"]["text"]).alias("amount")),
        )

        def total_check(entries: Column):
            def one(t: Column) -> Column:
                parts = F.filter(
                    entries,
                    lambda e: (e["key"] != t["key"])
                    & V.name_has(e["key"], rules.JSON_COMPONENT_PARTS)
                    & e["amount"].isNotNull(),
                )
                return bind(
                    parts,
                    lambda p: F.struct(
                        flag(F.size(p) >= 2).alias("done"),
                        flag(
                            (F.size(p) >= 2)
                            & (F.abs(F.aggregate(p, F.lit(0.0), lambda acc, e: acc + e["amount"]) - t["amount"])
                               < rules.AMOUNT_TOLERANCE)
                        ).alias("passed"),
                    ),
                )

            totals = F.filter(entries, lambda e: V.name_has(e["key"], ["total"]) & e["amount"].isNotNull())
            return F.transform(totals, one)

        checks = F.concat(
            F.array(*[pair(a, b) for a, b in rules.JSON_DATE_PAIRS]), bind(entries, total_check)
        )
        return F.aggregate(
            checks,
            F.struct(F.lit(0).alias("done"), F.lit(0).alias("passed")),
            lambda acc, c: F.struct(
                (acc["done"] + c["done"]).alias("done"), (acc["passed"] + c["passed"]).alias("passed")
            ),
        )

    raw = bind(
        bind(V.variant_fields(target), judged),
        lambda c: finding(
            share(c["passed"], c["done"]),
            F.when(c["done"] == 0, "No cross-field relationships to validate").otherwise(
                F.format_string("Passed %d/%d consistency checks.", c["passed"], c["done"])
            ),
        ),
    )
    return metric(
        "json", "Cross-Field Consistency",
        F.when(target.isNull(), finding(F.lit(100.0), F.lit("Not applicable for this structure"))).otherwise(raw),
    )


def schema_drift_rate(payload: Column) -> Column:
    """Elements that differ from the first one: 1 for other keys, 0.5 for other types."""

    def types(v: Column) -> Column:
        return F.transform_values(_entries(v), lambda _, x: type_name(x))

    def of_list(items: Column) -> Column:
        def judged(ref: Column) -> Column:
            ref_keys = F.map_keys(ref)

            def drift(o: Column) -> Column:
                return F.when(~is_object(o), 1.0).otherwise(bind(
                    types(o),
                    lambda t: F.when(
                        (F.size(F.array_except(ref_keys, F.map_keys(t))) > 0) | (F.size(t) != F.size(ref)), 1.0
                    ).when(F.exists(ref_keys, lambda k: t[k] != ref[k]), 0.5).otherwise(0.0),
                ))

            others = F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))
            return bind(
                F.struct(
                    F.aggregate(others, F.lit(0.0), lambda acc, o: acc + drift(o)).alias("drift"),
                    (F.size(items) - 1).alias("n"),
                ),
                lambda c: finding(
                    F.greatest(F.lit(0.0), 100.0 - c["drift"] / c["n"] * 100.0),
                    F.concat(
                        F.format_string("Checked %d items against reference schema.", c["n"]),
                        F.when(c["drift"] == 0, " No drift detected.").otherwise(""),
                    ),
                ),
            )

        first = F.get(items, F.lit(0))
        return F.when(is_object(first), bind(types(F.when(is_object(first), first)), judged)).otherwise(
            finding(F.lit(100.0), F.lit("Array of primitives — no schema drift applicable"))
        )

    def of_object(entries: Column) -> Column:
        blank = F.size(F.filter(F.map_values(entries), _blank_value))
        n = F.size(entries)
        return F.when(n == 0, finding(F.lit(100.0), F.lit("Empty object"))).otherwise(finding(
            100.0 - blank / F.nullif(n, F.lit(0)) * 100.0,
            F.format_string("%d/%d fields are empty/null.", blank, n),
        ))

    raw = (
        F.when(_is_list(payload), bind(_elements(payload), of_list))
        .when(is_object(payload), bind(_entries(payload), of_object))
        .otherwise(finding(F.lit(100.0), F.lit("Primitive value — no drift applicable")))
    )
    return metric("json", "Schema Drift Rate", F.when(payload.isNull(), _missing_payload()).otherwise(raw))


def metrics(payload: Column, checks: Column) -> Column:
    """All four metrics; ``checks`` comes from ``with_type_checks``."""
    return F.array(
        schema_compliance(payload), type_validation(payload, checks),
        cross_field_consistency(payload), schema_drift_rate(payload),
    )


# ---------------------------------------------------------------- flattening

def with_flat_text(df: DataFrame, raw: str, out: str, when: Column | None = None) -> DataFrame:
    """Add ``out``: one ``path: value`` line per leaf, in source order; NULL for bad JSON.

    ``raw`` names a JSON text column; rows outside ``when`` are not parsed. The text is
    folded itself, because only the text keeps the key order and number spelling of the source.
    """
    text = F.col(raw) if when is None else F.when(when, F.col(raw))
    valid = df.withColumn("_tokens", F.when(V.parse_json(text).isNotNull(), J.tokens(F.col(raw))))
    return valid.withColumn(out, F.when(F.col("_tokens").isNotNull(), J.flat_text("_tokens"))).drop("_tokens")


# ---------------------------------------------------------------- record grain

def profile_records(records: DataFrame, group: str, order: str, payload: str) -> DataFrame:
    """Schema compliance and drift when each record is a table row.

    ``records`` holds group, order and a JSON text column. Rows are reduced to
    distinct shapes (sorted keys with type names) per group before anything is
    compared, so the join below sees shapes, not rows.
    """
    value = V.parse_json(F.col(payload))
    shape = F.when(
        is_object(value),
        F.array_sort(F.transform(
            F.map_entries(F.transform_values(_entries(F.when(is_object(value), value)), lambda _, x: type_name(x))),
            lambda e: F.struct(e["key"].alias("key"), e["value"].alias("type")),
        )),
    )
    shapes = (
        records.select(F.col(group), F.col(order).alias("ord"), shape.alias("shape"))
        .groupBy(group, "shape")
        .agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))
    )
    first = shapes.groupBy(group).agg(
        F.min_by(F.struct("shape"), "first_ord").alias("ref"), F.sum("n").alias("total")
    )
    keys = lambda s: F.transform(s, lambda e: e["key"])
    ref, own = F.col("ref.shape"), F.col("shape")
    ref_keys = F.coalesce(keys(ref), F.array().cast("array<string>"))
    same_keys = keys(own) == ref_keys
    # the reference record itself is not compared
    others = F.col("n") - flag(own.eqNullSafe(ref))
    jaccard = F.size(F.array_intersect(ref_keys, keys(own))) / F.greatest(
        F.size(F.array_union(ref_keys, keys(own))), F.lit(1)
    )
    credit = F.when(own.isNull(), 0.0).when(same_keys, 1.0).otherwise(jaccard)
    drift = F.when(own.isNull() | ~same_keys, 1.0).when(own != ref, 0.5).otherwise(0.0)
    judged = shapes.join(first, group).groupBy(group, "total").agg(
        F.sum(F.when(own.isNotNull(), others)).alias("checked"),
        F.sum(F.when(own.isNotNull(), others * credit)).alias("passed"),
        F.sum(others * drift).alias("drift"),
        F.bool_or(ref.isNotNull()).alias("object_first"),
    )
    compared = F.col("total") - 1
    compliance = share(F.coalesce("passed", F.lit(0.0)), F.coalesce("checked", F.lit(0)))
    drift_score = F.when(
        F.col("object_first") & (compared > 0), F.greatest(F.lit(0.0), 100.0 - F.col("drift") / compared * 100.0)
    ).otherwise(100.0)
    return judged.select(
        group,
        F.col("total").alias("n_records"),
        clamp_score(compliance).alias("schema_compliance"),
        clamp_score(drift_score).alias("schema_drift_rate"),
        status_of(drift_score).alias("drift_status"),
    )
