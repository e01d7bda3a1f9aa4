"""The six core metrics of one document, as column expressions.

Input is a field map (name -> text, truthy), optional line items and the
document text. Each function returns ``struct<score, issues>``. Work is done
inside the row, so the metrics add no shuffle whatever the corpus size.
Without fields every metric but completeness is 100.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgauge import rules, schemas
from docgauge.functions import values as V
from docgauge.functions.scoring import clamp_score, share
from docgauge.functions.text import bind, flag, literal, literal_map, lower_text, non_blank, rx, strip, title, title_text


def _issue(name: Column, kind: str, description: Column, severity, value: Column | None = None) -> Column:
    """An issue record; ``value`` is the whole value where the description shows 50 characters of it."""
    severity = severity if isinstance(severity, Column) else F.lit(severity)
    return F.struct(
        name.alias("field_name"),
        F.lit(kind).alias("issue_type"),
        description.alias("description"),
        severity.alias("severity"),
        (F.lit(None).cast("string") if value is None else value).alias("value"),
    )


def _no_issues() -> Column:
    return F.array().cast(schemas.ISSUES)


def _outcome(score: Column, issues: Column) -> Column:
    return F.struct(clamp_score(score).alias("score"), issues.alias("issues"))


def _clean_if_empty(fields: Column, outcome: Column) -> Column:
    return F.when(F.size(fields) > 0, outcome).otherwise(_outcome(F.lit(100.0), _no_issues()))


def _checks_outcome(checks: Column) -> Column:
    """Fold an array of struct<done, passed, issues> into one outcome."""

    def folded(checks: Column) -> Column:
        summed = F.aggregate(
            checks,
            F.struct(F.lit(0).alias("done"), F.lit(0.0).alias("passed")),
            lambda acc, c: F.struct(
                (acc["done"] + c["done"]).alias("done"), (acc["passed"] + c["passed"]).alias("passed")
            ),
        )
        issues = F.array_compact(F.flatten(F.transform(checks, lambda c: c["issues"])))
        return bind(summed, lambda s: _outcome(share(s["passed"], s["done"]), issues))

    return bind(checks, folded)


def _check(done, passed, *issues: Column) -> Column:
    return F.struct(
        (done if isinstance(done, Column) else F.lit(done)).alias("done"),
        (passed if isinstance(passed, Column) else F.lit(passed)).cast("double").alias("passed"),
        (F.array(*issues) if issues else _no_issues()).alias("issues"),
    )


# ---------------------------------------------------------------- completeness

def _by_type(document_type: Column, table: dict, default: list[str]) -> Column:
    key = F.lower(strip(F.coalesce(document_type, F.lit(""))))
    return F.coalesce(literal_map(table)[key], literal(default))


def completeness(fields: Column, document_type: Column) -> Column:
    """Share of the type's required fields that hold a non-blank value."""
    required = _by_type(document_type, rules.REQUIRED_FIELDS, rules.DEFAULT_REQUIRED_FIELDS)
    critical = _by_type(document_type, rules.CRITICAL_FIELDS, rules.DEFAULT_CRITICAL_FIELDS)

    def issue(name: Column, critical: Column) -> Column:
        label = title(name)
        return _issue(
            label,
            "Missing Field",
            F.concat(F.lit("Required field '"), label, F.lit("' not detected in document")),
            F.when(F.array_contains(critical, name), "critical").otherwise("warning"),
        )

    def outcome(b: Column) -> Column:
        missing = F.filter(
            b["required"],
            lambda n: ~F.coalesce(non_blank(fields[n]["text"]), F.lit(False)),
        )
        return bind(
            missing,
            lambda m: _outcome(
                (F.size(b["required"]) - F.size(m)) / F.size(b["required"]) * 100.0,
                F.transform(m, lambda n: issue(n, b["critical"])),
            ),
        )

    return bind(F.struct(required.alias("required"), critical.alias("critical")), outcome)


# ---------------------------------------------------------------- validity

def _format_of(name: Column) -> Column:
    rows = [(kind, V.name_has(name, parts)) for kind, parts in rules.FORMAT_BY_FIELD_NAME]
    out = F.lit(None).cast("string")
    for kind, test in reversed(rows):
        out = F.when(test, kind).otherwise(out)
    return out


def matches_format(kind: Column, value: Column) -> Column:
    """Value fits the named format; NULL for an unknown format."""
    patterns = rules.FORMAT_PATTERNS
    out = F.lit(None).cast("boolean")
    for name, pattern in patterns.items():
        out = F.when(kind == name, value.rlike(rx(pattern))).otherwise(out)
    return F.when(kind == "amount", V.parse_amount(value).isNotNull()).otherwise(out)


def validity(fields: Column) -> Column:
    """Share of values that fit the format their field name asks for."""

    def check(e: Column) -> Column:
        def judged(b: Column) -> Column:
            text = F.concat(F.lit("Value '"), F.substring(b["value"], 1, 50))
            description = F.when(
                b["kind"] == "amount", F.concat(text, F.lit("' is not a valid numeric amount"))
            ).otherwise(
                F.concat(text, F.lit("' does not match expected "),
                         F.when(b["kind"] == "url", "URL").otherwise(b["kind"]), F.lit(" format"))
            )
            return bind(
                matches_format(b["kind"], b["value"]),
                lambda ok: _check(
                    1,
                    flag(ok),
                    F.when(~ok, _issue(title(b["key"]), "Invalid Format", description,
                                       F.when(b["kind"] == "amount", "critical").otherwise("warning"), b["value"])),
                ),
            )

        return bind(e, judged)

    entries = F.transform(
        F.map_entries(fields),
        lambda e: F.struct(
            e["key"].alias("key"), _format_of(e["key"]).alias("kind"), strip(e["value"]["text"]).alias("value")
        ),
    )
    entries = F.filter(entries, lambda e: F.coalesce(e["value"] != "", F.lit(False)) & e["kind"].isNotNull())
    return _clean_if_empty(fields, _checks_outcome(F.transform(entries, check)))


# ---------------------------------------------------------------- consistency

def _item_amount(item: Column) -> Column:
    """``amount`` if the key exists, else ``total``, else 0; NULL if not a number."""
    fields = item["fields"]
    has = lambda n: fields[n].isNotNull() | F.map_contains_key(fields, F.lit(n))  # noqa: E731  (a look into the keys is slow)
    text = F.when(has("amount"), V.value_of(fields, "amount")).when(has("total"), V.value_of(fields, "total")).otherwise("0")
    return V.parse_amount(text)


def _sum_check(fields: Column, line_items: Column) -> Column:
    due = V.is_truthy(fields, "line_items") & V.is_truthy(fields, "total_amount")
    objects = F.filter(line_items, lambda i: i["fields"].isNotNull())
    summed = F.aggregate(objects, F.lit(0.0), lambda acc, i: acc + _item_amount(i))

    def judged(b: Column) -> Column:
        comparable = b["items"].isNotNull() & b["total"].isNotNull()
        ok = comparable & (F.abs(b["items"] - b["total"]) < rules.AMOUNT_TOLERANCE)
        issue = _issue(
            F.lit("Total Amount"), "Inconsistent Value",
            F.format_string("Line items sum (%.2f) does not match total amount (%.2f)", b["items"], b["total"]),
            "critical",
        )
        return _check(1, flag(ok), F.when(comparable & ~ok, issue))

    return F.when(
        due,
        bind(F.struct(summed.alias("items"), V.parse_amount(V.value_of(fields, "total_amount")).alias("total")), judged),
    ).otherwise(_check(0, 0.0))


def _order_checks(fields: Column) -> Column:
    """One check per date pair whose two fields are present."""
    rows = literal([(a, b, title_text(a), title_text(b)) for a, b in rules.ORDERED_DATE_FIELDS])

    def check(r: Column) -> Column:
        start, end = fields[r["v0"]]["text"], fields[r["v1"]]["text"]
        wrong = F.coalesce(V.parse_date(start) > V.parse_date(end), F.lit(False))
        description = F.concat(
            F.lit("'"), r["v3"], F.lit("' ("), end, F.lit(") is before '"), r["v2"], F.lit("' ("), start, F.lit(")")
        )
        issue = F.when(wrong, _issue(r["v3"], "Logical Inconsistency", description, "critical"))
        return bind(issue, lambda i: _check(1, flag(i.isNull()), i))

    return F.transform(F.filter(rows, lambda r: _both(fields, r)), check)


def _both(fields: Column, pair: Column) -> Column:
    """Both fields of a rule row are present."""
    return F.coalesce(fields[pair["v0"]]["truthy"] & fields[pair["v1"]]["truthy"], F.lit(False))


def consistency(fields: Column, line_items: Column) -> Column:
    """Line items add up to the total, date pairs are ordered, names have addresses."""
    named = F.transform(
        F.filter(literal(rules.NAME_ADDRESS_FIELDS), lambda r: _both(fields, r)), lambda r: _check(1, 1.0)
    )
    checks = F.concat(F.array(_sum_check(fields, line_items)), _order_checks(fields), named)
    return _clean_if_empty(fields, _checks_outcome(checks))


# ---------------------------------------------------------------- timeliness

def timeliness(fields: Column, as_of: Column) -> Column:
    """Dates are neither expired, outdated nor in the future, seen from ``as_of``."""
    now = as_of.cast("timestamp_ntz")

    def check(e: Column) -> Column:
        day = e["day"].cast("timestamp_ntz")
        label = title(e["name"])
        shown = F.concat(F.lit("Date '"), e["text"], F.lit("'"))
        expiry, aged, signed = (
            V.name_has(e["name"], p)
            for p in (rules.EXPIRY_NAME_PARTS, rules.AGE_NAME_PARTS, rules.FUTURE_NAME_PARTS)
        )
        issue = (
            F.when(expiry, F.when(
                day < now,
                _issue(label, "Expired Date", F.concat(shown, F.lit(" has already passed")), "critical")))
            .when(aged, F.when(
                now - day > F.expr(f"INTERVAL '{rules.MAX_AGE_DAYS}' DAY"),
                _issue(label, "Outdated Data", F.concat(shown, F.lit(" is more than 2 years old")), "warning")))
            .when(signed, F.when(
                day > now + F.expr("INTERVAL '1' DAY"),
                _issue(label, "Future Date",
                       F.concat(shown, F.lit(" is in the future which may indicate an error")), "warning")))
        )
        return bind(issue, lambda i: _check(1, flag(i.isNull()), i))

    dated = F.transform(
        F.filter(
            F.map_entries(fields),
            lambda e: V.name_has(e["key"], rules.DATE_NAME_PARTS) & F.coalesce(e["value"]["truthy"], F.lit(False)),
        ),
        lambda e: F.struct(
            e["key"].alias("name"), e["value"]["text"].alias("text"), V.parse_date(e["value"]["text"]).alias("day")
        ),
    )
    parsed = F.filter(dated, lambda e: e["day"].isNotNull())
    return _clean_if_empty(fields, _checks_outcome(F.transform(parsed, check)))


# ---------------------------------------------------------------- uniqueness

def uniqueness(fields: Column, line_items: Column) -> Column:
    """Penalise values shared by several fields and repeated line items.

    A value shared by exactly two fields, one of them a name, is not reported
    but still lowers the score.
    """
    entries = F.transform(
        F.filter(F.map_entries(fields), lambda e: e["value"]["text"].isNotNull()),
        lambda e: F.struct(e["key"].alias("name"), F.lower(strip(e["value"]["text"])).alias("value")),
    )
    item_texts = F.transform(line_items, lambda i: F.lower(strip(i["text"])))
    repeats = F.coalesce(F.size(item_texts) - F.size(F.array_distinct(item_texts)), F.lit(0))
    return _clean_if_empty(fields, shared_values(entries, repeats, F.size(fields)))


def repeated_items(repeats: Column) -> Column:
    return _issue(F.lit("Line Items"), "Duplicate Entry",
                  F.concat(repeats.cast("string"), F.lit(" duplicate line item(s) detected")), "warning")


def shared_values(entries: Column, repeats: Column, n_fields: Column) -> Column:
    """Outcome from the entries (name, lower-cased stripped value) and the number of repeated items."""
    long_values = F.filter(entries, lambda e: F.length(e["value"]) > 3)

    def shared(b: Column) -> Column:
        names_of = lambda v: F.transform(
            F.filter(b["entries"], lambda e: e["value"] == v), lambda e: e["name"]
        )
        groups = F.transform(
            F.array_distinct(F.transform(b["entries"], lambda e: e["value"])),
            lambda v: F.struct(v.alias("value"), names_of(v).alias("names")),
        )
        return F.filter(groups, lambda g: F.size(g["names"]) > 1)

    def issue(g: Column) -> Column:
        return _issue(
            F.array_join(F.transform(g["names"], title), ", "),
            "Duplicate Value",
            F.concat(F.lit("Same value '"), F.substring(g["value"], 1, 50), F.lit("' found in multiple fields")),
            "warning",
            g["value"],
        )

    def outcome(b: Column) -> Column:
        reported = F.filter(
            b["groups"],
            lambda g: ~((F.size(g["names"]) == 2) & F.exists(g["names"], lambda n: F.contains(F.lower(n), F.lit("name")))),
        )
        item_issue = F.when(b["repeats"] > 0, F.array(repeated_items(b["repeats"]))).otherwise(_no_issues())
        penalty = (F.size(b["groups"]) + b["repeats"]) / F.greatest(n_fields, F.lit(1)) * 100.0
        return _outcome(100.0 - penalty, F.concat(item_issue, F.transform(reported, issue)))

    groups = bind(F.struct(long_values.alias("entries")), shared)
    return bind(F.struct(groups.alias("groups"), repeats.alias("repeats")), outcome)


# ---------------------------------------------------------------- accuracy

def accuracy(fields: Column, text: Column, low: Column | None = None) -> Column:
    """Values occur in the text (a shared longer word counts 0.8); amounts are plausible."""
    # bound once per row: the text is lower-cased once, not once per field
    return bind(lower_text(text) if low is None else low, lambda low: _accuracy(fields, low))


def _accuracy(fields: Column, low: Column) -> Column:
    def check(e: Column) -> Column:
        value = strip(e["value"]["text"])
        label = title(e["key"])

        def judged(v: Column) -> Column:
            found = F.contains(low, F.lower(v))
            partial = F.exists(
                F.split(v, rx(r"\s+")), lambda w: (F.length(w) > 3) & F.contains(low, F.lower(w))
            )
            source_due = (F.length(low) > 0) & (F.length(v) > 2)
            credit = F.when(found, 1.0).when(partial, 0.8).otherwise(0.0)
            amount_due = V.name_has(e["key"], rules.PLAUSIBLE_NAME_PARTS)
            return bind(
                F.struct(
                    F.when(source_due, credit).alias("credit"),
                    F.when(amount_due, V.parse_amount(v)).alias("amount"),
                ),
                lambda b: _check(
                    flag(b["credit"].isNotNull()) + flag(amount_due),
                    F.coalesce(b["credit"], F.lit(0.0))
                    + flag(F.isnan(b["amount"]) | ((b["amount"] >= 0) & (b["amount"] <= rules.PLAUSIBLE_MAX))),
                    F.when(b["credit"] == 0.0, _issue(
                        label, "Unverifiable Value",
                        F.concat(F.lit("Extracted value '"), F.substring(v, 1, 50),
                                 F.lit("' could not be verified in source text")), "warning", v)),
                    F.when(b["amount"] < 0, _issue(
                        label, "Implausible Value",
                        F.concat(F.lit("Negative amount ("), b["amount"].cast("string"), F.lit(") detected")), "warning"))
                    .when((b["amount"] > rules.PLAUSIBLE_MAX) & ~F.isnan(b["amount"]), _issue(
                        label, "Implausible Value",
                        F.concat(F.lit("Unusually large amount ("), F.format_number(b["amount"], 2),
                                 F.lit(") detected")), "warning")),
                ),
            )

        return bind(value, judged)

    entries = F.filter(
        F.map_entries(fields), lambda e: F.coalesce(non_blank(e["value"]["text"]), F.lit(False))
    )
    return _clean_if_empty(fields, _checks_outcome(F.transform(entries, check)))


def all_core(fields: Column, line_items: Column, text: Column, document_type: Column, as_of: Column,
             low: Column | None = None) -> dict[str, Column]:
    """The six outcomes by metric name, in reporting order."""
    return {
        "completeness": completeness(fields, document_type),
        "validity": validity(fields),
        "consistency": consistency(fields, line_items),
        "accuracy": accuracy(fields, text, low),
        "timeliness": timeliness(fields, as_of),
        "uniqueness": uniqueness(fields, line_items),
    }
