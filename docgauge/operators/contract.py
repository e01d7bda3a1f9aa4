"""Contract metrics: clauses, signatures, metadata, risks."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgauge import rules
from docgauge.functions import values as V
from docgauge.functions.scoring import finding, metric
from docgauge.functions.text import any_of, bind, has, literal, lower_text, title_text


def _absent(present: dict[str, Column]) -> Column:
    """Names whose condition fails, in declaration order."""
    return F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in present.items()]))


def _held(present: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in present.items()]))


def found_of(what: str, size: int, missing: Column, shown: int) -> Column:
    """Score and text of "k of n found" rules."""
    return bind(
        missing,
        lambda m: finding(
            (size - F.size(m)) / F.lit(size) * 100.0,
            F.concat(
                F.lit("Found "), (size - F.size(m)).cast("string"), F.lit(f"/{size} {what}."),
                F.when(F.size(m) > 0, F.concat(F.lit(" Missing: "), F.array_join(F.slice(m, 1, shown), ", ")))
                .otherwise(""),
            ),
        ),
    )


def missing_groups(fields: Column, groups: dict[str, list[str]]) -> Column:
    """Titles of the groups none of whose field names holds a value."""
    rows = literal([(title_text(n), names) for n, names in groups.items()])
    absent = F.filter(
        rows, lambda r: ~F.exists(r["v1"], lambda a: F.coalesce(fields[a]["truthy"], F.lit(False)))
    )
    return F.transform(absent, lambda r: r["v0"])


def _absent_clauses(low: Column) -> Column:
    return _absent({title_text(n): has(low, any_of(p)) for n, p in rules.CLAUSES.items()})


def missing_clauses(text: Column, low: Column | None = None) -> Column:
    """All standard clauses that are not found; the metric's text names the first five."""
    return bind(lower_text(text) if low is None else low, _absent_clauses)


def clause_completeness(text: Column, low: Column | None = None) -> Column:
    def judged(low: Column) -> Column:
        return found_of("standard clauses", len(rules.CLAUSES), _absent_clauses(low), 5)

    return metric("contract", "Clause Completeness", bind(lower_text(text) if low is None else low, judged))


def signature_presence(fields: Column, text: Column, low: Column | None = None) -> Column:
    def judged(low: Column) -> Column:
        present = {title_text(n): has(low, p) for n, p in rules.SIGNATURE_INDICATORS.items()}
        present["Party Signatures"] = V.is_truthy(fields, "signatures") | present["Party Signatures"]
        size = len(present)
        return bind(
            _held(present),
            lambda h: finding(
                F.size(h) / F.lit(size) * 100.0,
                F.concat(
                    F.lit("Found "), F.size(h).cast("string"), F.lit(f"/{size} signature indicators."),
                    F.when(F.size(h) > 0, F.concat(F.lit(" Present: "), F.array_join(h, ", "))).otherwise(""),
                ),
            ),
        )

    return metric("contract", "Signature Presence", bind(lower_text(text) if low is None else low, judged))


def missing_metadata(fields: Column) -> Column:
    """All metadata that is not found; the metric's text names the first four."""
    return missing_groups(fields, rules.CONTRACT_METADATA)


def metadata_completeness(fields: Column) -> Column:
    groups = rules.CONTRACT_METADATA
    return metric(
        "contract", "Metadata Completeness", found_of("metadata fields", len(groups), missing_groups(fields, groups), 4)
    )


def risk_clause_detection(text: Column, low: Column | None = None) -> Column:
    def judged(low: Column) -> Column:
        present = {n: has(low, any_of(p)) for n, p in rules.CONTRACT_RISKS.items()}
        return bind(
            _held(present),
            lambda r: finding(
                F.when(F.size(r) == 0, 100)
                .when(F.size(r) <= 2, 70)
                .otherwise(F.greatest(F.lit(40), 100 - F.size(r) * 15)),
                F.when(F.size(r) == 0, "No risky clauses detected.").otherwise(
                    F.concat(F.size(r).cast("string"), F.lit(" risk(s) flagged: "), F.array_join(r, ", "))
                ),
            ),
        )

    return metric("contract", "Risk Clause Detection", bind(lower_text(text) if low is None else low, judged))


def metrics(fields: Column, text: Column, low: Column | None = None) -> Column:
    """All four; ``low`` may hold the lower-cased text when it is already known."""
    return F.array(
        clause_completeness(text, low), signature_presence(fields, text, low),
        metadata_completeness(fields), risk_clause_detection(text, low),
    )
