"""E-mail metrics: headers, recipients, body, attachments."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgauge import rules
from docgauge.functions.scoring import finding, metric
from docgauge.functions.text import bind, flag, has, hits, percent, rx, strip, token_count, total


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def header_completeness(text: Column) -> Column:
    text = _text(text)
    present = {h: has(text, rf"^{h}:\s*.+", "im") for h in rules.REQUIRED_HEADERS + rules.OPTIONAL_HEADERS}
    n_required, n_optional = len(rules.REQUIRED_HEADERS), len(rules.OPTIONAL_HEADERS)
    facts = F.struct(
        F.array_compact(F.array(*[F.when(~present[h], F.lit(h)) for h in rules.REQUIRED_HEADERS])).alias("missing"),
        total(flag(present[h]) for h in rules.OPTIONAL_HEADERS).alias("optional"),
    )

    def scored(f: Column) -> Column:
        required = n_required - F.size(f["missing"])
        return finding(
            required / F.lit(n_required) * 80.0 + f["optional"] / F.lit(n_optional) * 20.0,
            F.concat(
                F.format_string(f"Found %d/{n_required} required headers, %d/{n_optional} optional.", required, f["optional"]),
                F.when(F.size(f["missing"]) > 0, F.concat(F.lit(" Missing: "), F.array_join(f["missing"], ", "))).otherwise(""),
            ),
        )

    return metric("email", "Header Completeness", bind(facts, scored))


def recipient_validation(text: Column) -> Column:
    """Addresses in From, To, Cc and Bcc (folded lines included) with a plausible domain."""
    text = _text(text)
    values = F.concat_ws(" ", *[
        F.nullif(F.regexp_extract(text, rx(rf"^{h}:\s*(.+?)(?=\n\S|\n\n|\z)", "ims"), 1), F.lit(""))
        for h in rules.ADDRESS_HEADERS
    ])

    def scored(found: Column) -> Column:
        domain = lambda a: F.substring_index(a, "@", -1)
        valid = F.size(F.filter(found, lambda a: F.contains(domain(a), F.lit(".")) & (F.length(domain(a)) > 3)))
        return F.when(
            F.size(found) == 0, finding(F.lit(50.0), F.lit("No email addresses found in headers"))
        ).otherwise(finding(
            valid / F.greatest(F.size(found), F.lit(1)) * 100.0,
            F.format_string("Found %d email addresses, %d valid.", F.size(found), valid),
        ))

    found = F.regexp_extract_all(values, F.lit(rules.ADDRESS_PATTERN), F.lit(0))
    return metric("email", "Recipient Validation", bind(found, scored))


def body_quality(text: Column) -> Column:
    text = _text(text)
    body = bind(F.split(text, "\n\n", 2), lambda p: F.coalesce(F.get(p, F.lit(1)), F.get(p, F.lit(0))))

    def judged(body: Column) -> Column:
        clean = strip(F.regexp_replace(F.regexp_replace(body, r"<[^>]+>", " "), rx(r"\s+"), " "))
        facts = bind(clean, lambda c: F.struct(
            token_count(c).alias("words"),
            (F.length(c) / F.greatest(F.length(body), F.lit(1))).alias("ratio"),
        ))

        def scored(f: Column) -> Column:
            thin = (F.length(body) > 100) & (f["ratio"] < 0.3)
            disclaimers = total(flag(has(body, d, "i")) for d in rules.DISCLAIMERS)
            mostly = (f["words"] < 50) & (disclaimers > 2)
            words = F.concat(F.lit("("), f["words"].cast("string"), F.lit(" words)"))
            penalty = F.when(f["words"] < 5, 40).when(f["words"] < 20, 15).otherwise(0) + flag(thin) * 20 + flag(mostly) * 10
            notes = F.concat_ws(
                "; ",
                F.when(f["words"] < 5, F.concat(F.lit("Very short body "), words))
                .when(f["words"] < 20, F.concat(F.lit("Short body "), words)),
                F.when(thin, F.concat(F.lit("Low text-to-markup ratio ("), percent(f["ratio"]), F.lit(")"))),
                F.when(mostly, "Body is mostly disclaimers"),
            )
            return finding(
                F.greatest(F.lit(0), 100 - penalty),
                F.concat(F.lit("Body: "), f["words"].cast("string"), F.lit(" words. "),
                         F.when(notes == "", "Good content quality.").otherwise(notes)),
            )

        return bind(facts, scored)

    return metric("email", "Body Quality", bind(body, judged))


def attachment_check(text: Column) -> Column:
    text = _text(text)
    attached = has(text, r"Content-Disposition:\s*attachment", "i") | has(text, r"Content-Type:\s*multipart", "i")
    raw = bind(hits(text, rules.ATTACHMENT_WORDS, "i"), lambda n: (
        F.when(n == 0, finding(F.lit(100.0), F.lit("No attachment references found — no issues.")))
        .when(attached, finding(F.lit(100.0), F.format_string(
            "Found %d attachment reference(s) with attachment content present.", n)))
        .otherwise(finding(F.lit(40.0), F.format_string(
            "Found %d attachment reference(s) but no actual attachment detected.", n)))
    ))
    return metric("email", "Attachment Check", raw)


def metrics(text: Column) -> Column:
    return F.array(header_completeness(text), recipient_validation(text), body_quality(text), attachment_check(text))
