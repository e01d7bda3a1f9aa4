"""Markup metrics: tag balance, nesting, attributes, encoding."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgauge import rules
from docgauge.functions.scoring import finding, metric
from docgauge.functions.text import bind, flag, has, hits, rx

# Opening tags without a slash anywhere inside (so tags with a URL are not seen),
# closing tags, and self-closing tags.
OPEN_TAG = r"<([a-zA-Z][a-zA-Z0-9]*)\b[^/>]*>"
CLOSE_TAG = r"</([a-zA-Z][a-zA-Z0-9]*)>"
SELF_CLOSED_TAG = r"<([a-zA-Z][a-zA-Z0-9]*)\b[^>]*/\s*>"
# Any tag; group 1 keeps the slash of a closing tag.
ANY_TAG = r"<(/?[a-zA-Z][a-zA-Z0-9]*)\b[^>]*>"
BROKEN_BELOW = 60.0


def _names(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(rx(pattern)), F.lit(1)), F.lower)


def _tag_counts(opened: Column, closed: Column) -> Column:
    """array<struct<tag, open, close>> of the opened tags, in the order in which they first open.

    Tags are sorted with their sign and place, so equal ones stand together and a run's
    length is the distance to the start of the next: n log n in the number of tags.
    """
    row = lambda sign: lambda t, i: F.struct(t.alias("tag"), F.lit(sign).alias("opens"), i.alias("at"))

    def runs(tags: Column) -> Column:
        here, before = (lambda i: F.get(tags, i)), (lambda i: F.get(tags, i - 1))
        first = F.filter(
            F.when(F.size(tags) > 0, F.sequence(F.lit(0), F.size(tags) - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: (i == 0) | (here(i)["tag"] != before(i)["tag"]) | (here(i)["opens"] != before(i)["opens"]))
        return bind(first, lambda s: F.transform(s, lambda i, k: F.struct(
            here(i).alias("of"), (F.coalesce(F.get(s, k + 1), F.size(tags)) - i).alias("n"))))

    def counted(runs: Column) -> Column:
        # the closing tags of a name stand right before its opening ones
        close = lambda r, k: F.when(F.get(runs, k - 1)["of"]["tag"] == r["of"]["tag"], F.get(runs, k - 1)["n"]).otherwise(0)
        both = F.transform(runs, lambda r, k: F.struct(
            r["of"]["opens"].alias("opens"), r["of"]["at"].alias("at"), r["of"]["tag"].alias("tag"), r["n"].alias("open"),
            F.when(k == 0, 0).otherwise(close(r, k)).alias("close")))
        return F.transform(F.array_sort(F.filter(both, lambda t: t["opens"] == 1)), lambda t: F.struct(*[t[c].alias(c) for c in ("tag", "open", "close")]))

    return bind(bind(F.sort_array(F.concat(F.transform(opened, row(1)), F.transform(closed, row(0)))), runs), counted)


def _tag_facts(text: Column) -> Column:
    return F.struct(
        F.filter(_names(text, OPEN_TAG), lambda t: ~t.isin(rules.VOID_TAGS)).alias("opened"),
        _names(text, CLOSE_TAG).alias("closed"),
        hits(text, SELF_CLOSED_TAG).alias("self_closed"),
        has(text, OPEN_TAG).alias("any"),
    )


def _mismatches(counts: Column) -> Column:
    return F.transform(
        F.filter(counts, lambda t: t["open"] != t["close"]),
        lambda t: F.format_string("<%s>: %d open, %d close", t["tag"], t["open"], t["close"]))


def mismatched_tags(text: Column) -> Column:
    """All tags that open and close in different numbers; the metric's text names the first five."""
    return bind(_tag_facts(text), lambda f: _mismatches(_tag_counts(f["opened"], f["closed"])))


def _tag_validity(text: Column) -> Column:
    def judged(f: Column) -> Column:
        def scored(counts: Column) -> Column:
            apart = F.aggregate(counts, F.lit(0), lambda acc, t: acc + F.abs(t["open"] - t["close"]))
            n = F.size(f["opened"]) + f["self_closed"]
            return bind(_mismatches(counts), lambda wrong: finding(
                F.greatest(F.lit(0.0), (1 - apart / F.greatest(n, F.lit(1))) * 100.0),
                F.concat(
                    F.format_string("Found %d tags, %d self-closing.", n, f["self_closed"]),
                    F.when(F.size(wrong) == 0, " All tags properly matched.").otherwise(
                        F.concat(F.lit(" Mismatches: "), F.array_join(F.slice(wrong, 1, 5), "; "))),
                ),
            ))

        return F.when(
            ~f["any"] & (f["self_closed"] == 0),
            finding(F.lit(50.0), F.lit("No markup tags found in document")),
        ).otherwise(bind(_tag_counts(f["opened"], f["closed"]), scored))

    return bind(_tag_facts(text), judged)


def max_depth(text: Column) -> Column:
    """Deepest nesting; a stray closing tag never takes the depth below zero."""
    tags = F.filter(_names(text, ANY_TAG), lambda t: ~F.ltrim(t, F.lit("/")).isin(rules.VOID_TAGS))
    return F.aggregate(
        tags,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("deepest")),
        lambda acc, t: bind(
            F.when(t.startswith("/"), F.greatest(F.lit(0), acc["depth"] - 1)).otherwise(acc["depth"] + 1),
            lambda d: F.struct(d.alias("depth"), F.greatest(acc["deepest"], d).alias("deepest")),
        ),
        lambda acc: acc["deepest"],
    )


def _nesting_depth(text: Column) -> Column:
    return bind(
        max_depth(text),
        lambda d: finding(
            F.when(d > 15, 60).when(d > 10, 80).when(d > 7, 90).otherwise(100),
            F.concat(F.lit("Maximum nesting depth: "), d.cast("string"), F.lit(" levels.")),
        ),
    )


def _attribute_completeness(text: Column) -> Column:
    facts = F.array(*[
        F.struct(
            F.lit(tag).alias("tag"), F.lit(attribute).alias("attribute"),
            hits(text, rf"<{tag}\b", "i").alias("tags"),
            hits(text, rf"<{tag}\b[^>]*\b{attribute}\s*=", "i").alias("attributes"),
        )
        for tag, attribute in rules.REQUIRED_ATTRIBUTES
    ])

    def judged(rows: Column) -> Column:
        due = F.aggregate(rows, F.lit(0), lambda acc, r: acc + r["tags"])
        passed = F.aggregate(rows, F.lit(0), lambda acc, r: acc + F.least(r["attributes"], r["tags"]))
        short = F.filter(rows, lambda r: r["attributes"] < r["tags"])
        notes = F.array_join(
            F.transform(short, lambda r: F.format_string(
                "%d <%s> missing '%s'", r["tags"] - r["attributes"], r["tag"], r["attribute"])), "; ")
        return bind(
            F.struct(due.alias("due"), passed.alias("passed"), notes.alias("notes")),
            lambda c: F.when(
                c["due"] == 0, finding(F.lit(100.0), F.lit("No elements requiring mandatory attributes found."))
            ).otherwise(finding(
                c["passed"] / F.nullif(c["due"], F.lit(0)) * 100.0,
                F.concat(F.format_string("Checked %d attribute requirements, %d passed.", c["due"], c["passed"]),
                         F.when(c["notes"] == "", "").otherwise(F.concat(F.lit(" "), c["notes"]))),
            )),
        )

    return bind(facts, judged)


def _encoding_consistency(text: Column) -> Column:
    charsets = F.array_distinct(F.transform(
        F.regexp_extract_all(text, F.lit(r"""(?i)charset\s*=\s*["']?([a-zA-Z0-9_-]+)"""), F.lit(1)), F.lower
    ))
    facts = F.struct(
        charsets.alias("charsets"),
        F.array_compact(F.array(*[F.when(has(text, p), F.lit(m)) for p, m in rules.ENCODING_ARTIFACTS])).alias("artifacts"),
    )

    def scored(f: Column) -> Column:
        mixed = F.size(f["charsets"]) > 1
        notes = F.concat_ws(
            "; ",
            F.when(mixed, F.concat(F.lit("Mixed charset declarations: "), F.array_join(f["charsets"], ", "))),
            F.when(F.size(f["artifacts"]) > 0, F.array_join(f["artifacts"], "; ")),
        )
        return finding(
            F.greatest(F.lit(0), 100 - flag(mixed) * 30 - F.size(f["artifacts"]) * 15),
            F.when(notes == "", "No encoding issues detected.").otherwise(
                F.concat(F.lit("Encoding analysis complete. "), notes)),
        )

    return bind(facts, scored)


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def tag_validity(text: Column) -> Column:
    return metric("markup", "Tag Validity", _tag_validity(_text(text)))


def nesting_depth(text: Column) -> Column:
    return metric("markup", "Nesting Depth", _nesting_depth(_text(text)))


def attribute_completeness(text: Column) -> Column:
    return metric("markup", "Attribute Completeness", _attribute_completeness(_text(text)))


def encoding_consistency(text: Column) -> Column:
    return metric("markup", "Encoding Consistency", _encoding_consistency(_text(text)))


GATED = [
    ("Nesting Depth", _nesting_depth,
     "Nesting evaluation compromised due to severely malformed or missing tags."),
    ("Attribute Completeness", _attribute_completeness,
     "Attribute evaluation compromised due to severely malformed or missing tags."),
    ("Encoding Consistency", _encoding_consistency,
     "Encoding consistency assumed poor due to malformed or missing tags."),
]


def metrics(text: Column) -> Column:
    """All four; below a tag score of 60 the other three repeat that score."""
    text = _text(text)

    def gated(tags: Column) -> Column:
        broken = tags["score"] < BROKEN_BELOW
        return F.array(tags, *[
            metric("markup", name, F.when(broken, finding(tags["score"], F.lit(note))).otherwise(rule(text)))
            for name, rule, note in GATED
        ])

    return bind(tag_validity(text), gated)
