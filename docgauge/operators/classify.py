"""Document type detection and routing to a metric family."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgauge import rules
from docgauge.functions.text import bind, literal_map, lower_text, strip


def detect_type(text: Column, filename: Column, low: Column | None = None) -> Column:
    """JSON by extension, else the first keyword list with a plain substring hit."""

    def by_keyword(low: Column) -> Column:
        out = F.lit("unknown")
        for kind, words in reversed(rules.TYPE_KEYWORDS):
            hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
            out = F.when(hit, kind).otherwise(out)
        return out

    name = F.lower(F.coalesce(filename, F.lit("")))
    by_extension = F.contains(name, F.lit(".")) & (F.substring_index(name, ".", -1) == "json")
    return F.when(by_extension, "json").otherwise(bind(lower_text(text) if low is None else low, by_keyword))


def resolve_type(supplied: Column, text: Column, filename: Column, low: Column | None = None) -> Column:
    """Supplied type unless it is ``unknown``; an empty type is kept."""
    given = F.coalesce(supplied, F.lit("unknown"))
    return F.when(given == "unknown", detect_type(text, filename, low)).otherwise(given)


def family_of(document_type: Column) -> Column:
    """Metric family of a document type; unlisted types use the general one."""
    aliases = {a: family for family, names in rules.FAMILY_ALIASES.items() for a in names}
    return F.coalesce(literal_map(aliases)[F.lower(strip(document_type))], F.lit(rules.DEFAULT_FAMILY))


def metric_family(ext: Column, document_type: Column) -> Column:
    """Family forced by the file extension, else by the document type."""
    return F.coalesce(literal_map(rules.EXTENSION_FAMILY)[F.lower(ext)], family_of(document_type))


def proto_detect_type(text: Column, filename: Column) -> Column:
    low = lower_text(text)
    return (
        F.when(filename.endswith(".json"), "JSON")
        .when(F.contains(low, F.lit("invoice")), "Invoice")
        .when(F.contains(low, F.lit("agreement")) | F.contains(low, F.lit("termination")), "Contract")
        .otherwise("Social Media")
    )
