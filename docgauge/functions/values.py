"""Value helpers: dates, amounts, extracted field maps."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgauge import rules, schemas
from docgauge.functions.text import any_of, bind, has, rx, strip

# (shape of the whole value, formats to try in order)
ISO_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}$"
DATE_SHAPES = [
    (ISO_SHAPE, ["yyyy-M-d"]),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ["M/d/yyyy", "d/M/yyyy"]),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", ["yyyy/M/d"]),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ["d-M-yyyy", "M-d-yyyy"]),
    (r"^[A-Za-z]+ \d{1,2}, \d{4}$", ["MMMM d, yyyy", "MMM d, yyyy"]),
    (r"^\d{1,2} [A-Za-z]+ \d{4}$", ["d MMMM yyyy", "d MMM yyyy"]),
    (r"^\d{4}\.\d{1,2}\.\d{1,2}$", ["yyyy.M.d"]),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", ["d.M.yyyy"]),
]


def parse_date(value: Column) -> Column:
    """First of twelve whole-string formats that fits, as a DATE, else NULL.

    The shape test means a value meets only the formats it could satisfy.
    """

    return bind(clean_date(value), date_of)


def clean_date(value: Column) -> Column:
    """What ``date_of`` reads: single spaces, none around."""
    return F.regexp_replace(strip(value), rx(r"\s+"), " ")


def date_of(v: Column) -> Column:
    """Date of a cleaned value, which should be a column or bound: it is looked at many times."""
    out = F.lit(None).cast("date")
    for shape, formats in reversed(DATE_SHAPES):
        parsed = F.coalesce(*[F.try_to_timestamp(v, F.lit(f)).cast("date") for f in formats])
        if shape == ISO_SHAPE:  # the cast reads this shape, many times faster; it alone has a year 0
            parsed = F.when(~v.startswith("0000"), v.try_cast("date"))
        out = F.when(v.rlike(shape), parsed).otherwise(out)
    return out


NUMBER = r"^[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?$"
PLAIN_NUMBER = r"\A[0-9]{1,15}(?:\.[0-9]{1,15})?\z"
NOT_FINITE = r"(?i)^[+-]?(?:nan|inf|infinity)$"


def to_number(value: Column, drop: str) -> Column:
    """Float after removing the characters of class ``drop``; NULL when not a number."""
    # plain digits need no cleaning
    return bind(value, lambda v: F.when(v.rlike(PLAIN_NUMBER), v.try_cast("double")).otherwise(
        bind(clean_number(v, drop), number_of)))


def clean_number(value: Column, drop: str) -> Column:
    """What ``number_of`` reads: without the characters of class ``drop``."""
    return strip(F.regexp_replace(value, rx(f"[{drop}]"), ""))


def number_of(c: Column) -> Column:
    """Float of a cleaned value, which should be a column or bound: it is looked at many times."""
    return (
        F.when(c.rlike(NUMBER), F.replace(c, F.lit("_"), F.lit("")).try_cast("double"))
        .when(c.rlike(r"(?i)^[+-]?nan$"), F.lit(float("nan")))
        .when(c.rlike(r"(?i)^-inf"), F.lit(float("-inf")))
        .when(c.rlike(NOT_FINITE), F.lit(float("inf")))
    )


AMOUNT_DROP = r",$€£¥\s"


def parse_amount(value: Column) -> Column:
    return to_number(value, AMOUNT_DROP)


def parse_invoice_amount(value: Column) -> Column:
    return to_number(value, r",$€£¥₹\s")


def parse_json_amount(value: Column) -> Column:
    return to_number(value, ",$")


def is_numeric(value: Column) -> Column:
    clean = strip(F.regexp_replace(value, "[,$₹]", ""))
    return clean.rlike(NUMBER) | clean.rlike(NOT_FINITE)


def is_date_like(value: Column) -> Column:
    return has(value, any_of(rules.DATE_LIKE_PATTERNS), "i")


def name_has(name: Column, parts) -> Column:
    """Lower-cased field name contains any of the parts."""
    return F.lower(name).rlike("|".join(parts))


def parse_json(raw: Column) -> Column:
    """The VARIANT of a text that is one JSON value from end to end, else NULL.

    The parser stops after the first value, so "2024 report" would be the number 2024. Between
    brackets the text must count as one element, and as the first of two before another: a text
    that closes the bracket itself gives the same count both times.
    """
    held = lambda end: F.json_array_length(F.concat(F.lit("["), raw, F.lit(end)))
    whole = (held("]") == 1) & (held(",0]") == 2)
    return F.when(whole, F.try_parse_json(raw))


# ---------------------------------------------------------------- extracted fields

def field(text: Column, truthy: Column | None = None) -> Column:
    present = F.coalesce(text != "", F.lit(False)) if truthy is None else truthy
    return F.struct(text.cast("string").alias("text"), present.alias("truthy"))


def text_fields(values: Column) -> Column:
    """MAP<STRING,STRING> to a field map; every value is a string, NULL means null."""
    return F.transform_values(values, lambda _, v: field(v))


def is_object(v: Column) -> Column:
    """Whether a VARIANT is a JSON object; its schema would be built from every value inside."""
    return _variant_map(v).isNotNull()


def is_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def _variant_truthy(v: Column) -> Column:
    """Neither null, false, zero nor empty, told from the JSON spelling."""
    return bind(F.to_json(v), lambda j: F.coalesce(
        F.when(j.rlike(r"\A[-0-9]"), j.try_cast("double") != 0).otherwise(~j.isin("null", '""', "false", "{}", "[]")), F.lit(False)))


def _variant_map(v: Column) -> Column:
    """The entries of an object, NULL for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def variant_fields(payload: Column) -> Column:
    """JSON object (VARIANT) to a field map that keeps which values are falsy."""
    return F.transform_values(
        _variant_map(payload), lambda _, v: field(v.cast("string"), _variant_truthy(v))
    )


def variant_line_items(payload: Column, names=("line_items",)) -> Column:
    """First truthy of the named values as line items; NULL unless it is a list."""

    def chosen(fields: Column) -> Column:
        given = F.coalesce(*[F.when(_variant_truthy(fields[n]), fields[n]) for n in names])
        return F.try_variant_get(given, "$", "array<variant>")

    return F.transform(
        bind(_variant_map(payload), chosen),
        lambda i: F.struct(
            F.coalesce(i.cast("string"), F.lit("None")).alias("text"),
            variant_fields(i).alias("fields"),
        ),
    )


def no_fields() -> Column:
    return F.create_map().cast(schemas.FIELDS)


def no_line_items() -> Column:
    return F.lit(None).cast(schemas.LINE_ITEMS)


def value_of(fields: Column, name: str) -> Column:
    return fields[name]["text"]


def is_truthy(fields: Column, name: str) -> Column:
    return F.coalesce(fields[name]["truthy"], F.lit(False))


def first_truthy(fields: Column, names) -> Column:
    """Text of the first present value, as an ``a or b or c`` chain picks it.

    When none is present the last name's value is used (it may be 0 or null).
    """
    head = [F.when(is_truthy(fields, n), value_of(fields, n)) for n in names[:-1]]
    return F.coalesce(*head, value_of(fields, names[-1]))

