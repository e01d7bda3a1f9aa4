"""Invoice metrics: fields, scan confidence, arithmetic.

``amount_consistency`` works inside one document row. ``amounts_of_orders``
computes the same checks when the line items live in their own table: the
items are pre-aggregated by key (map-side combine, so a key holding a large
share of the rows stays cheap) and only then joined.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge import rules
from docgauge.functions import values as V
from docgauge.functions.scoring import clamp_score, exact_sum, finding, metric, share, status_of
from docgauge.functions.text import bind, flag
from docgauge.operators.contract import found_of, missing_groups


def missing_fields(fields: Column) -> Column:
    """All fields that are not found; the metric's text names the first five."""
    return missing_groups(fields, rules.INVOICE_FIELDS)


def field_completeness(fields: Column) -> Column:
    groups = rules.INVOICE_FIELDS
    return metric(
        "invoice", "Field Completeness", found_of("invoice fields", len(groups), missing_groups(fields, groups), 5)
    )


def ocr_confidence(ext: Column, mean_conf: Column | None = None, blocks: Column | None = None,
                   failed: Column | None = None) -> Column:
    """Mean token confidence of scanned documents; other formats need no OCR.

    ``mean_conf``/``blocks`` come from an OCR token table (see ``ocr_means``).
    """
    mean_conf = F.lit(None).cast("double") if mean_conf is None else mean_conf
    blocks = F.lit(0) if blocks is None else blocks
    failed = F.lit(False) if failed is None else failed
    scanned = F.lower(F.coalesce(ext, F.lit(""))).isin(rules.IMAGE_EXTENSIONS)
    raw = (
        F.when(scanned & failed, finding(F.lit(50.0), F.lit("OCR analysis failed")))
        .when(scanned & mean_conf.isNotNull(), finding(
            F.least(mean_conf, F.lit(100.0)),
            F.format_string("Average OCR confidence: %.1f%% across %d text blocks", mean_conf, blocks)))
        .when(scanned, finding(F.lit(0.0), F.lit("No text detected by OCR")))
        .when(F.lower(ext).isin(".pdf", ".docx"), finding(
            F.lit(100.0), F.lit("Native text document — no OCR needed (100% confidence)")))
        .otherwise(finding(F.lit(100.0), F.lit("Non-image document — OCR not applicable")))
    )
    return metric("invoice", "OCR Confidence", raw)


def ocr_means(ocr_tokens: DataFrame, key: str) -> DataFrame:
    """Mean of the positive confidences and their number per document."""
    positive = F.when(F.col("conf") > 0, F.col("conf"))
    return ocr_tokens.groupBy(key).agg(
        F.avg(positive).alias("mean_conf"), F.count(positive).alias("blocks")
    )


def _items_check(items_sum: Column, expected: Column) -> Column:
    """1 when the items agree with the expected amount or cannot be compared."""
    return F.when(
        items_sum > 0,
        F.when(expected.isNull(), 1).otherwise(flag(F.abs(items_sum - expected) < rules.AMOUNT_TOLERANCE)),
    ).otherwise(0)


def amount_consistency(fields: Column, line_items: Column) -> Column:
    amount = V.parse_invoice_amount
    item_amount = lambda i, names: amount(V.first_truthy(i["fields"], names))
    parsed_items = F.transform(
        F.filter(line_items, lambda i: i["fields"].isNotNull()),
        lambda i: F.struct(
            item_amount(i, rules.ITEM_AMOUNT_NAMES).alias("amount"),
            item_amount(i, rules.ITEM_QUANTITY_NAMES).alias("quantity"),
            item_amount(i, rules.ITEM_PRICE_NAMES).alias("price"),
        ),
    )

    def judged(b: Column) -> Column:
        priced = F.filter(
            b["items"],
            lambda i: i["amount"].isNotNull() & i["quantity"].isNotNull() & i["price"].isNotNull(),
        )
        right = F.filter(
            priced, lambda i: F.abs(i["quantity"] * i["price"] - i["amount"]) < rules.AMOUNT_TOLERANCE
        )
        items_sum = F.aggregate(
            b["items"], F.lit(0.0), lambda acc, i: acc + F.coalesce(i["amount"], F.lit(0.0))
        )
        total_due = b["subtotal"].isNotNull() & b["total"].isNotNull()
        total_ok = F.abs(b["subtotal"] + F.coalesce(b["tax"], F.lit(0.0)) - b["total"]) < rules.AMOUNT_TOLERANCE
        items_due = F.coalesce(b["n_items"] > 0, F.lit(False))
        return bind(
            F.struct(
                (flag(total_due) + flag(items_due) + F.coalesce(F.size(priced), F.lit(0))).alias("done"),
                (
                    flag(total_due & total_ok)
                    + F.when(items_due, _items_check(items_sum, F.coalesce(b["subtotal"], b["total"]))).otherwise(0)
                    + F.coalesce(F.size(right), F.lit(0))
                ).alias("passed"),
            ),
            lambda c: finding(
                share(c["passed"], c["done"]),
                F.when(c["done"] == 0, "No amount fields found to validate").otherwise(
                    F.format_string("Passed %d/%d arithmetic checks.", c["passed"], c["done"])
                ),
            ),
        )

    raw = bind(
        F.struct(
            amount(V.first_truthy(fields, rules.SUBTOTAL_NAMES)).alias("subtotal"),
            amount(V.first_truthy(fields, rules.TAX_NAMES)).alias("tax"),
            amount(V.first_truthy(fields, rules.TOTAL_NAMES)).alias("total"),
            F.size(line_items).alias("n_items"),
            F.coalesce(parsed_items, F.array().cast("array<struct<amount:double,quantity:double,price:double>>")).alias("items"),
        ),
        judged,
    )
    return metric("invoice", "Amount Consistency", raw)


def item_sums(items: DataFrame, key: str) -> DataFrame:
    """key, items_sum, n_items, priced and right of ``items`` (key, amount, quantity, price)."""
    priced = F.col("amount").isNotNull() & F.col("quantity").isNotNull() & F.col("price").isNotNull()
    right = priced & (F.abs(F.col("quantity") * F.col("price") - F.col("amount")) < rules.AMOUNT_TOLERANCE)
    return items.groupBy(key).agg(
        exact_sum("amount").alias("items_sum"),
        F.count("*").alias("n_items"),
        F.count_if(priced).alias("priced"),
        F.count_if(right).alias("right"),
    )


def amounts_of_sums(orders: DataFrame, key: str) -> DataFrame:
    """key, done, passed, score, status of rows with subtotal, tax, total and the columns of ``item_sums``."""
    total_due = F.col("subtotal").isNotNull() & F.col("total").isNotNull()
    total_ok = F.abs(F.col("subtotal") + F.coalesce("tax", F.lit(0.0)) - F.col("total")) < rules.AMOUNT_TOLERANCE
    items_due = F.col("n_items").isNotNull()
    done = flag(total_due) + flag(items_due) + F.coalesce("priced", F.lit(0))
    passed = (
        flag(total_due & total_ok)
        + F.when(items_due, _items_check(F.coalesce("items_sum", F.lit(0.0)), F.coalesce("subtotal", "total"))).otherwise(0)
        + F.coalesce("right", F.lit(0))
    )
    return (
        orders.select(key, done.alias("done"), passed.alias("passed"))
        .withColumn("raw", share(F.col("passed"), F.col("done")))
        .select(key, "done", "passed", clamp_score(F.col("raw")).alias("score"), status_of(F.col("raw")).alias("status"))
    )


def amounts_of_orders(headers: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Invoice arithmetic over tables.

    ``headers``: key, subtotal, tax, total. ``items``: key, amount, quantity,
    price. Returns key, done, passed, score, status.
    """
    return amounts_of_sums(headers.join(item_sums(items, key), key, "left"), key)


def metrics(fields: Column, line_items: Column, ext: Column, mean_conf: Column | None = None,
            blocks: Column | None = None) -> Column:
    return F.array(
        field_completeness(fields), ocr_confidence(ext, mean_conf, blocks), amount_consistency(fields, line_items)
    )
