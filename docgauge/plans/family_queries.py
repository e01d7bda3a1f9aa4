"""Queries over the type-specific metrics, one per metric."""

from pyspark.sql import functions as F

from docgauge import rules
from docgauge.functions import values as V
from docgauge.operators import contract, general, invoice, mail, markup, records, social, tabular
from docgauge.plans import inputs as I
from docgauge.plans.catalog import query, table
from docgauge.plans.core_queries import INV, sql_score, sql_share, sql_status
from docgauge.plans.text_queries import SQL_SYLLABLE_SUM, SQL_TOKENS, SQL_WORDS, sql_number, sql_strip
from docgauge.sources.readers import spread


def shown(df, ids, record, *, details=False):
    """Ids with the score and status (and details) of one metric record."""
    names = ["score", "status"] + (["details"] if details else [])
    return df.select(*ids, record.alias("m")).select(*ids, *[f"m.{n}" for n in names])


def scored(ids: str, raw: str, relation: str, with_sql: str = "") -> str:
    """SQL for ids, score and status of an unrounded score expression."""
    return f"{with_sql} SELECT {ids}, {sql_score('raw_score')} AS score, {sql_status('raw_score')} AS status FROM (SELECT *, {raw} AS raw_score FROM {relation})"


def sql_hit(text: str, patterns) -> str:
    """Any pattern occurs in the text."""
    alternatives = "|".join(f"(?:{p})" for p in patterns).replace("'", "''")
    return f"regexp_matches({text}, '{alternatives}')"


def sql_count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern.replace(chr(39), chr(39) * 2)}'))"


# Accented letters become word characters that ASCII word boundaries respect.
FOLD = "regexp_replace({}, '[À-ÖØ-öø-ɏ]', '_', 'g')"
LOW = FOLD.format("lower(text)")


def flags(*tests: str) -> str:
    return "(" + " + ".join(f"CAST({t} AS INT)" for t in tests) + ")"


def missing_text(found: str, n: int, what: str, tests: dict[str, str], shown_: int) -> str:
    absent = "list_filter([" + ", ".join(f"CASE WHEN {t} THEN NULL ELSE '{name}' END" for name, t in tests.items()) + "], lambda x: x IS NOT NULL)"
    return (f"'Found ' || {found} || '/{n} {what}.' || CASE WHEN {found} < {n} THEN ' Missing: ' || "
            f"array_to_string(({absent})[1:{shown_}], ', ') ELSE '' END")


def title(name: str) -> str:
    return name.replace("_", " ").title()


# ---------------------------------------------------------------- contract

_CLAUSES = {title(n): sql_hit(LOW, p) for n, p in rules.CLAUSES.items()}


def all_missing(tests: dict[str, str]) -> str:
    """SQL of the names whose test fails, each on a line."""
    return "concat_ws(chr(10), " + ", ".join(f"CASE WHEN NOT ({t}) THEN '{name}' END" for name, t in tests.items()) + ")"


def listed(names):
    """The whole list behind a shortened text, each entry on a line."""
    return F.array_join(names, "\n")


@query("contract_clauses", f"""
SELECT doc_id, {all_missing(_CLAUSES)} AS missing, {sql_score('found * 10.0')} AS score, {sql_status('found * 10.0')} AS status,
  {missing_text('found', 10, 'standard clauses', _CLAUSES, 5)} AS details
FROM (SELECT *, {flags(*_CLAUSES.values())} AS found FROM {I.sql(I.CONTRACT_TEXT)})""")
def contract_clauses(spark, sf_dir):
    docs = I.source(spark, sf_dir, I.CONTRACT_TEXT).withColumn("missing", listed(contract.missing_clauses(F.col("text"))))
    return shown(docs, ["doc_id", "missing"], contract.clause_completeness(F.col("text")), details=True)


_SIGNED = [sql_hit(LOW, [p]) for n, p in rules.SIGNATURE_INDICATORS.items()]
_SIGNED[-1] = f"(doc_id % 19 = 0 OR {_SIGNED[-1]})"


@query("contract_signature", scored("doc_id", f"{flags(*_SIGNED)} * 20.0", I.sql(I.CONTRACT_TEXT)))
def contract_signature(spark, sf_dir):
    fields = V.text_fields(F.create_map(F.lit("signatures"), F.when(F.col("doc_id") % 19 == 0, "yes").otherwise("")))
    return shown(I.source(spark, sf_dir, I.CONTRACT_TEXT), ["doc_id"], contract.signature_presence(fields, F.col("text")))


@query("contract_risk", scored("doc_id", "CASE WHEN n = 0 THEN 100 WHEN n <= 2 THEN 70 ELSE greatest(40, 100 - 15 * n) END",
       f"(SELECT doc_id, {flags(*[sql_hit(LOW, p) for p in rules.CONTRACT_RISKS.values()])} AS n FROM {I.sql(I.CONTRACT_TEXT)})"))
def contract_risk(spark, sf_dir):
    return shown(I.source(spark, sf_dir, I.CONTRACT_TEXT), ["doc_id"], contract.risk_clause_detection(F.col("text")))


CONTRACT_FIELDS = ("orders", [
    ("o_orderkey", "o_orderkey"),
    ("concat('{', CASE WHEN o_orderkey % 2 = 0 THEN concat('\"contract_id\":', cast(o_orderkey % 3 AS string), ',') ELSE '' END, "
     "CASE WHEN o_orderkey % 3 = 0 THEN '\"start_date\":\"2024-01-01\",' ELSE '\"end_date\":\"\",' END, "
     "'\"client\":', CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE concat('\"', o_orderpriority, '\"') END, "
     "',\"vendor\":', CASE o_orderkey % 4 WHEN 0 THEN '[]' WHEN 1 THEN '{}' WHEN 2 THEN 'true' ELSE '[1]' END, "
     "',\"fee\":', CASE WHEN o_orderkey % 7 = 0 THEN '0.0' ELSE '1.5' END, '}')", "raw"),
])


_METADATA = {title(n): "false" for n in rules.CONTRACT_METADATA}
for _alias, _test in {"contract_id": "o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0", "start_date": "o_orderkey % 3 = 0", "client": "o_orderkey % 5 <> 0",
                      "vendor": "o_orderkey % 4 >= 2", "fee": "o_orderkey % 7 <> 0"}.items():
    for _name, _aliases in rules.CONTRACT_METADATA.items():
        if _alias in _aliases:
            _METADATA[title(_name)] = _test


@query("contract_metadata", scored(f"o_orderkey, {all_missing(_METADATA)} AS missing", f"{flags(*_METADATA.values())} / {len(_METADATA)}.0 * 100", "orders"))
def contract_metadata(spark, sf_dir):
    docs = I.source(spark, sf_dir, CONTRACT_FIELDS).withColumn("fields", V.variant_fields(F.try_parse_json("raw")))
    docs = docs.withColumn("missing", listed(contract.missing_metadata(F.col("fields"))))
    return shown(docs, ["o_orderkey", "missing"], contract.metadata_completeness(F.col("fields")))


# ---------------------------------------------------------------- invoice

def _present(names: list[str]) -> str:
    known = [n for n in names if n in I.INVOICE_FIELDS + ["line_items"]]
    return "(" + (" OR ".join(f"coalesce({n} <> '', false)" for n in known) or "false") + ")"


_FIELDS = {title(n): _present(a) for n, a in rules.INVOICE_FIELDS.items()}


@query("invoice_fields", scored(f"doc_id, {all_missing(_FIELDS)} AS missing", flags(*_FIELDS.values()) + " / 12.0 * 100", "inv", f"WITH {INV}"))
def invoice_fields(spark, sf_dir):
    docs = I.invoices(spark, sf_dir).withColumn("missing", listed(invoice.missing_fields(F.col("fields"))))
    return shown(docs, ["doc_id", "missing"], invoice.field_completeness(F.col("fields")))


_EXT = "CASE o_orderkey % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.txt' WHEN 2 THEN '.JPG' ELSE '.png' END"


@query("ocr_confidence", scored(
    "o_orderkey", f"CASE WHEN {_EXT} IN ('.JPG', '.png') THEN least(coalesce(mean_conf, 0), 100) ELSE 100 END",
    """(SELECT o_orderkey, mean_conf FROM orders LEFT JOIN (
      SELECT l_orderkey, avg(CASE WHEN l_linenumber * 13 % 101 - 20 > 0 THEN l_linenumber * 13 % 101 - 20 END) AS mean_conf
      FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""))
def ocr_confidence(spark, sf_dir):
    tokens = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") * 13 % 101 - 20).alias("conf"))
    docs = table(spark, sf_dir, "orders").select("o_orderkey").join(invoice.ocr_means(tokens, "o_orderkey"), "o_orderkey", "left")
    record = invoice.ocr_confidence(F.expr(_EXT), F.col("mean_conf"), F.col("blocks"))
    return shown(docs, ["o_orderkey"], record)


_AMOUNT = r"[,$€£¥₹\s]"
_LINE_2 = "CASE WHEN repeated_item = 1 THEN item ELSE 5 END"


@query("invoice_amounts", scored("doc_id", sql_share(
    f"({flags('total IS NOT NULL AND abs(subtotal + tax - total) < 0.01', f'item + {_LINE_2} > 0 AND abs(item + {_LINE_2} - subtotal) < 0.01')} "
    "+ 2)", "(CASE WHEN total IS NULL THEN 3 ELSE 4 END)"),
    f"""(SELECT doc_id, repeated_item, CAST(item_amount AS DOUBLE) AS item, {sql_number('subtotal', _AMOUNT)} AS subtotal,
      {sql_number('tax', _AMOUNT)} AS tax, {sql_number('total_amount', _AMOUNT)} AS total FROM inv)""", f"WITH {INV}"))
def invoice_amounts(spark, sf_dir):
    return shown(I.invoices(spark, sf_dir), ["doc_id"], invoice.amount_consistency(F.col("fields"), F.col("line_items")))


_HEADERS = """(SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN s + 1 WHEN o_orderkey % 11 = 0 THEN NULL ELSE s END AS subtotal,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 10.0 END AS tax, CASE WHEN o_orderkey % 4 = 0 THEN s ELSE s + 10 END AS total, s, n, priced, good
  FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS s, count(*) AS n, count(*) FILTER (WHERE price IS NOT NULL) AS priced,
    count(*) FILTER (WHERE abs(l_quantity * price - l_extendedprice) < 0.01) AS good
    FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN l_extendedprice / l_quantity ELSE round(l_extendedprice / l_quantity) END AS price FROM lineitem)
    GROUP BY 1) ON l_orderkey = o_orderkey)"""


@query("invoice_amounts_of_orders", f"""
SELECT o_orderkey, CAST(done AS BIGINT) AS done, CAST(passed AS BIGINT) AS passed, {sql_score(sql_share('passed', 'done'))} AS score, {sql_status(sql_share('passed', 'done'))} AS status FROM (
  SELECT o_orderkey, {flags('subtotal IS NOT NULL AND total IS NOT NULL', 'n IS NOT NULL')} + coalesce(priced, 0) AS done,
    {flags('coalesce(abs(subtotal + coalesce(tax, 0) - total) < 0.01, false)', 'coalesce(s > 0 AND abs(s - coalesce(subtotal, total)) < 0.01, false)')} + coalesce(good, 0) AS passed
  FROM {_HEADERS})""")
def invoice_amounts_of_orders(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    price = F.when(F.col("l_linenumber") % 3 == 1, unit).when(F.col("l_linenumber") % 3 == 2, F.round(unit))
    items = lines.select("o_orderkey", F.col("l_extendedprice").alias("amount"), F.col("l_quantity").alias("quantity"), price.alias("price"))
    # the headers' amounts come from the same sums, so lineitem is read once
    sums = invoice.item_sums(items, "o_orderkey").withColumn("s", F.round("items_sum", 2))
    orders = table(spark, sf_dir, "orders").select("o_orderkey").join(sums, "o_orderkey", "left").withColumns({
        "subtotal": F.expr("CASE WHEN o_orderkey % 10 = 0 THEN s + 1 WHEN o_orderkey % 11 = 0 THEN NULL ELSE s END"),
        "tax": F.expr("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 10.0D END"),
        "total": F.expr("CASE WHEN o_orderkey % 4 = 0 THEN s ELSE s + 10 END")})
    out = invoice.amounts_of_sums(orders, "o_orderkey")
    return out.withColumns({"done": F.col("done").cast("long"), "passed": F.col("passed").cast("long")})


# ---------------------------------------------------------------- JSON

def _json_docs(spark, sf_dir, spec):
    docs = I.source(spark, sf_dir, spec).withColumn("payload", F.try_parse_json("raw"))
    return docs


_EVENTS = I.sql(I.EVENT_JSON)
_JACCARD = """CASE WHEN len(list_filter(a, lambda k: NOT list_contains(b, k))) = 0 AND len(a) = len(b) THEN 1.0
  ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) END"""


@query("json_schema_compliance", scored("event_id", sql_share("passed", "done"), f"""(
  SELECT event_id, coalesce(sum({_JACCARD}) FILTER (WHERE b IS NOT NULL), 0) AS passed, count(b) AS done FROM (
    SELECT event_id, json_keys(json_extract(raw, '$[0]')) AS a,
      CASE WHEN json_type(json_extract(raw, '$[' || i || ']')) = 'OBJECT' THEN json_keys(json_extract(raw, '$[' || i || ']')) END AS b
    FROM {_EVENTS}, (VALUES (1), (2)) AS t(i)) GROUP BY event_id)"""))
def json_schema_compliance(spark, sf_dir):
    return shown(_json_docs(spark, sf_dir, I.EVENT_JSON), ["event_id"], records.schema_compliance(F.col("payload")))


_TAG_TYPES = "CASE event_id % 3 WHEN 1 THEN 'int, str' WHEN 2 THEN 'int, list' END"


def _tags_issue(record: int) -> str:
    return f"'''[{record}].tags'': mixed types in array (' || {_TAG_TYPES} || ')'"


def _text_issue(path: str) -> str:
    return f"'''{path}'': numeric value stored as string (''' || CAST(value AS VARCHAR) || ''')'"


_TYPE_ISSUES = f"""list_filter([{_tags_issue(0)}, CASE WHEN event_id % 5 = 0 THEN {_text_issue('[1].value')} END,
      CASE WHEN event_id % 5 NOT IN (1, 2) THEN {_tags_issue(1)} END, {_tags_issue(2)}, CASE WHEN event_id % 7 = 0 THEN {_text_issue('[2].note')} END,
      CASE WHEN event_id % 5 = 2 THEN ''''': mixed types in array (NoneType, dict)' END], lambda x: x IS NOT NULL)"""


@query("json_type_validation", f"""
SELECT event_id, {sql_score('raw_score')} AS score, {sql_status('raw_score')} AS status, array_to_string(issues, chr(10)) AS issues,
  'Validated ' || done || ' fields.' || CASE WHEN len(issues) = 0 THEN ' All types correct.' ELSE ' Issues: ' || array_to_string(issues[1:3], '; ') END AS details
FROM (SELECT *, passed / CAST(done AS DOUBLE) * 100 AS raw_score FROM (
  SELECT event_id, {_TYPE_ISSUES} AS issues, 1 + a + b + c AS done, 0.5 * CAST(event_id % 5 = 2 AS INT) + 1.0 * CAST(event_id % 5 <> 2 AS INT)
      + a - tag_loss + b - CASE WHEN event_id % 5 = 0 THEN 0.5 ELSE 0 END - CASE WHEN event_id % 5 IN (1, 2) THEN 0 ELSE tag_loss END
      + c - tag_loss - CASE WHEN event_id % 7 = 0 THEN 0.5 ELSE 0 END AS passed
  FROM (SELECT event_id, value, 7 AS a, CASE event_id % 5 WHEN 1 THEN 4 WHEN 2 THEN 0 ELSE 7 END AS b, CASE WHEN event_id % 7 = 0 THEN 8 ELSE 7 END AS c,
    CASE WHEN event_id % 3 = 0 THEN 0 ELSE 0.5 END AS tag_loss FROM events)))""")
def json_type_validation(spark, sf_dir):
    docs = records.with_type_checks(_json_docs(spark, sf_dir, I.EVENT_JSON), "payload", "raw")
    docs = docs.withColumn("issues", F.array_join("type_checks.issues", "\n"))
    return shown(docs, ["event_id", "issues"], records.type_validation(F.col("payload"), F.col("type_checks")), details=True)


_PART = "json_extract_string(raw, '$.{}')"
_MONEY = {k: sql_number(_PART.format(k), "[,$]") for k in ("total", "item_price", "ship_cost", "Sub_Total")}


@query("json_cross_field", scored("o_orderkey", sql_share("passed", "done"), f"""(
  SELECT o_orderkey, {flags("d2 IS NOT NULL", "t IS NOT NULL")} + CAST(s IS NOT NULL AS INT) AS done,
    {flags("coalesce(d1 <= d2, false)", "coalesce(abs(1010.5 - t) < 0.01, false)", "coalesce(abs(1010.5 - s) < 0.01, false)")} AS passed
  FROM (SELECT o_orderkey, {_PART.format('start_date')} AS d1, {_PART.format('end_date')} AS d2, {_MONEY['total']} AS t, {_MONEY['Sub_Total']} AS s
    FROM {I.sql(I.ORDER_JSON)}))"""))
def json_cross_field(spark, sf_dir):
    return shown(_json_docs(spark, sf_dir, I.ORDER_JSON), ["o_orderkey"], records.cross_field_consistency(F.col("payload")))




@query("json_drift", scored("event_id", "greatest(0, 100 - drift / 2.0 * 100)", f"""(
  SELECT event_id, sum(CASE WHEN json_type(o) <> 'OBJECT' THEN 1.0 WHEN list_sort(json_keys(o)) <> list_sort(json_keys(f)) THEN 1.0
      WHEN json_type(json_extract(o, '$.value')) <> json_type(json_extract(f, '$.value')) THEN 0.5 ELSE 0.0 END) AS drift
  FROM (SELECT event_id, json_extract(raw, '$[0]') AS f, json_extract(raw, '$[' || i || ']') AS o FROM {_EVENTS}, (VALUES (1), (2)) AS t(i))
  GROUP BY event_id)"""))
def json_drift(spark, sf_dir):
    return shown(_json_docs(spark, sf_dir, I.EVENT_JSON), ["event_id"], records.schema_drift_rate(F.col("payload")))


_RECORD_KIND = "CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END"


@query("json_records_profile", f"""
SELECT user_id, count(*) AS n_records,
  {sql_score(sql_share("coalesce(sum(CASE WHEN fk = 3 THEN 0.0 WHEN (k = 2) = (fk = 2) THEN 1.0 ELSE 0.75 END) FILTER (WHERE k <> 3 AND event_id <> first_id), 0)",
                       "count(*) FILTER (WHERE k <> 3 AND event_id <> first_id)"))} AS schema_compliance,
  {sql_score("CASE WHEN any_value(fk) = 3 OR count(*) = 1 THEN 100 ELSE greatest(0, 100 - sum(drift) / (count(*) - 1) * 100) END")} AS schema_drift_rate,
  {sql_status("CASE WHEN any_value(fk) = 3 OR count(*) = 1 THEN 100 ELSE greatest(0, 100 - sum(drift) / (count(*) - 1) * 100) END")} AS drift_status
FROM (SELECT *, CASE WHEN event_id = first_id THEN 0 WHEN k = 3 OR (k = 2) <> (fk = 2) THEN 1.0 WHEN k <> fk THEN 0.5 ELSE 0 END AS drift
  FROM (SELECT user_id, event_id, {_RECORD_KIND} AS k, first_value({_RECORD_KIND}) OVER w AS fk, first_value(event_id) OVER w AS first_id
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))
GROUP BY user_id""")
def json_records_profile(spark, sf_dir):
    return records.profile_records(I.source(spark, sf_dir, I.EVENT_RECORDS), "user_id", "event_id", "record")


# ---------------------------------------------------------------- social media

_TOK = SQL_TOKENS.replace("{text}", "text")
_LOWTOK = SQL_TOKENS.replace("{text}", "lower(text)")
_SLANG = [w for p in rules.SLANG_PATTERNS for w in p[3:-3].split("|")]


def _in(values) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


def _profile(name: str) -> str:
    return f"len(list_filter(ws, lambda w: w IN {_in(rules.LANGUAGE_PROFILES[name])}))"


def english_lines_sql(ids: str, source: str) -> str:
    words = SQL_TOKENS.replace("{text}", "lower(line)")
    line = sql_strip("unnest(string_split(text, chr(10)))")
    return f"""(SELECT {ids}, avg(CASE WHEN en > 0 AND en >= other THEN 1.0 ELSE 0.0 END) AS lang FROM (
      SELECT {ids}, {_profile('en')} AS en, greatest({_profile('fr')}, {_profile('de')}, {_profile('es')}) AS other FROM (
        SELECT {ids}, {words} AS ws FROM (SELECT {ids}, {line} AS line FROM {source}) WHERE line <> '')) GROUP BY {ids})"""


def language_sql(ids: str, source: str) -> str:
    on = " AND ".join(f"l.{i.strip()} = s.{i.strip()}" for i in ids.split(","))
    selected = ", ".join(f"s.{i.strip()}" for i in ids.split(","))
    return f"""(SELECT {selected}, lang, n, slang / CAST(greatest(n, 1) AS DOUBLE) AS slang, caps / CAST(greatest(n, 1) AS DOUBLE) AS caps FROM (
      SELECT {ids}, len(list_filter({_TOK}, lambda w: regexp_full_match(w, '[a-zA-Z]+'))) AS n,
        len(list_filter({_LOWTOK}, lambda w: w IN {_in(_SLANG)})) AS slang,
        len(list_filter({_TOK}, lambda w: regexp_full_match(w, '[A-Z]{{2,}}'))) AS caps FROM {source}) s
      LEFT JOIN {english_lines_sql(ids, source)} l ON {on})"""


LANGUAGE_RAW = """CASE WHEN n = 0 THEN 100 ELSE greatest(0, 100 - CASE WHEN lang < 0.5 THEN 30 WHEN lang < 0.8 THEN 15 ELSE 0 END
  - CASE WHEN slang > 0.3 THEN 30 WHEN slang > 0.15 THEN 15 ELSE 0 END - CASE WHEN caps > 0.3 THEN 20 WHEN caps > 0.15 THEN 10 ELSE 0 END) END"""
_CHAT = I.sql(I.CHAT_TEXT)


@query("social_language", scored("conv_id, turn", LANGUAGE_RAW, language_sql("conv_id, turn", _CHAT)))
def social_language(spark, sf_dir):
    text = F.col("text")
    return shown(I.source(spark, sf_dir, I.CHAT_TEXT), ["conv_id", "turn"], social.language_consistency(text, social.english_share(text)))


_OFFENSIVE = " + ".join(sql_count(LOW, p) for ps in rules.OFFENSIVE_PATTERNS.values() for p in ps)
OFFENSIVE_RAW = """CASE WHEN hits = 0 THEN 100 WHEN hits / CAST(words AS DOUBLE) < 0.02 THEN 80 WHEN hits / CAST(words AS DOUBLE) < 0.05 THEN 50
  ELSE greatest(10, 100 - hits * 20) END"""


def offensive_sql(ids: str, source: str) -> str:
    return f"(SELECT {ids}, {_OFFENSIVE} AS hits, greatest(len({SQL_WORDS}), 1) AS words FROM {source})"


@query("social_offensive", scored("conv_id, turn", OFFENSIVE_RAW, offensive_sql("conv_id, turn", _CHAT)))
def social_offensive(spark, sf_dir):
    return shown(I.source(spark, sf_dir, I.CHAT_TEXT), ["conv_id", "turn"], social.offensive_rate(F.col("text")))


SPAM_RAW = """greatest(0, 100 - CASE WHEN urls / words > 0.1 THEN 30 WHEN urls / words > 0.05 THEN 15 ELSE 0 END
  - CASE WHEN tags > 10 THEN 25 WHEN tags > 5 THEN 10 ELSE 0 END - CASE WHEN promo >= 3 THEN 30 WHEN promo >= 1 THEN 10 ELSE 0 END
  - CASE WHEN len(sentences) > 0 AND len(list_distinct(sentences)) / CAST(len(sentences) AS DOUBLE) < 0.5 THEN 20 ELSE 0 END
  - CASE WHEN caps > 0.5 THEN 15 ELSE 0 END)"""


def spam_sql(ids: str, source: str) -> str:
    return f"""(SELECT {ids}, {sql_count('text', 'https?://[^ ]+')} AS urls, CAST(greatest(len({SQL_WORDS}), 1) AS DOUBLE) AS words,
      {sql_count(FOLD.format('text'), '#[0-9A-Za-z_]+')} AS tags, {" + ".join(sql_count(LOW, p) for p in rules.PROMO_PATTERNS)} AS promo,
      list_filter(list_transform(regexp_split_to_array(lower(text), '[.!?\\n]'), lambda p: {sql_strip('p')}), lambda p: p <> '') AS sentences,
      {sql_count('text', chr(92) + 'p{Lu}')} / CAST(greatest(length(text), 1) AS DOUBLE) AS caps FROM {source})"""


@query("social_spam", scored("conv_id, turn", SPAM_RAW, spam_sql("conv_id, turn", _CHAT)))
def social_spam(spark, sf_dir):
    return shown(I.source(spark, sf_dir, I.CHAT_TEXT), ["conv_id", "turn"], social.spam_detection(F.col("text")))


@query("social_toxic_agreement", f"""
SELECT toxic, count(*) AS n, round(avg({sql_score(OFFENSIVE_RAW)}), 1) AS mean_score
FROM {offensive_sql('doc_id', 'documents')} JOIN labels USING (doc_id) GROUP BY toxic""")
def social_toxic_agreement(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", social.offensive_rate(F.col("text"))["score"].alias("score"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("toxic").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 1).alias("mean_score"))


# ---------------------------------------------------------------- tabular

_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda p: {sql_strip('p')}), lambda p: p <> '')"
_ROWS = f"(SELECT c_custkey, list_transform({_LINES}, lambda l: string_split(l, ',')) AS rows FROM {I.sql(I.CSV_TEXT)})"
_IS_NUM = r"regexp_matches(regexp_replace(trim(c), '[,$₹]', '', 'g'), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^(?i)[+-]?(nan|inf|infinity)$')"
_IS_DATE = r"regexp_matches(c, '(?i)" + "|".join(rules.DATE_LIKE_PATTERNS) + "')"


@query("tab_row_completeness", scored("c_custkey", "len(list_filter(rows[2:], lambda r: len(list_filter(r, lambda c: trim(c) = '')) = 0)) "
                                                   "/ CAST(len(rows) - 1 AS DOUBLE) * 100", _ROWS))
def tab_row_completeness(spark, sf_dir):
    return shown(I.source(spark, sf_dir, I.CSV_TEXT), ["c_custkey"], tabular.tabular_metric(F.col("text"), "Row Completeness"))


@query("tab_type_consistency", scored("c_custkey", "consistent / CAST(width AS DOUBLE) * 100", f"""(
  SELECT c_custkey, any_value(width) AS width, count(*) FILTER (WHERE n > 0 AND greatest(num, dat, n - num - dat) / CAST(n AS DOUBLE) > 0.8) AS consistent FROM (
    SELECT c_custkey, width, i, count(*) FILTER (WHERE c <> '') AS n, count(*) FILTER (WHERE c <> '' AND {_IS_NUM}) AS num,
      count(*) FILTER (WHERE c <> '' AND {_IS_DATE}) AS dat
    FROM (SELECT c_custkey, width, i, coalesce(trim(r[i]), '') AS c FROM (SELECT c_custkey, len(rows[1]) AS width, unnest(rows[2:]) AS r FROM {_ROWS}),
      unnest(range(1, width + 1)) AS t(i)) GROUP BY 1, 2, 3) GROUP BY c_custkey)"""))
def tab_type_consistency(spark, sf_dir):
    return shown(I.source(spark, sf_dir, I.CSV_TEXT), ["c_custkey"], tabular.tabular_metric(F.col("text"), "Column Type Consistency"))


_HEAD = f"(SELECT c_custkey, list_transform(rows[1], lambda c: trim(c)) AS h FROM {_ROWS})"


@query("tab_header_quality", scored("c_custkey", f"""100 - CASE WHEN list_contains(h, '') THEN 30 ELSE 0 END
  - CASE WHEN len(list_distinct(list_transform(h, lambda c: lower(c)))) < len(h) THEN 20 ELSE 0 END
  - CASE WHEN len(list_filter(h, lambda c: {_IS_NUM})) > len(h) * 0.5 THEN 25 ELSE 0 END
  - CASE WHEN len(list_filter(h, lambda c: c <> '' AND (length(c) < 2 OR length(c) > 50))) > 0 THEN 10 ELSE 0 END""", _HEAD))
def tab_header_quality(spark, sf_dir):
    return shown(I.source(spark, sf_dir, I.CSV_TEXT), ["c_custkey"], tabular.tabular_metric(F.col("text"), "Header Quality"))


_NULLS = "(" + ", ".join(f"'{w}'" for w in rules.NULL_WORDS) + ")"


@query("tab_null_ratio", scored("c_custkey", f"(1 - len(list_filter(flatten(rows[2:]), lambda c: lower(trim(c)) IN {_NULLS})) "
                                             "/ CAST(len(flatten(rows[2:])) AS DOUBLE)) * 100", _ROWS))
def tab_null_ratio(spark, sf_dir):
    return shown(I.source(spark, sf_dir, I.CSV_TEXT), ["c_custkey"], tabular.tabular_metric(F.col("text"), "Null/Empty Ratio"))


# ---------------------------------------------------------------- markup

_OPENED = r"list_transform(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)\b[^/>]*>', 1), lambda t: lower(t))"
_CLOSED = r"list_transform(regexp_extract_all(html, '</([a-zA-Z][a-zA-Z0-9]*)>', 1), lambda t: lower(t))"
_SELF = r"len(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)\b[^>]*/\s*>'))"
_VOID = "(" + ", ".join(f"'{t}'" for t in rules.VOID_TAGS) + ")"
_TAGS = f"""(SELECT p.page_id, n_open, n_self, coalesce(wrong, 0) AS wrong, coalesce(n, 0) AS n, coalesce(apart, '') AS mismatched FROM
  (SELECT page_id, len({_OPENED}) AS n_open, {_SELF} AS n_self FROM pages) p LEFT JOIN (
  SELECT page_id, sum(o) AS n, sum(abs(o - c)) AS wrong, string_agg('<' || tag || '>: ' || o || ' open, ' || c || ' close', chr(10) ORDER BY tag) FILTER (WHERE o <> c) AS apart FROM (
    SELECT page_id, tag, sum(o) AS o, sum(c) AS c FROM (
      SELECT page_id, unnest({_OPENED}) AS tag, 1 AS o, 0 AS c FROM pages UNION ALL SELECT page_id, unnest({_CLOSED}), 0, 1 FROM pages)
    WHERE tag NOT IN {_VOID} GROUP BY 1, 2 HAVING sum(o) > 0) GROUP BY 1) g ON g.page_id = p.page_id)"""
TAG_RAW = "CASE WHEN n_open = 0 AND n_self = 0 THEN 50 ELSE greatest(0, (1 - wrong / CAST(greatest(n + n_self, 1) AS DOUBLE)) * 100) END"


def _pages(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages"))


@query("markup_tags", scored("page_id, mismatched", TAG_RAW, _TAGS))
def markup_tags(spark, sf_dir):
    pages = _pages(spark, sf_dir).withColumn("mismatched", listed(F.sort_array(markup.mismatched_tags(F.col("html")))))
    return shown(pages, ["page_id", "mismatched"], markup.tag_validity(F.col("html")))


_DEPTHS = rf"""(SELECT page_id, max(s - least(0, low)) AS deepest FROM (
  SELECT page_id, s, min(s) OVER (PARTITION BY page_id ORDER BY pos) AS low FROM (
    SELECT page_id, pos, sum(d) OVER (PARTITION BY page_id ORDER BY pos) AS s FROM (
      SELECT page_id, pos, CASE WHEN tag LIKE '/%' THEN -1 ELSE 1 END AS d FROM (
        SELECT page_id, unnest(t) AS tag, generate_subscripts(t, 1) AS pos FROM (
          SELECT page_id, list_transform(regexp_extract_all(html, '<(/?[a-zA-Z][a-zA-Z0-9]*)\b[^>]*>', 1), lambda x: lower(x)) AS t FROM pages))
      WHERE ltrim(tag, '/') NOT IN {_VOID}))) GROUP BY page_id)"""


@query("markup_depth", f"""
SELECT p.page_id, CAST(coalesce(deepest, 0) AS BIGINT) AS max_depth,
  CAST(CASE WHEN deepest > 15 THEN 60 WHEN deepest > 10 THEN 80 WHEN deepest > 7 THEN 90 ELSE 100 END AS DOUBLE) AS score
FROM pages p LEFT JOIN {_DEPTHS} d ON d.page_id = p.page_id""")
def markup_depth(spark, sf_dir):
    return _pages(spark, sf_dir).select(
        "page_id", markup.max_depth(F.col("html")).cast("long").alias("max_depth"),
        markup.nesting_depth(F.col("html"))["score"].alias("score"))


def _pair(tag: str, attribute: str) -> tuple[str, str]:
    return (sql_count("html", rf"(?i)<{tag}\b"), sql_count("html", rf"(?i)<{tag}\b[^>]*\b{attribute}\s*="))


_PAIRS = [_pair(t, a) for t, a in rules.REQUIRED_ATTRIBUTES]
_ATTRS = "(SELECT page_id, " + " + ".join(t for t, _ in _PAIRS) + " AS due, " + " + ".join(f"least({a}, {t})" for t, a in _PAIRS) + " AS passed FROM pages)"
ATTR_RAW = sql_share("passed", "due")


@query("markup_attrs", scored("page_id", ATTR_RAW, _ATTRS))
def markup_attrs(spark, sf_dir):
    return shown(_pages(spark, sf_dir), ["page_id"], markup.attribute_completeness(F.col("html")))


ENC_RAW = (r"""100 - CASE WHEN len(list_distinct(list_transform(regexp_extract_all(html, '(?i)charset\s*=\s*["'']?([a-zA-Z0-9_-]+)', 1), lambda c: lower(c)))) > 1 THEN 30 ELSE 0 END"""
           + "".join(f" - CASE WHEN regexp_matches(html, '{p}') THEN 15 ELSE 0 END" for p, _ in rules.ENCODING_ARTIFACTS))


@query("markup_encoding", scored("page_id", ENC_RAW, "pages"))
def markup_encoding(spark, sf_dir):
    return shown(_pages(spark, sf_dir), ["page_id"], markup.encoding_consistency(F.col("html")))


@query("markup_gated", f"""
SELECT t.page_id, tag_score, CASE WHEN tag_score < 60 THEN tag_score ELSE depth_score END AS depth_score,
  CASE WHEN tag_score < 60 THEN tag_score ELSE attr_score END AS attr_score, CASE WHEN tag_score < 60 THEN tag_score ELSE enc_score END AS enc_score
FROM (SELECT page_id, {sql_score(TAG_RAW)} AS tag_score FROM {_TAGS}) t
JOIN (SELECT page_id, CAST(CASE WHEN deepest > 15 THEN 60 WHEN deepest > 10 THEN 80 WHEN deepest > 7 THEN 90 ELSE 100 END AS DOUBLE) AS depth_score FROM {_DEPTHS}) d USING (page_id)
JOIN (SELECT page_id, {sql_score(ATTR_RAW)} AS attr_score FROM {_ATTRS}) a USING (page_id)
JOIN (SELECT page_id, {sql_score(ENC_RAW)} AS enc_score FROM pages) e USING (page_id)""")
def markup_gated(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", markup.metrics(F.col("html")).alias("m")).select(
        "page_id", *[F.get("m", F.lit(i))["score"].alias(n) for i, n in enumerate(["tag_score", "depth_score", "attr_score", "enc_score"])])


# ---------------------------------------------------------------- e-mail

_MAIL = I.sql(I.MAIL_RAW)


def _has_header(name: str) -> str:
    return f"regexp_matches(raw, '(?im)^{name}:\\s*.+')"


@query("email_headers", scored("conv_id, turn", f"{flags(*map(_has_header, rules.REQUIRED_HEADERS))} / 4.0 * 80 + {flags(*map(_has_header, rules.OPTIONAL_HEADERS))} / 3.0 * 20", _MAIL))
def email_headers(spark, sf_dir):
    return shown(I.source(spark, sf_dir, I.MAIL_RAW), ["conv_id", "turn"], mail.header_completeness(F.col("raw")))


_ADDRESSES = " || ' ' || ".join(rf"regexp_extract(raw, '(?ims)^{h}:\s*(.+?)(?:\n\S|\n\n|\z)', 1)" for h in rules.ADDRESS_HEADERS)
_FOUND = f"(SELECT conv_id, turn, regexp_extract_all({_ADDRESSES}, '{rules.ADDRESS_PATTERN}') AS found FROM {_MAIL})"


@query("email_recipients", scored("conv_id, turn", "CASE WHEN len(found) = 0 THEN 50 ELSE len(list_filter(found, lambda a: contains(split_part(a, '@', 2), '.') "
                                                  "AND length(split_part(a, '@', 2)) > 3)) / CAST(len(found) AS DOUBLE) * 100 END", _FOUND))
def email_recipients(spark, sf_dir):
    return shown(I.source(spark, sf_dir, I.MAIL_RAW), ["conv_id", "turn"], mail.recipient_validation(F.col("raw")))


def body_sql(ids: str, source: str) -> str:
    words = r"len(list_filter(regexp_split_to_array(clean, '\s+'), lambda w: w <> ''))"
    clean = sql_strip(r"regexp_replace(regexp_replace(body, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')")
    return f"""(SELECT {ids}, body, {words} AS words, length(clean) / CAST(greatest(length(body), 1) AS DOUBLE) AS ratio FROM (
      SELECT {ids}, body, {clean} AS clean FROM (
        SELECT {ids}, CASE WHEN contains(raw, chr(10) || chr(10)) THEN substr(raw, strpos(raw, chr(10) || chr(10)) + 2) ELSE raw END AS body FROM {source})))"""


BODY_RAW = ("100 - CASE WHEN words < 5 THEN 40 WHEN words < 20 THEN 15 ELSE 0 END - CASE WHEN length(body) > 100 AND ratio < 0.3 THEN 20 ELSE 0 END "
            "- CASE WHEN words < 50 AND " + flags(*[f"contains(lower(body), '{d}')" for d in rules.DISCLAIMERS]) + " > 2 THEN 10 ELSE 0 END")


@query("email_body", scored("p_partkey", BODY_RAW, body_sql("p_partkey", I.sql(I.SHORT_MAIL))))
def email_body(spark, sf_dir):
    return shown(I.source(spark, sf_dir, I.SHORT_MAIL), ["p_partkey"], mail.body_quality(F.col("raw")))


@query("email_attachment", scored("conv_id, turn", r"CASE WHEN regexp_matches(" + FOLD.format("raw") + r", '(?i)" + rules.ATTACHMENT_WORDS + r"') AND NOT regexp_matches(raw, "
                                  r"'(?i)Content-Disposition:\s*attachment|Content-Type:\s*multipart') THEN 40 ELSE 100 END", _MAIL))
def email_attachment(spark, sf_dir):
    return shown(I.source(spark, sf_dir, I.MAIL_RAW), ["conv_id", "turn"], mail.attachment_check(F.col("raw")))


# ---------------------------------------------------------------- general

_PROSE = I.sql(I.GENERAL_TEXT)


def structure_raw(text: str = "text") -> str:
    return (f"100 - CASE WHEN regexp_matches({text}, '(?m){rules.HEADING_PATTERN}') THEN 0 ELSE 15 END "
            f"- CASE WHEN len(list_filter(list_transform(regexp_split_to_array({text}, '\\n\\s*\\n'), lambda p: {sql_strip('p')}), lambda p: p <> '')) > 1 THEN 0 ELSE 10 END "
            f"- CASE WHEN len({SQL_WORDS}) < 20 THEN 25 ELSE 0 END")


@query("gen_structure", scored("doc_id", structure_raw(), _PROSE))
def gen_structure(spark, sf_dir):
    return shown(I.source(spark, sf_dir, I.GENERAL_TEXT), ["doc_id"], general.structure_quality(F.col("text")))


def readability_sql(ids: str, source: str) -> str:
    return f"""(SELECT {ids}, CAST(len({SQL_WORDS}) AS DOUBLE) AS w, {SQL_SYLLABLE_SUM} AS syl,
      greatest(1, len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+\\s+'), lambda p: {sql_strip('p')}), lambda p: p <> ''))) AS s FROM {source})"""


READ_RAW = "CASE WHEN w < 10 THEN 50 ELSE greatest(0, least(100, 206.835::DOUBLE - 1.015::DOUBLE * (w / s) - 84.6::DOUBLE * (syl / w))) END"


@query("gen_readability", scored("doc_id", READ_RAW, readability_sql("doc_id", _PROSE)))
def gen_readability(spark, sf_dir):
    return shown(I.source(spark, sf_dir, I.GENERAL_TEXT), ["doc_id"], general.readability(F.col("text")))


SECTION_FOUND = flags(sql_hit(LOW, rules.INTRO_PATTERNS), f"{sql_count('text', rules.BODY_PATTERN)} >= 2", sql_hit(LOW, rules.CONCLUSION_PATTERNS))
SECTION_RAW = "CASE WHEN found = 0 THEN 50 ELSE found * 33.3 END"


@query("gen_sections", scored("doc_id", SECTION_RAW, f"(SELECT doc_id, {SECTION_FOUND} AS found FROM {_PROSE})"))
def gen_sections(spark, sf_dir):
    return shown(I.source(spark, sf_dir, I.GENERAL_TEXT), ["doc_id"], general.section_completeness(F.col("text")))


_STOP = "(" + ", ".join(f"'{w}'" for w in rules.STOP_WORDS) + ")"


def keyword_sql(ids: str, source: str) -> str:
    on = " AND ".join(f"a.{i.strip()} = b.{i.strip()}" for i in ids.split(","))
    selected = ", ".join(f"a.{i.strip()}" for i in ids.split(","))
    return f"""(SELECT {selected}, n, coalesce(total, 0) AS total, top, distinct_words FROM (
      SELECT {ids}, len(list_filter({_LOWTOK}, lambda w: regexp_full_match(w, '[a-z]{{3,}}'))) AS n FROM {source}) a LEFT JOIN (
      SELECT {ids}, sum(c) AS total, max(c) AS top, count(*) AS distinct_words FROM (
        SELECT {ids}, w, count(*) AS c FROM (SELECT {ids}, unnest({_LOWTOK}) AS w FROM {source})
        WHERE regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN {_STOP} GROUP BY ALL) GROUP BY ALL) b ON {on})"""


KEYWORD_RAW = """CASE WHEN n < 20 OR total = 0 THEN 100 ELSE 100 - CASE WHEN top / CAST(total AS DOUBLE) > 0.15 THEN 30
  WHEN top / CAST(total AS DOUBLE) > 0.08 THEN 15 ELSE 0 END - CASE WHEN distinct_words / CAST(total AS DOUBLE) < 0.3 THEN 15 ELSE 0 END END"""


@query("gen_keywords", scored("doc_id", KEYWORD_RAW, keyword_sql("doc_id", _PROSE)))
def gen_keywords(spark, sf_dir):
    return shown(I.source(spark, sf_dir, I.GENERAL_TEXT), ["doc_id"], general.keyword_density(F.col("text")))
