"""Queries over sources, text helpers and classification."""

from html.entities import name2codepoint

from pyspark.sql import functions as F

from docgauge import rules
from docgauge.functions import text as X
from docgauge.functions import values as V
from docgauge.operators import classify, core, records
from docgauge.plans import inputs as I
from docgauge.plans.catalog import query, table
from docgauge.sources import readers
from docgauge.sources import xml_records as xml


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


SQL_EXT = r"lower(regexp_extract(filename, '[^.](\.[^.]+)$', 1))"
SQL_NUMBER = r"'^[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?$'"


def sql_number(value: str, drop: str) -> str:
    clean = rf"trim(regexp_replace({value}, '{drop}', '', 'g'))"
    return f"CASE WHEN regexp_matches({clean}, {SQL_NUMBER}) THEN try_cast(replace({clean}, '_', '') AS double) END"


SQL_DATE_FORMATS = ("['%Y-%m-%d', '%m/%d/%Y', '%d/%m/%Y', '%Y/%m/%d', '%d-%m-%Y', '%m-%d-%Y', "
                    "'%B %d, %Y', '%b %d, %Y', '%d %B %Y', '%d %b %Y', '%Y.%m.%d', '%d.%m.%Y']")


def sql_date(value: str) -> str:
    return f"cast(try_strptime(trim({value}), {SQL_DATE_FORMATS}) AS date)"


# ---------------------------------------------------------------- sources

@query("filter_supported_files", f"""
SELECT doc_id, filename, {SQL_EXT} AS ext FROM {I.sql(I.FILES)}
WHERE list_contains({sql_list(rules.SUPPORTED_EXTENSIONS)}, {SQL_EXT})""")
def filter_supported_files(spark, sf_dir):
    df = I.source(spark, sf_dir, I.FILES)
    return df.where(readers.is_supported(F.col("filename"))).select(
        "doc_id", "filename", X.extension(F.col("filename")).alias("ext"))


@query("quarantine_files", f"""
SELECT doc_id, filename, CASE WHEN NOT list_contains({sql_list(rules.SUPPORTED_EXTENSIONS)}, {SQL_EXT})
  THEN 'unsupported type' ELSE 'too large' END AS reason
FROM {I.sql(I.FILES)}
WHERE NOT list_contains({sql_list(rules.SUPPORTED_EXTENSIONS)}, {SQL_EXT}) OR strlen(text) > 4096""")
def quarantine_files(spark, sf_dir):
    df = I.source(spark, sf_dir, I.FILES)
    supported = readers.is_supported(F.col("filename"))
    fits = readers.fits(F.octet_length("text"), 4096)
    reason = F.when(~supported, "unsupported type").otherwise("too large")
    return df.where(~supported | ~fits).select("doc_id", "filename", reason.alias("reason"))


@query("filter_file_size", f"""
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE strlen(text) <= {rules.MAX_FILE_BYTES}""")
def filter_file_size(spark, sf_dir):
    size = F.octet_length("text").cast("long")
    return table(spark, sf_dir, "documents").where(readers.fits(size)).select("doc_id", size.alias("size"))


FLAT = {
    "id": "concat('[', {i}, '] id: ', event_id, chr(10))",
    "kind": "concat('[', {i}, '] kind: ', event_type, chr(10))",
    "value": "concat('[', {i}, '] value: ', cast(value AS string), chr(10))",
    "props": "concat('[', {i}, '] props: k: ', json_extract_string(props, '$.k'), chr(10))",
    "tags": "concat('[', {i}, '] tags: [0] ', user_id, chr(10), '[', {i}, '] tags: [1] ', "
            "CASE event_id % 3 WHEN 0 THEN '2' WHEN 1 THEN 'x' ELSE '[0] 1' END, chr(10))",
    "note": "concat('[', {i}, '] note: ', cast(value AS string), chr(10))",
}


def flat(i: int, *keys: str) -> str:
    return " || ".join(FLAT[k].replace("{i}", str(i)) for k in keys)


ALL_KEYS = ("id", "kind", "value", "props", "tags")


@query("json_flatten", f"""
SELECT event_id, rtrim({flat(0, *ALL_KEYS)} || CASE event_id % 5 WHEN 1 THEN {flat(1, 'id', 'kind', 'props')}
  WHEN 2 THEN '[1] None' || chr(10) WHEN 0 THEN {flat(1, *ALL_KEYS)} ELSE {flat(1, 'kind', 'id', 'value', 'props', 'tags')} END
  || CASE WHEN event_id % 7 = 0 THEN {flat(2, *ALL_KEYS, 'note')} ELSE {flat(2, *ALL_KEYS)} END, chr(10)) AS text
FROM events""")
def json_flatten(spark, sf_dir):
    return records.with_flat_text(I.source(spark, sf_dir, I.EVENT_JSON), "raw", "text").select("event_id", "text")


@query("json_parse", "SELECT doc_id, json_valid(text) AS is_json FROM documents UNION ALL SELECT event_id, json_valid(props) FROM events")
def json_parse(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw"))
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("raw"))
    return docs.unionByName(events).select("doc_id", F.when(F.col("raw").isNotNull(), V.parse_json(F.col("raw")).isNotNull()).alias("is_json"))


@query("csv_row_text", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || ', Inc ' || c_custkey || '  ' || c_mktsegment WHEN 1 THEN ' ' || c_name || ' ' || c_mktsegment
  WHEN 2 THEN c_custkey || ' l1' || chr(10) || 'l2 ' || c_name || chr(10) || 'x ' ELSE 'say "' || c_name || '" 5" pipe ' END AS text FROM customer""")
def csv_row_text(spark, sf_dir):
    return I.source(spark, sf_dir, I.CSV_LINES).select("c_custkey", readers.csv_row_text(F.col("line")).alias("text"))


@query("xml_to_text", "SELECT p_partkey, concat_ws(chr(10), p_name, p_brand, p_type, 'café — &lt; it’s') AS text FROM part")
def xml_to_text(spark, sf_dir):
    return I.source(spark, sf_dir, I.PART_XML).select("p_partkey", X.xml_to_text(F.col("xml")).alias("text"))


PART_SCHEMA = "_id long, _kind string, name string, tag array<string>, size struct<_unit:string,_VALUE:int>, box struct<no:array<int>>"
_CUT = "p_partkey % 9 = 1 AND p_partkey % 7 <> 0"
_TAGS_OF_PART = "concat_ws(',', CASE WHEN p_partkey % 2 = 0 THEN 'even' END, p_brand, CASE WHEN p_partkey % 3 = 0 THEN 'third' END)"


@query("xml_records", f"""
SELECT p_partkey, {_CUT} AS broken, CASE WHEN NOT ({_CUT}) THEN p_partkey END AS id, CASE WHEN NOT ({_CUT}) THEN p_type END AS kind,
  CASE WHEN NOT ({_CUT}) THEN p_name || ' & co' END AS name, CASE WHEN NOT ({_CUT}) THEN {_TAGS_OF_PART} END AS tags,
  CASE WHEN NOT ({_CUT}) AND p_partkey % 5 <> 0 THEN CAST(p_size AS INTEGER) END AS size, CASE WHEN NOT ({_CUT}) AND p_partkey % 5 <> 0 THEN 'cm' END AS unit,
  CASE WHEN NOT ({_CUT}) AND p_partkey % 7 = 0 THEN 7 END AS boxed, CASE WHEN {_CUT} THEN 0 ELSE 4 + CAST(p_partkey % 5 <> 0 AS BIGINT) + CAST(p_partkey % 7 = 0 AS BIGINT) END AS n_fields,
  concat_ws(chr(10), p_name || ' & co', replace({_TAGS_OF_PART}, ',', chr(10)), CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS VARCHAR) END,
    CASE WHEN p_partkey % 7 = 0 THEN '7' WHEN p_partkey % 9 = 1 THEN '9' END) AS text FROM part""")
def xml_records(spark, sf_dir):
    """Parts as XML documents read under a schema; those that end early keep their text."""
    rows = xml.with_records(I.source(spark, sf_dir, I.PART_RECORDS), "xml", PART_SCHEMA)
    n_fields = F.coalesce(F.size(xml.record_fields("record", PART_SCHEMA)), F.lit(0))
    return rows.select(
        "p_partkey", "broken", F.col("record._id").alias("id"), F.col("record._kind").alias("kind"), "record.name",
        F.when(~F.col("broken"), F.array_join("record.tag", ",")).alias("tags"), F.col("record.size._VALUE").alias("size"),
        F.col("record.size._unit").alias("unit"), F.get("record.box.no", F.lit(0)).alias("boxed"),
        F.when(F.col("broken"), 0).otherwise(n_fields).cast("long").alias("n_fields"), "text")


SQL_UNESCAPE = "x"
# every named reference by its code point, the ampersand's last
for _name, _point in [*((n, p) for n, p in name2codepoint.items() if n != "amp"), ("#39", 39), ("apos", 39), ("amp", 38)]:
    SQL_UNESCAPE = f"replace({SQL_UNESCAPE}, '&{_name};', chr({_point}))"

SQL_NODES = (r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', chr(10), 'g'), "
             r"'(?is)<script\b[^>]*>.*?</script\s*>', chr(10), 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', chr(10), 'g'), "
             r"'(?s)<[!?/]?[a-zA-Z][^>]*>', chr(1), 'g')")


@query("html_to_text", f"""
SELECT page_id, array_to_string(list_transform(list_filter(
    list_transform(string_split({SQL_NODES}, chr(1)), lambda p: {sql_strip('p')}), lambda p: p <> ''), lambda x: {SQL_UNESCAPE}), chr(10)) AS text
FROM pages""")
def html_to_text(spark, sf_dir):
    return readers.spread(table(spark, sf_dir, "pages")).select("page_id", X.html_to_text(F.col("html")).alias("text"))


@query("eml_extract", """
SELECT conv_id, turn, 'Subject: turn ' || turn || chr(10) || 'From: ' || role || '@example.com' || chr(10) || text ||
  CASE WHEN (conv_id + turn) % 4 = 0 THEN ' Please find attached the report. Confidential. Disclaimer: unsubscribe.' ELSE '' END AS text
FROM conversations""")
def eml_extract(spark, sf_dir):
    return I.source(spark, sf_dir, I.MAIL_RAW).select("conv_id", "turn", X.mail_to_text(F.col("raw")).alias("text"))


@query("eml_parts", """
SELECT conv_id, turn, 'Subject: Über turn ' || turn || chr(10) || 'From: ' || role || '@example.com' || chr(10) ||
  CASE WHEN (conv_id + turn) % 3 < 2 THEN text ELSE 'caf' || chr(65533) || ' = café' END AS text FROM conversations""")
def eml_parts(spark, sf_dir):
    return I.source(spark, sf_dir, I.MAIL_PARTS).select("conv_id", "turn", X.mail_to_text(F.col("raw")).alias("text"))


@query("table_cells_text", "SELECT p_partkey, concat_ws(' | ', p_name, p_brand, p_type) AS text FROM part")
def table_cells_text(spark, sf_dir):
    cells = F.array(F.col("p_name"), F.lit(""), F.concat(F.lit(" "), "p_brand"), F.lit("  "), F.col("p_type"))
    return I.source(spark, sf_dir, I.PART_CELLS).select("p_partkey", X.join_cells(cells).alias("text"))


# ---------------------------------------------------------------- text helpers

@query("normalize_text", rf"""
SELECT doc_id, {sql_strip(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[^\S\n]+', ' ', 'g'), '(?m)^ | $', '', 'g')")} AS text
FROM {I.sql(I.MESSY_TEXT)}""")
def normalize_text(spark, sf_dir):
    return I.source(spark, sf_dir, I.MESSY_TEXT).select("doc_id", X.normalize_text(F.col("text")).alias("text"))


@query("parse_dates", f"SELECT o_orderkey, value, {sql_date('value')} AS day FROM {I.sql(I.ORDER_DATES)}")
def parse_dates(spark, sf_dir):
    return I.source(spark, sf_dir, I.ORDER_DATES).select("o_orderkey", "value", V.parse_date(F.col("value")).alias("day"))


@query("parse_amounts", rf"""
SELECT o_orderkey, value, {sql_number('value', r'[,$€£¥\s]')} AS amount, {sql_number('value', r'[,$€£¥₹\s]')} AS invoice_amount,
  regexp_matches(trim(regexp_replace(value, '[,$₹]', '', 'g')), {SQL_NUMBER}) AS is_numeric,
  regexp_matches(value, '(?i)\d{{4}}-\d{{2}}-\d{{2}}|\d{{2}}/\d{{2}}/\d{{4}}|\d{{2}}-\d{{2}}-\d{{4}}|\d{{1,2}}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)') AS is_date_like
FROM {I.sql(I.AMOUNTS)}""")
def parse_amounts(spark, sf_dir):
    value = F.col("value")
    return I.source(spark, sf_dir, I.AMOUNTS).select(
        "o_orderkey", "value", V.parse_amount(value).alias("amount"), V.parse_invoice_amount(value).alias("invoice_amount"),
        V.is_numeric(value).alias("is_numeric"), V.is_date_like(value).alias("is_date_like"))


SQL_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
SQL_BARE = "trim(lower(w), '.,;:!?\"''()[]{}')"
SQL_GROUPS = f"len(regexp_extract_all({SQL_BARE}, '[aeiouy]+'))"
SQL_SYLLABLES = (f"CASE WHEN length({SQL_BARE}) <= 2 THEN 1 ELSE greatest(1, {SQL_GROUPS} - "
                 f"CASE WHEN {SQL_GROUPS} > 1 AND {SQL_BARE} LIKE '%e' THEN 1 ELSE 0 END) END")
SQL_SYLLABLE_SUM = f"CAST(coalesce(list_sum(list_transform({SQL_WORDS}, lambda w: {SQL_SYLLABLES})), 0) AS BIGINT)"


@query("syllables", f"SELECT doc_id, {SQL_SYLLABLE_SUM} AS syllables FROM documents")
def syllables(spark, sf_dir):
    docs = readers.spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", X.text_syllables(F.col("text")).cast("long").alias("syllables"))


@query("delimiter_sniff", """
SELECT c_custkey, CASE WHEN s > greatest(c, t, p) THEN ';' WHEN p > greatest(c, t) THEN '|' WHEN t > c THEN chr(9) ELSE ',' END AS delimiter
FROM (SELECT c_custkey, length(line) - length(replace(line, ',', '')) AS c, length(line) - length(replace(line, chr(9), '')) AS t,
  length(line) - length(replace(line, '|', '')) AS p, length(line) - length(replace(line, ';', '')) AS s FROM """ + I.sql(I.HEADER_LINES) + ")")
def delimiter_sniff(spark, sf_dir):
    return I.source(spark, sf_dir, I.HEADER_LINES).select("c_custkey", X.delimiter_of(F.col("line")).alias("delimiter"))


@query("format_patterns", "SELECT c_custkey, " + ", ".join(
    f"regexp_matches(value, '{p}') AS is_{n}" for n, p in rules.FORMAT_PATTERNS.items()) + f" FROM {I.sql(I.FORMATTED)}")
def format_patterns(spark, sf_dir):
    return I.source(spark, sf_dir, I.FORMATTED).select("c_custkey", *[
        core.matches_format(F.lit(n), F.col("value")).alias(f"is_{n}") for n in rules.FORMAT_PATTERNS])


SQL_TOKENS = r"regexp_split_to_array({text}, '[^\p{L}\p{N}_]+')"


@query("token_counts", f"""
SELECT doc_id, CAST(len({SQL_WORDS}) AS BIGINT) AS words,
  CAST(len(list_filter({SQL_TOKENS.replace('{text}', 'text')}, lambda w: regexp_full_match(w, '[a-zA-Z]+'))) AS BIGINT) AS latin_words,
  CAST(len(list_filter({SQL_TOKENS.replace('{text}', 'lower(text)')}, lambda w: regexp_full_match(w, '[a-z]{{3,}}'))) AS BIGINT) AS long_words,
  CAST(len(list_filter(list_transform(regexp_split_to_array(text, '\\n'), lambda p: {sql_strip('p')}), lambda p: p <> '')) AS BIGINT) AS lines,
  CAST(len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+\\s+'), lambda p: {sql_strip('p')}), lambda p: p <> '')) AS BIGINT) AS sentences
FROM documents""".replace("\\\\", "\\"))
def token_counts(spark, sf_dir):
    text = F.col("text")
    count = lambda c, n: F.size(c).cast("long").alias(n)
    return readers.spread(table(spark, sf_dir, "documents")).select(
        "doc_id", X.token_count(text).cast("long").alias("words"), count(X.latin_words(text), "latin_words"),
        count(X.latin_words(F.lower(text), 3), "long_words"), count(X.content_lines(text), "lines"),
        count(X.stripped_parts(text, X.rx(r"[.!?]+\s+")), "sentences"))


# ---------------------------------------------------------------- classification

def sql_detect(text: str, filename: str) -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + f" THEN '{kind}'"
        for kind, words in rules.TYPE_KEYWORDS)
    return f"CASE WHEN lower({filename}) LIKE '%.json' THEN 'json' {cases} ELSE 'unknown' END"


@query("detect_type", f"SELECT doc_id, {sql_detect('text', 'filename')} AS document_type FROM {I.sql(I.FILES)}")
def detect_type(spark, sf_dir):
    return I.source(spark, sf_dir, I.FILES).select(
        "doc_id", classify.detect_type(F.col("text"), F.col("filename")).alias("document_type"))


SUPPLIED = "CASE doc_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'Invoice ' WHEN 2 THEN '' ELSE 'tweet' END"


@query("resolve_type", f"""
SELECT doc_id, CASE WHEN {SUPPLIED} = 'unknown' THEN {sql_detect('text', 'filename')} ELSE {SUPPLIED} END AS document_type
FROM {I.sql(I.CONTRACT_TEXT).replace('doc_id AS doc_id', "doc_id AS doc_id, 'x.txt' AS filename")}""")
def resolve_type(spark, sf_dir):
    return I.source(spark, sf_dir, I.CONTRACT_TEXT).select(
        "doc_id", classify.resolve_type(F.expr(SUPPLIED), F.col("text"), F.lit("x.txt")).alias("document_type"))


def sql_map(table_: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table_.items()) + "}"


ALIASES = {a: f for f, names in rules.FAMILY_ALIASES.items() for a in names}


@query("route_types", f"""
SELECT doc_id, coalesce({sql_map(rules.EXTENSION_FAMILY)}[{SQL_EXT}], {sql_map(ALIASES)}[lower(trim({SUPPLIED}))], 'general') AS family
FROM {I.sql(I.FILES)}""")
def route_types(spark, sf_dir):
    return I.source(spark, sf_dir, I.FILES).select(
        "doc_id", classify.metric_family(X.extension(F.col("filename")), F.expr(SUPPLIED)).alias("family"))


@query("proto_detect_type", f"""
SELECT o_orderkey, CASE WHEN filename LIKE '%.json' THEN 'JSON' WHEN contains(lower(text), 'invoice') THEN 'Invoice'
  WHEN contains(lower(text), 'agreement') OR contains(lower(text), 'termination') THEN 'Contract' ELSE 'Social Media' END AS document_type
FROM {I.sql(I.PROTO_TEXT)}""")
def proto_detect_type(spark, sf_dir):
    return I.source(spark, sf_dir, I.PROTO_TEXT).select(
        "o_orderkey", classify.proto_detect_type(F.col("text"), F.col("filename")).alias("document_type"))
