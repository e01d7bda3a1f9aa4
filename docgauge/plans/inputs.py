"""Documents derived from the given tables.

Each input is a list of (expression, name) pairs in SQL that Spark and other
engines read alike, applied to every row of one table. They add the keywords,
headers and defects the plain rows lack; one row in, one document out.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.functions import values as V
from docgauge.functions.text import in_pieces
from docgauge.plans.catalog import table
from docgauge.sources.readers import spread

NL = "chr(10)"
MONTHS = ["January", "February", "March", "April", "May", "June", "July",
          "August", "September", "October", "November", "December"]


def when(test: str, text: str) -> str:
    return f"CASE WHEN {test} THEN '{text}' ELSE '' END"


def pick(key: str, options: list[str]) -> str:
    """Option by remainder of the key; options are SQL expressions."""
    cases = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options))
    return f"CASE {key} % {len(options)} {cases} END"


MONTH_NAME = "CASE month(o_orderdate) " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MONTHS, 1)) + " END"
MONTH_SHORT = "CASE month(o_orderdate) " + " ".join(f"WHEN {i} THEN '{m[:3]}'" for i, m in enumerate(MONTHS, 1)) + " END"
Y, M, D = ("cast(year(o_orderdate) AS string)", "cast(month(o_orderdate) AS string)", "cast(day(o_orderdate) AS string)")


def joined(separator: str, *parts: str) -> str:
    return "concat(" + f", '{separator}', ".join(parts) + ")"


FILES = ("documents", [
    ("doc_id", "doc_id"),
    ("concat('file', cast(doc_id AS string), " + pick("doc_id", [
        "'.PDF'", "'.txt'", "'.exe'", "'.tar.gz'", "''", "'.JSON'", "'.htm'", "'.csv'", "'.eml'", "'.xml'", "'.docx'"]) + ")",
     "filename"),
    ("text", "text"),
])

MESSY_TEXT = ("documents", [
    ("doc_id", "doc_id"),
    (f"concat('  ', replace(replace(text, '. ', concat(' ', chr(13), {NL}, chr(13), {NL}, {NL}, {NL}, '  ')), ' ', '  '), chr(9), ' ')", "text"),
])

ORDER_DATES = ("orders", [
    ("o_orderkey", "o_orderkey"),
    (pick("o_orderkey", [
        joined("-", Y, M, D), joined("/", M, D, Y), joined("/", D, M, Y), joined("/", Y, M, D),
        joined("-", D, M, Y), joined("-", M, D, Y), f"concat({MONTH_NAME}, ' ', {D}, ', ', {Y})",
        f"concat(' ', {MONTH_SHORT}, ' ', {D}, ', ', {Y}, ' ')", joined(" ", D, MONTH_NAME, Y), joined(" ", D, MONTH_SHORT, Y),
        joined(".", Y, M, D), joined(".", D, M, Y), f"concat({Y}, '-13-45')", "'99/99/9999'", "'n/a'"]), "value"),
])

AMOUNTS = ("orders", [
    ("o_orderkey", "o_orderkey"),
    (pick("o_orderkey", [
        "cast(o_totalprice AS string)", "concat('$', cast(o_totalprice AS string))", "concat('€ ', cast(o_orderkey AS string), ',000.50')",
        "concat('₹', cast(o_custkey AS string))", "'forty-two'", "''", "concat(cast(o_custkey AS string), '_000')",
        "concat(cast(o_custkey AS string), 'e2')", "concat('-', cast(o_custkey AS string), '.')", "'1.0d'", "'12 34'",
        "concat(cast(o_custkey AS string), ' 12 Mar')", "concat('£', cast(o_custkey AS string), '.25 ')"]), "value"),
])

FORMATTED = ("customer", [
    ("c_custkey", "c_custkey"),
    (pick("c_custkey", [
        "concat('user', cast(c_custkey AS string), '@example.com')", "'bad@@mail'", "concat('+', cast(c_nationkey AS string), ' 555-0100')",
        "'call me'", "'2024-01-15'", "concat('$', cast(c_custkey AS string))", "'$1,234.50'", "'12345-6789'", "'SW1A 1AA'",
        "concat('https://example.com/', cast(c_custkey AS string))", "'http://a b'", "cast(10000 + c_custkey AS string)"]), "value"),
])

HEADER_LINES = ("customer", [
    ("c_custkey", "c_custkey"),
    (pick("c_custkey", [
        "'id,name,segment'", "'id|name|segment'", "'id;name;segment;nation'", "'id,name|segment'", "'id;a,b'",
        f"concat('id', chr(9), 'name')", "'single'"]), "line"),
])

CSV_LINES = ("customer", [
    ("c_custkey", "c_custkey"),
    ("CASE c_custkey % 4 WHEN 0 THEN concat('\"', c_name, ', Inc', '\",', cast(c_custkey AS string), ',,', c_mktsegment) "
     "WHEN 1 THEN concat(',', c_name, ',', c_mktsegment) "
     f"WHEN 2 THEN concat(cast(c_custkey AS string), ',\"l1', {NL}, 'l2\",', c_name, {NL}, 'x,') "
     "ELSE concat('\"say \"\"', c_name, '\"\"\",5\" pipe,') END", "line"),
])

PART_XML = ("part", [
    ("p_partkey", "p_partkey"),
    ("concat('<?xml version=\"1.0\"?><part id=\"', cast(p_partkey AS string), '\"><!-- x --><name>', p_name, '</name><brand> ', p_brand, "
     "' </brand><empty/><type><![CDATA[', p_type, ']]></type><note>caf&#233; &#x2014; &amp;lt; it&#146;s</note></part>')", "xml"),
])

# attributes, repeated and nested elements; some rows end early, some lack elements
PART_RECORDS = ("part", [
    ("p_partkey", "p_partkey"),
    ("concat('<part id=\"', cast(p_partkey AS string), '\" kind=\"', p_type, '\"><name>', p_name, ' &amp; co</name>', "
     + when("p_partkey % 2 = 0", "<tag>even</tag>") + ", '<tag>', p_brand, '</tag>', "
     + when("p_partkey % 3 = 0", "<tag>third</tag>") + ", "
     "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('<size unit=\"cm\">', cast(p_size AS string), '</size>') END, "
     "CASE WHEN p_partkey % 7 = 0 THEN '<box><no>7</no></box>' WHEN p_partkey % 9 = 1 THEN '<box><no>9' ELSE '' END, '</part>')", "xml"),
])

PART_CELLS = ("part", [
    ("p_partkey", "p_partkey"), ("p_name", "p_name"), ("p_brand", "p_brand"), ("p_type", "p_type"),
])

CONTRACT_TEXT = ("documents", [
    ("doc_id", "doc_id"),
    ("concat(text, "
     + when("doc_id % 2 = 0", " The termination clause allows cancellation of this agreement.") + ", "
     + when("doc_id % 3 = 0", " Liability is limited and the supplier shall indemnify the client.") + ", "
     + when("doc_id % 5 = 0", " Governing Law: disputes go to arbitration. Payment terms apply.") + ", "
     + when("doc_id % 7 = 0", " Signed by: A. Witness B. Date of signing below. Party A: ____") + ", "
     + when("doc_id % 11 = 0", " This contract will automatically renew. Unlimited liability.") + ", "
     + when("doc_id % 13 = 0", " A penalty clause and a non-compete apply. Force majeure, warranty and copyright.") + ", "
     + when("doc_id % 17 = 0", " The authorized signatory may assign without prior consent.") + ")", "text"),
])

CHAT_TEXT = ("conversations", [
    ("conv_id", "conv_id"), ("turn", "turn"), ("role", "role"),
    ("concat(text, "
     + when("(conv_id + turn) % 2 = 0", " lol u r gr8 omg gonna wanna idk") + ", "
     + when("(conv_id + turn) % 3 = 0", " BUY NOW AT HTTPS NOW click here https://a.example/x https://b.example/y #sale") + ", "
     + when("(conv_id + turn) % 5 = 0", " you stupid idiot. go die. watch your back") + ", "
     + when("(conv_id + turn) % 7 = 0", " #a #b #c #d #e #f #g #h #i #j #k subscribe and earn money. earn money. earn money.") + ", "
     + when("(conv_id + turn) % 11 = 0", " the end of the day is in the name of the law and it is for the best") + ")", "text"),
])

MAIL_RAW = ("conversations", [
    ("conv_id", "conv_id"), ("turn", "turn"),
    (f"concat('From: ', role, '@example.com', {NL}, "
     f"CASE WHEN conv_id % 3 = 0 THEN '' ELSE concat('To: User ', cast(conv_id AS string), ' <u', cast(conv_id AS string), '@mail.example.org>,', {NL}, ' second@x.co', {NL}) END, "
     f"'Subject: turn ', cast(turn AS string), {NL}, "
     f"CASE WHEN turn % 2 = 0 THEN concat('Date: Mon, 1 Jan 2024 00:00:00 +0000', {NL}) ELSE '' END, "
     f"CASE WHEN conv_id % 5 = 0 THEN concat('MIME-Version: 1.0', {NL}, 'Content-Type: text/plain', {NL}) ELSE '' END, "
     f"{NL}, text, "
     + when("(conv_id + turn) % 4 = 0", " Please find attached the report. Confidential. Disclaimer: unsubscribe.") + ")", "raw"),
])

# a part inside a part, encoded bodies and an encoded subject
MAIL_PARTS = ("conversations", [
    ("conv_id", "conv_id"), ("turn", "turn"),
    (f"concat('From: ', role, '@example.com', {NL}, 'Subject: =?utf-8?Q?=C3=9Cber_?=', {NL}, ' =?UTF-8?B?dHVybg==?= ', cast(turn AS string), {NL}, "
     "CASE (conv_id + turn) % 3 WHEN 0 THEN concat("
     f"'Content-Type: multipart/mixed; boundary=\"AA\"', {NL}, {NL}, 'preamble', {NL}, '--AA', {NL}, 'Content-Type: multipart/alternative; boundary=BB', {NL}, {NL}, "
     f"'--BB', {NL}, 'Content-Type: text/html', {NL}, {NL}, '<p>html</p>', {NL}, '--BB', {NL}, 'Content-Type: text/plain; charset=utf-8', {NL}, "
     f"'Content-Transfer-Encoding: base64', {NL}, {NL}, base64(cast(text AS binary)), {NL}, '--BB--', {NL}, "
     f"'--AA', {NL}, 'Content-Type: text/plain', {NL}, 'Content-Disposition: attachment', {NL}, {NL}, 'file', {NL}, '--AA--', {NL}) "
     f"WHEN 1 THEN concat('Content-Type: text/plain; charset=utf-8', {NL}, 'Content-Transfer-Encoding: quoted-printable', {NL}, {NL}, "
     f"replace(replace(text, '=', '=3D'), ' ', concat('=20=', {NL}))) "
     f"ELSE concat('Content-Type: text/html', {NL}, 'Content-Transfer-Encoding: quoted-printable', {NL}, {NL}, '<p>caf=E9 =3D caf&eacute;</p>') END)", "raw"),
])

SHORT_MAIL = ("part", [
    ("p_partkey", "p_partkey"),
    (f"concat('Subject: ', p_name, {NL}, {NL}, " + pick("p_partkey", [
        "'ok'", "'<p>one two three four five six</p>'",
        "concat('<div class=\"', repeat('x', 200), '\">only a few words here today</div>')",
        "'confidential disclaimer: do not reply, or unsubscribe'",
        "concat(repeat('many words ', 30), 'enclosed')"]) + ")", "raw"),
])

CSV_TEXT = ("customer", [
    ("c_custkey", "c_custkey"),
    ("concat(" + pick("c_custkey", ["'id,name,balance,joined,note'", "'id,,name,ID,x'", "'1,2,3,name,note'"]) + f", {NL}, "
     f"cast(c_custkey AS string), ',', c_name, ',', cast(c_acctbal AS string), ',2024-01-0', cast(c_nationkey % 9 AS string), ',ok', {NL}, "
     f"cast(c_custkey AS string), ',', " + pick("c_custkey", ["c_name", "''", "'null'", "' '"]) + f", ',n/a,01/02/2024,', {NL}, {NL}, "
     f"cast(c_custkey + 1 AS string), ',', c_mktsegment, ',$5,12 Mar,-', CASE WHEN c_custkey % 4 = 0 THEN ',extra' ELSE '' END)", "text"),
])

GENERAL_TEXT = ("documents", [
    ("doc_id", "doc_id"),
    ("concat("
     + f"CASE WHEN doc_id % 3 = 0 THEN concat('INTRODUCTION', {NL}, {NL}) ELSE '' END, text, "
     + f"CASE WHEN doc_id % 4 = 0 THEN concat({NL}, {NL}, '1. First Part', {NL}, '2. Second Part', {NL}, '- item', {NL}) ELSE '' END, "
     + f"CASE WHEN doc_id % 5 = 0 THEN concat({NL}, {NL}, 'Conclusion and next steps') ELSE '' END, "
     + when("doc_id % 7 = 0", " data data data data data data data data data data data data data data data data data data data data") + ")",
     "text"),
])


def _object(*pairs: str) -> str:
    return "concat('{', " + ", ',', ".join(pairs) + ", '}')"


_ID = "concat('\"id\":', cast(event_id AS string))"
_KIND = "concat('\"kind\":\"', event_type, '\"')"
_VALUE = "concat('\"value\":', cast(value AS string))"
_VALUE_AS_TEXT = "concat('\"value\":\"', cast(value AS string), '\"')"
_NOTE = "concat('\"note\":\"', cast(value AS string), '\"')"
_PROPS = "concat('\"props\":', props)"
_TAGS = "concat('\"tags\":[', cast(user_id AS string), ',', " + pick("event_id", ["'2'", "'\"x\"'", "'[1]'"]) + ", ']')"
_PLAIN = _object(_ID, _KIND, _VALUE, _PROPS, _TAGS)

# a list of three records; the second and third drift from the first in several ways
EVENT_JSON = ("events", [
    ("event_id", "event_id"),
    (f"concat('[', {_PLAIN}, ',', CASE event_id % 5 "
     f"WHEN 0 THEN {_object(_ID, _KIND, _VALUE_AS_TEXT, _PROPS, _TAGS)} WHEN 1 THEN {_object(_ID, _KIND, _PROPS)} "
     f"WHEN 2 THEN 'null' ELSE {_object(_KIND, _ID, _VALUE, _PROPS, _TAGS)} END, ',', CASE WHEN event_id % 7 = 0 "
     f"THEN {_object(_ID, _KIND, _VALUE, _PROPS, _TAGS, _NOTE)} ELSE {_PLAIN} END, ']')", "raw"),
])

# one record per event, grouped by user
EVENT_RECORDS = ("events", [
    ("user_id", "user_id"), ("event_id", "event_id"),
    (f"CASE event_id % 5 WHEN 0 THEN {_object(_ID, _KIND, _VALUE_AS_TEXT, _PROPS)} WHEN 1 THEN {_object(_ID, _KIND, _PROPS)} "
     f"WHEN 2 THEN '7' ELSE {_object(_KIND, _ID, _VALUE, _PROPS)} END", "record"),
])

# one object per order with dates, a total and its components
ORDER_JSON = ("orders", [
    ("o_orderkey", "o_orderkey"),
    ("concat('{\"start_date\":\"', cast(cast(o_orderdate AS date) AS string), '\",\"end_date\":', "
     + pick("o_orderkey", ["'\"1997-01-01\"'", "'null'", "'\"2030-01-01\"'"])
     + ", ',\"total\":', " + pick("o_orderkey", ["'\"$1,010.50\"'", "'1010.5'", "'\"many\"'", "cast(o_totalprice AS string)", "'510.25'"])
     + ", ',\"item_price\":1000.25,\"ship_cost\":\"10.25\",\"Sub_Total\":', " + pick("o_orderkey", ["'null'", "'1010.5'"]) + ", '}')", "raw"),
])

# prototype order records
ORDER_RECORDS = ("orders", [
    ("o_custkey", "o_custkey"), ("o_orderkey", "o_orderkey"),
    ("concat('{', CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 7 = 1 THEN '\"order_id\":null,' "
     "ELSE concat('\"order_id\":', cast(o_orderkey % 50 AS string), ',') END, '\"amount\":', "
     + pick("o_orderkey", ["'10'", "'\"20.5\"'", "'\"ten\"'", "'\"\"'", "'null'"])
     + ", ',\"tax\":2,\"total\":', " + pick("o_orderkey", ["'12'", "'22.5'", "'9'"]) + ", '}')", "record"),
])

PROTO_TEXT = ("orders", [
    ("o_orderkey", "o_orderkey"),
    ("concat(" + pick("o_orderkey", [
        "'Invoice vendor date subtotal 100 tax:5 total: 105'", "'invoice total 105 tax 5 subtotal 100'",
        "'Agreement: the parties accept payment term and termination. Signed, author unknown'",
        "'exclusive automatic renewal of unlimited liability and confidentiality, version 2'",
        "'subtotal:100 tax:5 total:105 vendor'", "'comment http://x'"])
     + ", ' ', cast(o_orderkey AS string))", "text"),
    (pick("o_orderkey", ["'a.txt'", "'b.json'", "'c.txt'"]), "filename"),
])

# ---------------------------------------------------------------- invoices, one per order

_ISO = "cast(cast(o_orderdate AS date) AS string)"
_TAX = "CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE 10.0 END"
INVOICES = ("orders", [
    ("o_orderkey", "doc_id"),
    ("CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('INV-', cast(o_orderkey AS string)) END", "invoice_number"),
    (f"CASE WHEN o_orderkey % 13 = 0 THEN 'soon' WHEN o_orderkey % 13 = 1 THEN {joined('/', M, D, Y)} ELSE {_ISO} END", "invoice_date"),
    ("CASE WHEN o_orderkey % 10 = 0 THEN cast(cast(o_orderdate AS date) - 1 AS string) "
     "WHEN o_orderkey % 10 = 1 THEN '' ELSE cast(cast(o_orderdate AS date) + 30 AS string) END", "due_date"),
    ("concat('Vendor ', o_orderpriority)", "vendor_name"),
    ("CASE WHEN o_orderkey % 7 = 0 THEN concat('vendor ', o_orderpriority) ELSE concat('Customer ', cast(o_custkey AS string)) END", "customer_name"),
    ("CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' WHEN o_orderkey % 19 = 0 THEN '-5.00' ELSE concat('$', cast(o_totalprice AS string)) END", "total_amount"),
    ("CASE WHEN o_orderkey % 9 = 0 THEN cast(round(o_totalprice + 1, 2) AS string) "
     f"ELSE cast(round(o_totalprice - {_TAX}, 2) AS string) END", "subtotal"),
    (f"cast({_TAX} AS string)", "tax"),
    ("CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'USD' END", "currency"),
    ("CASE WHEN o_orderkey % 6 = 0 THEN ' ' ELSE concat(cast(o_custkey AS string), ' Main Street') END", "billing_address"),
    ("CASE WHEN o_orderkey % 4 = 0 THEN 'bad@' ELSE concat('c', cast(o_custkey AS string), '@example.com') END", "contact_email"),
    ("CASE WHEN o_orderkey % 8 = 0 THEN 'call me' ELSE '+1 555-0100' END", "contact_phone"),
    (f"cast(round(o_totalprice - {_TAX} - 5, 2) AS string)", "item_amount"),
    ("CASE WHEN o_orderkey % 12 = 0 THEN 1 ELSE 0 END", "repeated_item"),
    ("concat('Invoice INV-', cast(o_orderkey AS string), ' of ', " + _ISO
     + ", ' for Customer ', cast(o_custkey AS string), ' total $', cast(o_totalprice AS string), ' USD', "
     + when("o_orderkey % 2 = 0", " sent by vendor to Main Street, call 555-0100") + ")", "text"),
])
INVOICE_FIELDS = ["invoice_number", "invoice_date", "due_date", "vendor_name", "customer_name", "total_amount",
                  "subtotal", "tax", "currency", "billing_address", "contact_email", "contact_phone"]
FIELD_NAMES = [*INVOICE_FIELDS, "line_items"]
AS_OF = "1998-01-01"


def source(spark: SparkSession, sf_dir: str, spec, pieces: str | None = None, key: str | None = None, deal=None) -> DataFrame:
    """The derived documents as a DataFrame (a projection of one scan); ``pieces`` names a column always used of a wide one.

    ``key`` names the table's key, for slim rows that cost so much that they are dealt to all tasks;
    ``deal(rows, key)`` deals them in its own way.
    """
    name, columns = spec
    rows = table(spark, sf_dir, name)
    return (deal(rows, key) if deal else spread(rows, key=key)).select(
        *[(in_pieces(F.expr(e)) if a == pieces else F.expr(e)).alias(a) for e, a in columns])


def sql(spec) -> str:
    """The same documents as a SQL subquery."""
    name, columns = spec
    return "(SELECT " + ", ".join(f"{e} AS {a}" for e, a in columns) + f" FROM {name})"


def line_item(**values: Column) -> Column:
    """One line item from named text columns."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), V.field(v))]
    text = F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.struct(text.alias("text"), F.create_map(*pairs).alias("fields"))


def invoices(spark: SparkSession, sf_dir: str, apart: bool = False, deal=None) -> DataFrame:
    """One invoice document per order with extracted fields and two line items.

    The items are built from the order row itself, so no rows are collected
    per key.
    """
    df = source(spark, sf_dir, INVOICES, pieces="total_amount", key="o_orderkey", deal=deal)
    goods = line_item(amount=F.col("item_amount"), qty=F.lit("1"), rate=F.col("item_amount"))
    service = line_item(amount=F.lit("5"), qty=F.lit("5"), rate=F.lit("1.00"))
    items = F.array(goods, F.when(F.col("repeated_item") == 1, goods).otherwise(service))
    pairs = [x for n in INVOICE_FIELDS for x in (F.lit(n), V.field(F.col(n)))]
    listed = F.concat_ws(",", *[F.col("line_items")[i]["text"] for i in range(2)])
    return df.withColumn("line_items", items).select(
        "doc_id",
        F.concat(F.lit("invoice-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.lit("invoice").alias("document_type"),
        "text",
        in_pieces(F.create_map(*pairs, F.lit("line_items"), V.field(listed))).alias("fields"),
        "line_items",
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id % 100000)").alias("created_at"),
        # the same fields as columns, for the checks of known names
        *([*[F.col(n).alias(f"field_{n}") for n in INVOICE_FIELDS], listed.alias("field_line_items")] if apart else []),
    )
