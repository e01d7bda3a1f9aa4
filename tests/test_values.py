from pyspark.sql import functions as F

from docgauge.functions import text as X
from docgauge.functions import values as V
from docgauge.operators import core
from docgauge.sources import readers


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]


def test_dates(spark):
    good = ["2024-3-5", "3/5/2024", "2024/3/5", "5-3-2024", "March 5, 2024", "mar 5, 2024", " 5 March 2024 ", "5 Mar 2024", "2024.3.5", "5.3.2024"]
    assert {str(d) for d in column(spark, good, V.parse_date)} == {"2024-03-05"}
    assert [str(d) for d in column(spark, ["25/12/2024", "12-25-2024"], V.parse_date)] == ["2024-12-25"] * 2
    assert column(spark, ["2024-13-45", "99/99/9999", "x", "", None, "2024-01-01 10:00"], V.parse_date) == [None] * 6


def test_amounts(spark):
    values = ["$1,000.50", "€ 7", "1_000", "1e3", "-.5", "5.", "ten", "", "1.0d", None]
    assert column(spark, values, V.parse_amount) == [1000.5, 7.0, 1000.0, 1000.0, -0.5, 5.0, None, None, None, None]
    assert column(spark, ["₹9"], V.parse_amount) == [None] and column(spark, ["₹9"], V.parse_invoice_amount) == [9.0]
    assert column(spark, ["nan", "-Inf", "$4", "x"], V.is_numeric) == [True, True, True, False]


def brute_syllables(word):
    word = word.lower().strip(".,;:!?\"'()[]{}")
    if len(word) <= 2:
        return 1
    groups = sum(1 for i, c in enumerate(word) if c in "aeiouy" and (i == 0 or word[i - 1] not in "aeiouy"))
    return max(1, groups - (1 if word.endswith("e") and groups > 1 else 0))


def test_syllables_over_whole_texts(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = docs + ["   ", " - . -- e queue movie, (apple) 'the' don't, ", "Ae. ae! be", "rhythm"]
    assert column(spark, texts, X.text_syllables) == [sum(map(brute_syllables, t.split())) for t in texts]


def test_normalize(spark):
    text = "a\r\nb   c\r\r\n\n\n\nd \t\n \n \n e "
    assert column(spark, [text, None, "", " \n "], X.normalize_text) == ["a\nb c\n\nd\n\n\ne", "", "", ""]


def test_extension_and_cells(spark):
    names = ["a.PDF", "b.tar.gz", "noext", "/x/y.z/file", ".hidden", "http.d/f.Html"]
    assert column(spark, names, X.extension) == [".pdf", ".gz", "", "", "", ".html"]
    assert column(spark, ['"a, ""b""",,c', "x"], readers.csv_row_text) == ['a, "b"  c', "x"]


def test_mail_text_prefers_the_plain_part(spark):
    raw = ("From: a@x.org\r\nSubject: Hi\r\n there\r\nContent-Type: multipart/mixed; boundary=\"BB\"\r\n\r\n--BB\r\nContent-Type: text/html\r\n\r\n<p>html</p>\r\n"
           "--BB\r\nContent-Type: text/plain\r\n\r\nplain body\r\n--BB\r\nContent-Type: text/csv\r\nContent-Disposition: attachment\r\n\r\n1,2\r\n--BB--\r\n")
    assert column(spark, [raw], X.mail_to_text) == ["Subject: Hi there\nFrom: a@x.org\nplain body"]


def outcome(spark, payload, text="", kind="invoice", as_of="2024-06-01"):
    df = spark.createDataFrame([(payload, text)], "j string, t string").withColumn("v", F.try_parse_json("j"))
    df = df.select("t", V.variant_fields(F.col("v")).alias("f"), V.variant_line_items(F.col("v")).alias("li"))
    columns = core.all_core(F.col("f"), F.col("li"), F.col("t"), F.lit(kind), F.lit(as_of))
    row = df.select(*[c.alias(n) for n, c in columns.items()]).first()
    return {n: (row[n].score, [(i.field_name, i.issue_type, i.severity) for i in row[n].issues]) for n in columns}


def test_core_without_fields(spark):
    got = outcome(spark, "{}", kind="other")
    assert got["completeness"][0] == 0.0 and len(got["completeness"][1]) == 4
    assert all(got[m] == (100.0, []) for m in got if m != "completeness")


def test_core_rules(spark):
    payload = ('{"invoice_date":"03/05/2024","due_date":"2024-01-01","total_amount":"$1,000.50","contact_email":"x@y",'
               '"line_items":[{"amount":"1000.50"},{"amount":0},{"amount":0}],"customer_name":"Acme Co","vendor_name":"acme co",'
               '"fee":-5,"phone":0,"shipping_cost":"2000000000"}')
    got = outcome(spark, payload, "invoice for ACME co, due 2024-01-01")
    assert got["validity"] == (85.7, [("Contact Email", "Invalid Format", "warning")])
    assert got["consistency"] == (50.0, [("Due Date", "Logical Inconsistency", "critical")])
    assert got["timeliness"] == (50.0, [("Due Date", "Expired Date", "critical")])
    # one shared value (not shown: two fields, one a name) and one repeated item, of ten fields
    assert got["uniqueness"] == (80.0, [("Line Items", "Duplicate Entry", "warning")])
    assert ("Shipping Cost", "Implausible Value", "warning") in got["accuracy"][1]
    assert ("Customer Name", "Unverifiable Value", "warning") not in got["accuracy"][1]


def test_unparsable_items_fail_without_an_issue(spark):
    got = outcome(spark, '{"total_amount":"5","line_items":[{"amount":"five"}]}')
    assert got["consistency"] == (0.0, [])
    got = outcome(spark, '{"total_amount":"5","line_items":{"amount":5}}')
    assert got["consistency"] == (0.0, [])


def test_csv_cells_blank_first_multi_line_and_bare_quotes(spark):
    raw = [",a,b", 'x,"l1\nl2",y', 'a,"",b\r\n1,2\r\n', '5" pipe,x', '"open, end', "", "a,b,"]
    assert column(spark, raw, readers.csv_to_text) == [" a b", "x l1\nl2 y", "a  b\n1 2\n", '5" pipe x', "open, end", "", "a b "]


def test_character_references(spark):
    raw = ["&eacute;&copy;&mdash;", "&#8217;&#x2014;&#128;", "&amp;lt; &nope; &", "&#0;&#99999999999;", "no reference", "a&lt;b&gt;c"]
    assert column(spark, raw, X.unescape) == ["é©—", "’—€", "&lt; &nope; &", "��", "no reference", "a<b>c"]


def test_mail_parts_inside_parts_and_encodings(spark):
    nested = ('Subject: =?iso-8859-1?Q?caf=E9?= =?utf-8?B?IGF1IGxhaXQ=?=\nContent-Type: multipart/mixed; boundary="A"\n\n--A\n'
              "Content-Type: multipart/alternative; boundary=B\n\n--B\nContent-Type: text/plain\nContent-Transfer-Encoding: base64\n\naGVsbG8=\n"
              "--B\nContent-Type: text/html\n\n<p>no</p>\n--B--\n--A\nContent-Type: text/plain\nContent-Disposition: attachment\n\nfile\n--A--\n")
    quoted = "Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\n=C3=A9t=C3=A9 1=3D1 soft=\n line = end"
    latin = "Content-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: quoted-printable\n\ncaf=E9"
    broken = "Content-Transfer-Encoding: base64\n\nnot base64!"
    assert column(spark, [nested, quoted, latin, broken], X.mail_to_text) == [
        "Subject: café au lait\nhello", "été 1=1 soft line = end", "café", "not base64!"]


def test_json_is_whole_text(spark):
    good = ["1", ' {"a":[1,{}]} ', "[1,2]", "null", '"x"', "[]"]
    bad = ["", "1 2", "2024 report of", '"a" b', '{"a":1} x', "[1,2]]", "1] x", "1,0] x", "1,2", '{"a":1}\n{"a":2}', "{", "1]", "1,0]"]
    assert all(v is not None for v in column(spark, good, lambda c: F.schema_of_variant(V.parse_json(c))))
    assert column(spark, [*bad, None], lambda c: F.schema_of_variant(V.parse_json(c))) == [None] * (len(bad) + 1)


def test_kinds_of_json_values_are_told_without_their_schema(spark):
    values = {"null": False, '""': False, '" "': True, '"{}"': True, '"0"': True, '"null"': True, "false": False, "true": True, "0": False,
              "-0": False, "0.0": False, "0e5": False, "1e-400": False, "12": True, "-3.5": True, "{}": False, '{"a":[]}': True, "[]": False, "[0]": True}
    rows = spark.createDataFrame([(j,) for j in values], "j string").withColumn("v", F.parse_json("j"))
    v = F.col("v")
    out = rows.select("j", V._variant_truthy(v).alias("t"), V.is_object(v).alias("o"), V.is_array(v).alias("a"), F.size(V._variant_map(v)).alias("m"))
    for r in out.collect():
        assert r.t == values[r.j] and r.o == (r.m is not None) == r.j.startswith("{") and r.a == r.j.startswith("["), r
    built = V.variant_fields(v), V.variant_line_items(v), V.is_object(v)
    assert not [c for c in built if "schema_of_variant" in rows.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()]


def test_a_reply_is_read_once_behind_its_fences(spark):
    from docgauge.plans.evaluate import parse_semantic_payload

    body = '{"document_type":"memo","fields":{"a":"x","line_items":[{"amount":"1"}]},"semantic_evaluation":{"accuracy":5}}'
    replies = [body, f"```json\n{body}\n```", f" \t```{body}``` \n", f"\n\t{body}", f"[{body}]", '"{"', body + "}", "", None]
    rows = spark.createDataFrame(list(enumerate(replies)), "i int, r string").select("i", parse_semantic_payload(F.col("r")).alias("p"))
    got = {r.i: r.p for r in rows.collect()}
    assert all(got[i].document_type == "memo" and got[i].fields["a"].text == "x" and len(got[i].line_items) == 1 for i in range(4))
    assert not any(got[i] for i in range(4, 9))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("```json") == 1
