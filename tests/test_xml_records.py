"""XML documents and files as records: schema, broken rows, evaluation."""

from docgauge.plans.evaluate import evaluate
from docgauge.sources import xml_records as xml

SCHEMA = "_id long, invoice_number string, _invoice_number string, item array<struct<_n:int,_VALUE:string>>, total_amount double"


def test_rows_parse_one_by_one(spark):
    rows = [
        (1, '<?xml version="1.0"?><inv id="7"><!-- x --><invoice_number>A &lt; B</invoice_number><item n="1">x</item><item n="2">y</item>'
            '<total_amount>12.5</total_amount><extra>kept in text</extra></inv>'),
        (2, '<inv id="8"><invoice_number>cut'), (3, None), (4, ""), (5, "no markup"), (6, "<inv/>"),
        (7, '<inv invoice_number="attr"><total_amount>many</total_amount></inv>'),
        (9, '<inv id="seven"/>'), (10, "<inv><item n='x'>1</item></inv>"),
        (8, '<inv id="9"><invoice_number>' + "long " * 200_000 + "</invoice_number></inv>"),
    ]
    out = xml.with_records(spark.createDataFrame(rows, "k int, raw string"), "raw", SCHEMA)
    got = {r.k: r for r in out.withColumn("fields", xml.record_fields("record", SCHEMA)).collect()}
    first = got[1].record
    assert (first._id, first.invoice_number, first.total_amount) == (7, "A < B", 12.5)
    assert [(i._n, i._VALUE) for i in first["item"]] == [(1, "x"), (2, "y")]
    assert got[1].text.split("\n") == ["A < B", "x", "y", "12.5", "kept in text"]
    assert {k: v.text for k, v in got[1].fields.items()} == {
        "id": "7", "invoice_number": "A < B", "item": '[{"_n":1,"_VALUE":"x"},{"_n":2,"_VALUE":"y"}]', "total_amount": "12.5"}
    assert {k: r.broken for k, r in got.items()} == {1: False, 2: True, 3: False, 4: True, 5: True, 6: False, 7: True, 8: False, 9: True, 10: True}
    assert all(got[k].record is None for k in (2, 3, 4, 5, 7))
    assert got[2].text == "cut" and got[3].text == got[4].text == "" and got[5].text == "no markup" and got[7].text == "many"
    assert set(got[6].record.asDict().values()) == {None} and not got[6].fields
    assert len(got[8].record.invoice_number) >= 999_999


def test_large_files_are_cut_at_their_rows(spark, tmp_path):
    good = "".join(f'<inv id="{k}"><total_amount>{k}.5</total_amount></inv>\n' for k in range(3000))
    (tmp_path / "a.xml").write_text(f"<all>{good}</all>")
    (tmp_path / "b.xml").write_text('<all><inv id="x"><total_amount>1</total_amount></inv>\n<inv id="9000"/><inv id="9001" n="/>"/><inventory/><inv/></all>')
    rows, broken = xml.read_records(spark, str(tmp_path), "inv", "_id long, total_amount double")
    assert {(r["_id"], r.total_amount) for r in rows.collect()} == {(k, k + 0.5) for k in range(3000)} | {(9000, None), (9001, None), (None, None)}
    assert [r.raw for r in broken.collect()] == ['<inv id="x"><total_amount>1</total_amount></inv>']


def test_records_are_evaluated(spark):
    raw = '<inv id="7"><invoice_number>A-1</invoice_number><total_amount>12.5</total_amount></inv>'
    docs = xml.with_records(spark.createDataFrame([("d", "d.xml", raw)], "doc_id string, filename string, raw string"), "raw", SCHEMA)
    docs = docs.withColumn("fields", xml.record_fields("record", SCHEMA)).selectExpr("*", "'invoice' AS document_type")
    row = evaluate(docs, "2024-01-01").collect()[0]
    missing = {i.field_name for i in row.issues if i.issue_type == "Missing Field"}
    assert row.family == "markup" and "Due Date" in missing and not missing & {"Invoice Number", "Total Amount"}
