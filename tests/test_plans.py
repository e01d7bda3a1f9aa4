"""What the plans may and may not contain, and that batch and stream agree."""

import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docgauge import rules
from docgauge.functions.scoring import exact_sum
from docgauge.operators import table as table_ops
from docgauge.plans import load
from docgauge.plans import report_queries as R
from docgauge.plans.evaluate import evaluate, with_semantic
from docgauge.sources import readers, sinks
from docgauge.streaming import ingest

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def files():
    root = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    contents = {
        "deal.txt": "This agreement covers termination and liability.\n\nSigned by: someone",
        "rows.csv": "id,name\n1,ann\n2,\n",
        "one.json": '{"a": 1, "b": null}',
        "page.html": "<html><body><h1>Hi</h1><p>text</p></body></html>",
        "mail.eml": "From: a@x.org\nTo: b@y.org\nSubject: s\nDate: today\n\nhello there",
        "blank.txt": "  \n ",
        "tool.exe": "binary",
        "scan.pdf": "%PDF",
        "broken.json": "{bad",
    }
    for name, text in contents.items():
        (root / name).write_text(text, encoding="utf-8")
    return str(root)


def test_no_python_in_any_plan(spark):
    for name in ("evaluate_documents", "json_type_validation", "markup_gated", "core_accuracy", "social_language"):
        plan = plan_of(load().QUERIES[name](spark, SF))
        assert "Python" not in plan and "Arrow" not in plan, name


def test_evaluation_does_not_shuffle(spark):
    docs = spark.range(0, 64, 1, 64).select(F.col("id").alias("doc_id"), F.lit("a.txt").alias("filename"), F.lit("some text").alias("text"))
    assert "Exchange" not in plan_of(evaluate(docs, "2024-01-01", families=("general",)))


def test_rule_table_is_broadcast(spark):
    assert "BroadcastHashJoin" in plan_of(load().QUERIES["type_insights"](spark, SF))


def test_column_pruning_reaches_the_scan(spark):
    plan = plan_of(load().QUERIES["table_uniqueness"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan


def test_invoice_amounts_read_lineitem_once(spark):
    plan = plan_of(load().QUERIES["invoice_amounts_of_orders"](spark, SF))
    assert plan.count("lineitem.parquet") == 1


def test_a_scan_is_dealt_out_only_on_demand(spark):
    docs = spark.range(10, numPartitions=2)
    given = spark.conf.get("spark.docgauge.scanPartitions")
    spark.conf.unset("spark.docgauge.scanPartitions")
    try:
        assert readers.spread(docs) is docs
        assert "Exchange" in plan_of(readers.spread(docs, 3))
    finally:
        spark.conf.set("spark.docgauge.scanPartitions", given)


def test_missing_semantic_scores(spark):
    docs = spark.createDataFrame([(1, "a.bin", "word " * 30)], "doc_id int, filename string, text string")
    score = lambda **o: evaluate(docs, "2024-01-01", families=("general",), **o).first()
    assert (score(missing_semantic="zero").overall_score, score(missing_semantic="zero").overall_status) == (52.5, "critical")
    assert (score().overall_score, score().overall_status) == (75.0, "warning")


def test_semantic_replies_join_and_fall_back(spark):
    docs = spark.createDataFrame([(1, "a.txt", "x"), (2, "b.txt", "y")], "doc_id int, filename string, text string")
    reply = '```json\n{"document_type":"report","semantic_evaluation":{"validity":50}}\n```'
    replies = spark.createDataFrame([(1, reply), (2, "no json")], "doc_id int, reply string")
    rows = {r.doc_id: r for r in with_semantic(docs, replies).collect()}
    assert rows[1].document_type == "report" and rows[1].semantic.validity == 50.0
    assert rows[2].document_type == "unknown" and rows[2].semantic is None
    ev = {r.doc_id: r for r in evaluate(with_semantic(docs, replies), "2024-01-01", families=("general",)).collect()}
    assert next(m.score for m in ev[1].metrics if m.name == "Validity") == 85.0
    twice = with_semantic(docs, replies.union(replies).union(replies.where("doc_id = 2").selectExpr("doc_id", "'another'"))).collect()
    assert sorted(r.doc_id for r in twice) == [1, 2]


def test_files_batch_and_stream_agree(spark, files):
    rows = readers.read_files(spark, files)
    reasons = {"tool.exe": "unsupported type", "scan.pdf": "no decoder", "broken.json": "unreadable", "blank.txt": "blank"}
    assert {r.filename: r.reason for r in readers.rejected(rows).collect()} == reasons
    assert readers.to_documents(rows).count() + len(reasons) == rows.count()
    assert {r.filename for r in readers.rejected(rows, limit=20).collect() if r.reason == "too large"} >= {"deal.txt", "mail.eml"}
    batch = evaluate(readers.to_documents(rows), "2024-06-01")
    show = lambda df: sorted((r.filename, r.family, r.type_specific_score, r.overall_score) for r in df.collect())
    expected = show(batch)
    assert [f for f, *_ in expected] == ["deal.txt", "mail.eml", "one.json", "page.html", "rows.csv"]
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    query = ingest.start(spark, files, f"{root}/out", "2024-06-01", f"{root}/checkpoint", once=True)
    query.awaitTermination()
    assert query.exception() is None
    stored = sinks.read_evaluations(spark, f"{root}/out")
    assert show(stored) == expected
    n_issues = stored.select(F.sum(F.size("issues"))).first()[0]
    assert sinks.read_issues(spark, f"{root}/out").count() == n_issues
    assert {r.filename: r.reason for r in sinks.read_rejected(spark, f"{root}/out").collect()} == reasons
    # the same batch written again leaves one copy
    sinks.write_evaluations(batch, f"{root}/out", 0)
    assert show(sinks.read_evaluations(spark, f"{root}/out")) == expected


def test_a_batch_is_replaced_whole_and_its_id_is_text(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    docs = spark.createDataFrame([(1, "a.txt", "word " * 30), (2, "b.txt", "This agreement covers liability")], "doc_id int, filename string, text string")
    sinks.write_evaluations(evaluate(docs, "2024-01-01", families=("general", "contract")), root, "007")
    sinks.write_evaluations(evaluate(docs.where("doc_id = 2"), "2024-01-01", families=("general", "contract")), root, "7")
    sinks.write_evaluations(evaluate(docs.where("doc_id = 2"), "2024-01-01", families=("general", "contract")), root, "007")
    stored = sorted((r.batch_id, r.doc_id) for r in sinks.read_evaluations(spark, root).collect())
    assert stored == [("007", 2), ("7", 2)]
    assert {r.doc_id for r in sinks.read_issues(spark, root).collect()} <= {2}


def test_prototype_insight_for_contracts(spark):
    from docgauge.operators import prototype

    df = spark.createDataFrame([("no ink",), ("signed",)], "t string").select(prototype.contract(F.col("t")).alias("m"))
    text = prototype.insight(F.lit("Contract"), {"Signature Presence": F.col("m.signature_presence")})
    found = [r[0] for r in df.select(text).collect()]
    assert "signature missing" in found[0] and found[1] == "Document quality appears consistent."


def test_flagship_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert R.documents(spark, SF).columns == ["doc_id", "filename", "text", "fields", "created_at"]


def test_supplied_texts_win_unless_empty_or_missing(spark):
    docs = spark.createDataFrame([(i, "a.txt", "Invoice of May") for i in (1, 2, 3)], "doc_id int, filename string, text string")
    full = ('{"document_type":"invoice","fields":{"invoice_number":"7","total_amount":10.50,"line_items":[{"amount":10.50}]},'
            '"executive_summary":"mine","risk_summary":"","recommendations":["do"]}')
    replies = spark.createDataFrame([(1, full), (2, '{"document_type":"invoice"}')], "doc_id int, reply string")
    joined = with_semantic(docs, replies)
    fields = {r.doc_id: r.fields for r in joined.collect()}
    assert fields[1]["total_amount"].text == "10.5" and fields[1]["line_items"].truthy and not fields[2] and not fields[3]
    ev = {r.doc_id: r for r in evaluate(joined, "2024-01-01", families=("invoice",)).collect()}
    assert (ev[1].executive_summary, ev[1].recommendations) == ("mine", ["do"]) and "Risk" in ev[1].risk_summary
    assert ev[2].executive_summary.startswith("Quality analysis of invoice") and ev[2].recommendations != ["do"]
    assert ev[3].executive_summary == rules.FALLBACK_SUMMARY and ev[3].recommendations == rules.FALLBACK_RECOMMENDATIONS


def test_unverified_rows_with_hot_and_null_keys(spark):
    rows = spark.createDataFrame([(9, i) for i in range(40)] + [(None, 100), (1, 101), (2, 102)], "k int, n int")
    master = spark.createDataFrame([(1,), (2,), (2,)], "m int")
    assert sorted(r.n for r in table_ops.unverified_rows(rows, "k", master, "m").collect()) == [*range(40), 100]


def test_exact_sums(spark):
    values = [0.1] * 10 + [1e15, -1e15]
    df = spark.createDataFrame([(1, v) for v in values] + [(2, float("nan")), (2, 1.0)], "k int, v double")
    sums = {r.k: r.s for r in df.groupBy("k").agg(exact_sum("v").alias("s")).collect()}
    assert sums[1] == 1.0 and sums[2] != sums[2]
