"""Queries compute what they show: scores without issues, issues without descriptions, one pass over the text."""

from pyspark.sql import functions as F

from docgauge import rules
from docgauge.functions.text import any_of, has, stripped_parts, rx
from docgauge.operators import core_known, general
from docgauge.plans import inputs as I
from docgauge.plans import load

SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    return load().QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_scores_build_no_issues(spark):
    for name in ("blend_scores", "score_bands"):
        assert "Missing Field" not in _plan(spark, name), name


def test_invoices_of_one_row_group_are_dealt_to_all_tasks(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/orders.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    held = "spark.docgauge.scanPartitions"
    number = spark.conf.get(held)
    spark.conf.unset(held)
    try:
        docs = I.invoices(spark, str(tmp_path), apart=True)
        sizes = [r["count"] for r in docs.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        bands = sorted(map(tuple, load().QUERIES["score_bands"](spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set(held, number)
    assert sum(sizes) == rows.count() and len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(sizes) < 2 * min(sizes)
    assert bands == sorted(map(tuple, load().QUERIES["score_bands"](spark, SF).collect()))


def test_issue_queries_build_no_descriptions(spark):
    for name in ("issue_rows", "issues_by_metric", "severity_distribution", "risk_summary", "chart_bundle"):
        plan = _plan(spark, name)
        assert "not detected in document" not in plan and "could not be verified" not in plan, name
    assert "minor observation" not in _plan(spark, "chart_bundle")


def test_fields_of_issues_are_those_of_whole_issues(spark):
    docs = I.invoices(spark, SF, apart=True).where("doc_id < 400").withColumn("low", F.lower("text"))
    parts = ["severity", "value"]
    of = lambda *given: core_known.with_core(docs, F.lit(I.AS_OF), I.FIELD_NAMES, *given)
    slim = lambda m: F.transform(f"{m}.issues", lambda i: F.struct(*[i[p].alias(p) for p in parts]))
    want = of().select("doc_id", *[slim(m).alias(m) for m in rules.CORE_METRICS])
    got = of(parts).select("doc_id", *[F.col(f"{m}.issues").alias(m) for m in rules.CORE_METRICS])
    assert sorted(got.collect()) == sorted(want.collect())


def test_odd_values_are_stripped_and_counted_as_before(spark):
    odd = ["", " ", " a b ", "\tx\n", "ab", None, "é ", "  two  words  "]
    rows = spark.createDataFrame([(v,) for v in odd], "v string")
    got = rows.select(core_known._stripped(F.col("v")).alias("s"), "v").collect()
    assert [r.s for r in got] == [None if r.v is None else r.v.strip() for r in got]


def test_frequent_word_agrees_with_the_fold_over_all_words(spark):
    lists = [["a"], ["b", "a"] * 20, [f"w{i}" for i in range(100)] + ["x"] * 9, [f"w{i}" for i in range(92)] + ["x"] * 8,
             ["q"] * 3 + [f"w{i}" for i in range(30)] + ["p"] * 3, [f"w{i % 11}" for i in range(200)]]
    rows = spark.createDataFrame([(w,) for w in lists], "w array<string>")
    for r in rows.select(general.frequent_word(F.col("w")).alias("f"), general.word_profile(F.col("w")).alias("p")).collect():
        assert (r.f.total, r.f.distinct) == (r.p.total, r.p.distinct)
        if r.p.top / r.p.total > general.DENSE:
            assert (r.f.top, r.f.word) == (r.p.top, r.p.word)
        else:
            assert r.f.top / r.f.total <= general.DENSE


def test_words_are_looked_for_before_patterns_with_the_same_outcome(spark):
    texts = ["an overview", "overviews", "dear  sir", "dear", "next\nsteps", "next stepsister", "", "thanks!", "action items", "épurpose"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for patterns in (rules.INTRO_PATTERNS, rules.CONCLUSION_PATTERNS):
        both = rows.select(general._has_any(F.col("t"), patterns).alias("a"), has(F.col("t"), any_of(patterns)).alias("b")).collect()
        assert all(r.a == r.b for r in both)
    parts = rows.select(general._parts(F.col("t"), r"\s+").alias("a"), F.size(stripped_parts(F.col("t"), rx(r"\s+"))).alias("b")).collect()
    assert all(r.a == r.b for r in parts)


def test_families_shuffle_a_text_once_and_build_no_descriptions(spark):
    plan = _plan(spark, "evaluate_families")
    assert "not detected in document" not in plan and "could not be verified in source text" not in plan
    below = plan.split("RepartitionByExpression", 1)[1]
    assert " AS raw#" not in below


def test_types_of_json_values(spark):
    from docgauge.operators.records import type_name

    named = {"null": "NoneType", "true": "bool", '""': "str", '"Infinity"': "str", '"{"': "str", "1": "int", "1.0": "float", "1e400": "float", "1e2": "float",
             "12345678901234567890": "int", "0.5": "float", "{}": "dict", '{"a":1}': "dict", "[]": "list", "[{}]": "list"}
    rows = spark.createDataFrame([(j,) for j in named], "j string").select("j", type_name(F.parse_json("j")).alias("t"))
    assert {r.j: r.t for r in rows.collect()} == named
