"""Stored evaluations: whole commits, point lookups, pages, and a stream that reads its files once."""

import pytest
from pyspark.sql import functions as F

from docgauge.operators import paging
from docgauge.plans.evaluate import evaluate
from docgauge.sources import sinks
from docgauge.streaming import ingest


@pytest.fixture(scope="module")
def evaluations(spark, tmp_path_factory):
    """A few hundred stored evaluations, so that tests need not evaluate again."""
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('f', id, '.txt') AS filename", "concat('Some words of text ', id) AS text")
    path = f"file://{tmp_path_factory.mktemp('ev')}/one"
    evaluate(docs, "2024-01-01", families=("general",)).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture()
def many_ranges(spark):
    """Small tables would be put into one range."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rejects(spark, *names):
    return spark.createDataFrame([(f"/in/{n}", n, 1, "blank") for n in names], sinks.REJECTED)


def state(spark, root):
    return (
        sorted((r.batch_id, r.doc_id) for r in sinks.read_evaluations(spark, root).select("batch_id", "doc_id").collect()),
        sorted((r.batch_id, r.doc_id, r.pos) for r in sinks.read_issues(spark, root).select("batch_id", "doc_id", "pos").collect()),
        sorted((r.batch_id, r.filename) for r in sinks.read_rejected(spark, root).collect()))


def test_a_write_broken_off_leaves_the_earlier_batch(spark, evaluations, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/out"
    with pytest.raises(FileNotFoundError):
        sinks.read_evaluations(spark, root)
    sinks.write_batch(evaluations.where("doc_id < 10"), root, "a/1", rejects(spark, "x.txt"))
    sinks.write_batch(evaluations.where("doc_id >= 290"), root, "b")
    before = state(spark, root)
    assert [d for _, d in before[0]] == [*range(10), *range(290, 300)] and before[2] == [("a/1", "x.txt")]
    broken = rejects(spark, "y.txt").withColumn("size", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):  # after evaluations and issues are written
        sinks.write_batch(evaluations.where("doc_id < 5"), root, "a/1", broken)
    assert state(spark, root) == before
    monkeypatch.setattr(sinks, "_commit", lambda *a: (_ for _ in ()).throw(OSError("driver lost")))
    with pytest.raises(OSError):  # after all three tables
        sinks.write_batch(evaluations.where("doc_id < 5"), root, "a/1", rejects(spark, "z.txt"))
    assert state(spark, root) == before
    monkeypatch.undo()
    for _ in range(2):  # a retry leaves one copy
        sinks.write_batch(evaluations.where("doc_id < 5"), root, "a/1", rejects(spark, "z.txt"))
    after = state(spark, root)
    assert [d for b, d in after[0] if b == "a/1"] == [0, 1, 2, 3, 4] and after[2] == [("a/1", "z.txt")]
    assert {d for b, d, _ in after[1] if b == "a/1"} <= set(range(5))
    assert sinks.vacuum(spark, root) > 0 and sinks.vacuum(spark, root) == 0
    assert state(spark, root) == after


def test_lookup_opens_one_bucket_and_evaluates_nothing(spark, evaluations, tmp_path):
    root = f"file://{tmp_path}/out"
    sinks.write_batch(evaluations.where("doc_id < 200"), root, 1)
    sinks.write_batch(evaluations.where("doc_id >= 200"), root, 2, buckets=7)  # the root has 64 already
    all_rows = sinks.read_evaluations(spark, root)
    for key in (0, 70, 299):
        found = sinks.lookup(spark, root, key)
        assert [r.doc_id for r in found.collect()] == [key]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(id_bucket" in plan and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id" in plan
        assert "Exchange" not in plan and "transform(" not in plan
        opened = {r[0] for r in sinks._read(spark, root, "evaluations").where(F.col("id_bucket") == sinks.bucket_of(F.lit(key).cast("long"), 64)).select("_metadata.file_path").collect()}
        assert 1 <= len(opened) <= 2  # one file of each batch at most
    assert sinks.lookup(spark, root, 12345).collect() == []


@pytest.mark.parametrize("rows", [0, 7, 500])
def test_pages_equal_offsets(spark, tmp_path, rows, many_ranges):
    """Ties in the sort columns, null values, pages at range borders and beyond the end."""
    issues = spark.range(rows).selectExpr(
        "id % 97 AS doc_id", "cast(id AS int) AS pos", "concat('f', id % 3) AS field_name", "if(id % 11 = 0, null, concat('t', id % 5)) AS issue_type",
        "'d' AS description", "if(id % 2 = 0, 'critical', 'warning') AS severity").repartition(5)
    folder = f"file://{tmp_path}/pages"
    paging.write_pages(issues, folder, {"severity": "critical"}, ["issue_type"])
    key = lambda r: (r["issue_type"] is not None, r["issue_type"] or "", r["doc_id"], r["pos"])
    expected = sorted((r.asDict() for r in issues.where("severity = 'critical'").collect()), key=key)
    for number in (0, 1, 9, 24, 25, 26, 1_000_000):
        found = paging.page(spark, folder, number)
        assert [r.asDict() for r in found.collect()] == expected[number * 10:number * 10 + 10]
    for at in (0, 30, len(expected) - 2, len(expected) - 1):
        if 0 <= at < len(expected):
            assert [r.asDict() for r in paging.page_after(spark, folder, expected[at]).collect()] == expected[at + 1:at + 11]


def test_a_page_opens_the_ranges_that_hold_it(spark, tmp_path, many_ranges):
    issues = spark.range(4000).selectExpr("id AS doc_id", "0 AS pos", "'f' AS field_name", "'t' AS issue_type", "'d' AS description", "'good' AS severity")
    folder = f"file://{tmp_path}/pages"
    paging.write_pages(issues, folder)
    ranges = spark.read.parquet(f"{folder}/bounds").count()
    assert ranges > 2
    for number in (0, 399):
        plan = paging.page(spark, folder, number)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan
        assert len(paging.page(spark, folder, number).select("doc_id").collect()) == 10
        opened = paging._rows(spark, folder, spark.read.parquet(f"{folder}/bounds"), (F.col("first") <= number * 10) & (F.col("first") + F.col("n") > number * 10))
        assert opened.select("part").distinct().count() == 1


def test_stream_reads_its_files_once(spark, tmp_path):
    for k in range(6):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.txt").write_text(" \n" if k == 3 else f"Text number {k} with some words.")
    (tmp_path / "in" / "x.exe").write_text("no")
    root = f"file://{tmp_path}/out"
    query = ingest.start(spark, f"file://{tmp_path}/in", root, "2024-06-01", f"file://{tmp_path}/check", once=True, families=("general",))
    query.awaitTermination()
    assert sum(p.numInputRows for p in query.recentProgress) == 7
    accepted = {r.filename for r in sinks.read_evaluations(spark, root).collect()}
    rejected = {r.filename: r.reason for r in sinks.read_rejected(spark, root).collect()}
    assert accepted == {f"{k}.txt" for k in range(6) if k != 3}
    assert rejected == {"3.txt": "blank", "x.exe": "unsupported type"}
    assert not list((tmp_path / "out" / "_staged").iterdir())


def test_pages_look_at_the_issues_once(spark, tmp_path):
    from docgauge.operators import paging

    seen = spark.sparkContext.accumulator(0)

    def row(i):
        seen.add(1)
        return (i, 0, f"type {i % 7}")

    issues = spark.sparkContext.parallelize(range(300), 4).map(row).toDF("doc_id int, pos int, issue_type string")
    paging.write_pages(issues, f"{tmp_path}/pages", sort=["issue_type"])
    assert seen.value == 300
    assert [r["doc_id"] for r in paging.page(spark, f"{tmp_path}/pages", 1).collect()] == [i * 7 for i in range(10, 20)]


def test_large_batches_shuffle_documents_not_evaluations(spark, tmp_path):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('f', id, '.txt') AS filename", "concat('Some words of text ', id) AS text")
    ev = evaluate(sinks.dealt(docs), "2024-01-01", families=("general",))
    placed = sinks._placed(ev, sinks.BUCKETS, by_bucket=True)
    plan = placed._jdf.queryExecution().optimizedPlan()
    assert "id_bucket" in plan.outputOrdering().toString()  # the writer adds no sort of evaluations
    shuffled = plan.toString().split("Repartition")
    assert len(shuffled) == 2 and "Missing Field" in shuffled[0] and "Missing Field" not in shuffled[1]
    tasks = placed.select("id_bucket", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({r.task for r in tasks}) == len(tasks)  # one bucket to a task
    roots = [f"file://{tmp_path}/{n}" for n in ("dealt", "other")]
    sinks.write_batch(ev, roots[0], 1, by_bucket=True)
    sinks.write_batch(ev, roots[1], 1, buckets=7, by_bucket=True)  # dealt for other buckets: only slower
    want = sorted(map(str, evaluate(docs, "2024-01-01", families=("general",)).collect()))
    for root in roots:
        assert sorted(map(str, sinks.read_evaluations(spark, root).drop("batch_id").collect())) == want
        assert [r.doc_id for r in sinks.lookup(spark, root, 70).collect()] == [70]
