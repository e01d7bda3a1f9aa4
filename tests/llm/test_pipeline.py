"""The pipeline against its stages done by hand."""

import hashlib
from types import SimpleNamespace

import pytest

import __spark_entry__
import corpus_pipeline
from docgauge.llm import common, decontaminate, pii, simhash
from docgauge.llm import queries as Q
from docgauge.llm.pretokens import library

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {r["doc_id"] for r in Q.QUERIES["op1_quality_rules"](spark, SF).collect() if r["kept"]}
    prints = {d: simhash.fingerprint(docs[d].encode()) & (1 << 64) - 1 for d in kept}
    left = set()
    for d in sorted(kept):  # the smallest id of each component
        reach, new = {d}, [d]
        while new:
            a = new.pop()
            near = {b for b in kept - reach if (prints[a] ^ prints[b]).bit_count() <= 4}
            reach |= near
            new += near
        if min(reach) == d:
            left.add(d)
    items = [decontaminate.words_of(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {d for d in left if all(decontaminate.distance_ends(i, decontaminate.words_of(docs[d]))[0] > int(0.2 * len(i)) for i in items if i)}
    want = {}
    for d in left:
        text = pii.masked(docs[d], pii.all_spans(docs[d], pii.base_spans(docs[d]), pii.trained()))
        want[d] = (len(library(Q.vocabulary_file()).encode(text, add_special_tokens=False).ids), hashlib.sha256(text.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and len(got) > 50


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in names}


def test_cluster_without_a_shared_folder_is_refused():
    nothing = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(getCheckpointDir=lambda: nothing)
    cluster = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: default),
        sparkContext=SimpleNamespace(master="yarn", _jsc=SimpleNamespace(sc=lambda: context)))
    with pytest.raises(ValueError):
        common.shared_dir(cluster)
