"""The operators against brute force, round trips and defined results for odd rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import check_oracles
import exact_passages
from docgauge.llm import bpe, decontaminate, lm_scoring, pii, quality_model, quality_rules, sharding, simhash, token_counts, warc
from docgauge.llm import queries as Q
from docgauge.llm.pretokens import Splitter, library

SF = "/root/testdata/sf0.001"
FILE = Q.vocabulary_file()
ODD = ["", None, " \t\n ", "a", "one two\nthree", "é" * 3000, "x " * 4000, "12 4111111111111111 <|endoftext|> 日本\x1cz  \n q", "same text", "same text"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, odd texts, and extra columns whose names clash with inner ones."""
    rows = [(None if k == 3 else 7 if k > 7 else k, t, k, "w", 1.5) for k, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, q_words string, row double")
    return df.union(df.where("doc_id = 4"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def everything(spark, df):
    """Each operator on one table: name, result."""
    bench = spark.createDataFrame([(1, "one two three"), (2, None), (3, " ")], "item_id long, text string")
    marks = labels_of(spark, [(0, 1, 0), (4, 0, 0), (7, None, 0)])
    yield "rules", quality_rules.judge(df)
    yield "keep", quality_rules.keep(df)
    yield "tokens", token_counts.count_tokens(df, FILE)
    yield "lm", lm_scoring.score(df, marks.where("quality = 1"))
    yield "shards", sharding.assign(df)
    yield "warc", warc.read_archives(warc.write_archives(df.withColumnsRenamed({"doc_id": "page_id", "text": "html"})))
    yield "bpe", bpe.encode(df, FILE)
    yield "model", quality_model.score(df, quality_model.fit(df, marks))
    yield "leaks", decontaminate.contaminated(df, bench)
    yield "clean", decontaminate.keep_clean(df, bench)
    yield "simhash", simhash.near_duplicates(df)
    yield "first", simhash.keep_first(df)
    yield "pii", pii.find(df)
    yield "mask", pii.mask(df)


def test_odd_rows(spark, odd):
    n = odd.count()
    for name, df in everything(spark, odd):
        rows = df.collect()
        if name in ("keep", "leaks", "clean", "first"):
            assert len(rows) <= n, name
        else:
            assert len(rows) == n, name
        if name in ("keep", "clean", "first", "mask"):
            assert df.columns == odd.columns, name
        if name == "clean":
            assert {r["n_words"] for r in rows} == set(range(len(ODD))) - {4}
        if name == "first":  # no words: one group; repeated rows: one stays
            assert sorted(r["n_words"] for r in rows if r["n_words"] not in (8, 9)) == [0, 3, 4, 5, 6, 7]


def test_empty_tables(spark, odd):
    for name, df in everything(spark, odd.where("false")):
        assert df.collect() == [], name


# ---------------------------------------------------------------- rules

def test_rules_match_sql(spark):
    con = duckdb.connect()
    for t in check_oracles.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    line = check_oracles.check(spark, con, "op1", Q.QUERIES["op1_quality_rules"], Q.ORACLES["op1_quality_rules"], SF)
    assert line.startswith("OK"), line


def test_rules_run_no_python_and_keep_good_documents(spark, docs):
    plan = quality_rules.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_rules.judge(docs).join(marks, "doc_id").collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"])
    assert not any(r["kept"] for r in rows if r["quality"] == 0)


# ---------------------------------------------------------------- tokens

def test_pretokens_match_the_library():
    split, rng = Splitter(FILE), random.Random(5)
    for _ in range(400):
        text = "".join(chr(rng.choice([*range(9, 14), *range(32, 127), 0xA0, 0x85, 0xB2, 0xE9, 0x3000, 0x4E00, 0x2019, 0x1C])) for _ in range(40))
        want = [text[a:b] for _, (a, b) in library(FILE).pre_tokenizer.pre_tokenize_str(text)]
        assert split.plain(text) == want
        parts = split.chunks(text)
        if parts is not None:
            assert want == split.plain(parts[0]) + [w for p in parts[1:] for w in split.plain(" " + p)]


def expected_ids(text):
    return library(FILE).encode(text or "", add_special_tokens=False).ids


def test_token_counts(spark, docs, texts, odd):
    for r in token_counts.count_tokens(docs, FILE, hot=500).collect():  # most pieces by shuffle
        text = texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(expected_ids(text)))
        assert r["over_limit"] == (r["n_tokens"] > 512)
    got = sorted(r["n_tokens"] for r in token_counts.count_tokens(odd, FILE).collect())
    assert got == sorted(len(expected_ids(t)) for t in [*ODD, ODD[4]])


def test_bpe_round_trip(spark, docs, texts, odd):
    found = bpe.encode(docs, FILE)
    for r in found.collect():
        ids = np.array(expected_ids(texts[r["doc_id"]]), "<u4").tobytes()
        assert (r["ids"], r["ids_sha256"]) == (ids, hashlib.sha256(ids).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert {r[0]: r[1] for r in bpe.decode(found, FILE).collect()} == texts
    own = bpe.codec(FILE)
    for text in [t or "" for t in ODD] + ["<|endoftext|>", " <|endoftext|>a"]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == expected_ids(text)
        assert own.decode(own.encode(text)) == text


def test_bpe_workers_keep_no_words_after_a_task(spark, docs):
    def left(batches):
        import pyarrow as pa

        for _ in batches:
            pass
        known = [k for c in bpe._codecs.values() for k in (c.words, c.chunks, c.automaton.arcs)]
        yield pa.RecordBatch.from_arrays([pa.array([len(bpe._codecs)], pa.int64()), pa.array([sum(map(len, known))], pa.int64())], ["codecs", "words"])

    encoded = bpe.encode(docs.repartition(4), FILE)
    assert encoded.count() == docs.count()
    rows = spark.range(0, 400, 1, 8).mapInArrow(left, "codecs long, words long").collect()  # the same workers, in a later stage
    assert sum(r["codecs"] for r in rows) > 0
    assert sum(r["words"] for r in rows) == 0


def test_bpe_returns_rows_in_small_batches_in_order(spark):
    rows = spark.range(0, bpe.ROWS * 2 + 3, 1, 1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), cast(id % 5 AS int)) AS text")
    got = bpe.encode(rows, FILE).collect()
    assert [r["doc_id"] for r in got] == list(range(bpe.ROWS * 2 + 3))
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == expected_ids(f"w{r['doc_id']} " * (r["doc_id"] % 5))


def test_automaton_accepts_the_merge_order():
    letters = {0: b"a", 1: b"b", 2: b"aa", 3: b"ab", 4: b"aaab"}
    rng = random.Random(1)
    merges = [(0, 0, 2), (0, 1, 3), (2, 3, 4)]
    automaton = bpe.Automaton(letters, merges)
    for _ in range(300):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 12))).encode()
        assert automaton.encode(word) == _merged([0 if c == 97 else 1 for c in word], merges), word


def _merged(ids, merges):
    """One merge after the other, each from the left."""
    for u, v, uv in merges:
        out, k = [], 0
        while k < len(ids):
            hit = ids[k:k + 2] == [u, v]
            out.append(uv if hit else ids[k])
            k += 2 if hit else 1
        ids = out
    return ids


def test_automata_of_random_vocabularies():
    rng, walked = random.Random(7), 0
    for _ in range(3000):
        letters = b"abc"[:rng.randint(1, 3)]
        labels = {i: bytes([c]) for i, c in enumerate(letters)}
        merges, seen = [], set(labels.values())
        for _ in range(rng.randint(0, 14)):
            u, v = rng.choice(list(labels)), rng.choice(list(labels))
            if labels[u] + labels[v] not in seen:
                merges.append((u, v, len(labels)))
                seen.add(labels[u] + labels[v])
                labels[len(labels)] = labels[u] + labels[v]
        automaton = bpe.Automaton(labels, merges)
        for _ in range(12):
            word = bytes(rng.choice(letters) for _ in range(rng.randint(1, 24)))
            want = _merged([letters.index(c) for c in word], merges)
            assert automaton.encode(word) == want, (merges, word)
            walked += len(want) > 1
    assert walked > 20_000
    long = b"ab" * 50_000 + b"c"
    merges = [(0, 1, 3), (3, 3, 4), (4, 4, 5)]
    labels = {0: b"a", 1: b"b", 2: b"c", 3: b"ab", 4: b"abab", 5: b"abababab"}
    assert bpe.Automaton(labels, merges).encode(long) == _merged([0, 1] * 50_000 + [2], merges)
    assert bpe.Automaton(labels, merges).encode(b"") == []


# ---------------------------------------------------------------- language models

@pytest.mark.parametrize("chunk_bytes", [lm_scoring.CHUNK_BYTES, 20_000])
def test_lm_scores_match_brute_force(spark, docs, texts, chunk_bytes):
    """Exact counts over all documents, whether in one chunk or in many."""
    chosen = {d for d in texts if d % 3 == 0}
    target = spark.createDataFrame([(d,) for d in chosen] * 2 + [(None,), (-5,)], "doc_id long")
    held = {d: lm_scoring.words_of(t or "") for d, t in texts.items()}
    models, size = [], len({w for words in held.values() for w in words})
    for group in (chosen, set(texts)):
        words, pairs = Counter(), Counter()
        for d in group:
            words.update(held[d])
            pairs.update(zip(held[d], held[d][1:], strict=False))
        models.append((words, pairs, sum(words.values())))
    found = lm_scoring.score(docs, target, chunk_bytes=chunk_bytes).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for r in found:
        own, losses = held[r["doc_id"]], []
        for words, pairs, total in models:
            loss = 0.0
            for k, w in enumerate(own):
                p = (words[w] + 1) / (total + size + 1)
                if k and words[own[k - 1]]:
                    p = 0.7 * min(1, pairs[own[k - 1], w] / words[own[k - 1]]) + 0.3 * p
                loss -= np.log(p) / len(own)
            losses.append(loss)
        assert r["n_tokens"] == len(own)
        if own:
            assert r["target_loss"] == pytest.approx(losses[0], rel=1e-9) and r["background_loss"] == pytest.approx(losses[1], rel=1e-9)
        else:
            assert r["target_loss"] is None and r["score"] is None


def test_lm_scores_of_repeated_and_null_ids(spark):
    """A hot id, null ids and copies keep their rows, whatever the chunks; a null id is in no target."""
    rows = [(1, f"word{k % 7} and more words {k % 5}") for k in range(60)] + [(None, "word1 and more"), (None, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(1,), (None,)], "doc_id long")
    key = lambda r: tuple("" if x is None else f"{x:.9f}" for x in r)
    one, many = (sorted(map(key, lm_scoring.score(df, target, chunk_bytes=n).collect())) for n in (1 << 20, 100))
    assert one == many and len(one) == len(rows)
    none = lm_scoring.score(df, target.where("doc_id = 9")).where("doc_id = 1").select("target_loss").distinct().collect()
    assert len(none) == 1 and none[0][0] == pytest.approx(np.log(len({w for _, t in rows for w in lm_scoring.words_of(t or "")}) + 1))


# ---------------------------------------------------------------- shards

@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_feistel_is_a_bijection(n):
    numbers = np.arange(n)
    places = sharding.permute(numbers, n, 9)
    assert sorted(places) == list(range(n)) and (sharding.unpermute(places, n, 9) == numbers).all()
    if n > 60:
        assert (places != numbers).mean() > 0.9


def test_shards(spark, docs, texts):
    rows = sharding.assign(docs).collect()
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign(docs.repartition(7)).collect()}
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) <= set(range(24)) and max(sizes.values()) - min(sizes[s] for s in range(24)) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], again[r["doc_id"]]) == (len(data) + 8, zlib.crc32(data), (r["shard"], r["slot"]))


# ---------------------------------------------------------------- archives

def test_archives(spark):
    pages = [(k, f"http://x/{k}\n", "hot" if k % 3 == 0 else None if k == 1 else "" if k == 2 else f"p {k} é" * k * 50) for k in range(120)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    index = warc.write_archives(df)
    found = {r["page_id"]: r for r in warc.read_archives(index).collect()}
    top = {}
    for k, _, html in pages:
        top[html or ""] = max(k, top.get(html or "", -1))
    for k, _, html in pages:
        data, r = (html or "").encode(), found[k]
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = top[html or ""] == k
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first else ("revisit", top[html or ""]))
    for r in index.collect():  # random access
        one = warc.read_record(r["path"], r["frame"], r["offset"], r["length"])
        assert one["page_id"] == str(r["page_id"])
        assert one["payload"] is None or one["payload"].decode() == (pages[r["page_id"]][2] or "")


def test_archives_of_repeated_rows_and_one_hot_payload(spark):
    """A third of the rows hold one payload; the row with the largest page_id occurs twice, ids may be null."""
    rows = [(k, "u", "hot" if k % 3 == 0 else f"page {k}") for k in range(900)] + [(897, "u", "hot"), (None, "u", "hot"), (None, "u", "alone")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small rows would be put into one task and one file
    try:
        index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = warc.read_archives(index)
    files = index.select("path").distinct().count()
    assert read.rdd.getNumPartitions() == files > 1
    assert max(read.rdd.glom().map(lambda rows: len(rows)).collect()) < len(rows)
    found = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in read.collect())
    expected = Counter((k, "response" if html != "hot" or k == 897 else "revisit", None if html != "hot" or k == 897 else 897) for k, _, html in rows)
    assert found == expected


def test_frames_are_independent(tmp_path):
    path = tmp_path / "x.zst"
    bundle = warc.Bundle(path.open("wb"), frame_bytes=500)
    places = [bundle.add(warc.record_bytes(k, None, b"z" * (k * 40))) for k in range(30)]
    bundle.close()
    assert len({f for f, _ in places}) > 3
    parts = list(warc.frames(f"file://{path}"))
    assert sum(len(list(warc.parse_records(p))) for p in parts) == 30


# ---------------------------------------------------------------- classifier

def test_classifier_on_the_held_out_fold(spark):
    big = "/root/testdata/sf0.01"
    docs, marks = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    weights = quality_model.fit(docs, marks)
    assert (weights == quality_model.fit(docs.repartition(5), marks)).all()
    rows = quality_model.score(docs, weights).join(marks, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_training_matches_plain_updates(spark):
    """FTRL-proximal written coordinate by coordinate, over dictionaries."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    rows = [(*quality_model.features(r["text"]), r["quality"]) for r in rows.orderBy("doc_id").limit(60).collect()]
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= quality_model.L1:
            return 0.0
        pull = (quality_model.BETA + math.sqrt(n[i])) / quality_model.ALPHA + quality_model.L2
        return -(z[i] - math.copysign(quality_model.L1, z[i])) / pull

    for _ in range(2):
        for places, values, label in rows:
            held = {i: weight(i) for i in places.tolist()}
            raw = sum(held[i] * x for i, x in zip(places.tolist(), values.tolist(), strict=True))
            loss = 1 / (1 + math.exp(-raw)) - label
            for i, x in zip(places.tolist(), values.tolist(), strict=True):
                g = loss * x
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality_model.ALPHA * held[i]
                n[i] += g * g
    weights = quality_model.train(rows, epochs=2)
    assert np.allclose([weights[i] for i in n], [weight(i) for i in n], atol=1e-6)
    assert np.count_nonzero(weights) == sum(weight(i) != 0 for i in n) > 100
    # scores are the logistic of the plain sparse product
    few = [(k, t) for k, t in enumerate(["one two one two", "", None, "der Wert, der zählt!"])]
    scored = quality_model.score(spark.createDataFrame(few, "doc_id long, text string"), weights)
    for r in scored.collect():
        places, values = quality_model.features(few[r["doc_id"]][1] or "")
        raw = sum(float(weights[i]) * x for i, x in zip(places.tolist(), values.tolist(), strict=True))
        assert abs(r["score"] - 1 / (1 + math.exp(-raw))) < 1e-6 and r["predicted"] == int(r["score"] >= 0.3)


def test_labels_that_disagree_and_ids_that_repeat(spark):
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5]
    docs = spark.createDataFrame([(k, f"{'good fine' if k % 2 else 'bad poor'} text {k}", k) for k in ids], "doc_id long, text string, quality int")
    votes = [(k, k % 2) for k in ids]
    plain = quality_model.fit(docs, spark.createDataFrame(votes, "doc_id long, quality int"))
    # two votes against one change nothing; tied, null and unknown ones are not used
    more = votes + votes + [(k, 1 - k % 2) for k in ids] + [(None, 1), (ids[0], None), (10**6, 1)]
    for parts in (1, 3, 7):
        marks = spark.createDataFrame(more, "doc_id long, quality int").repartition(parts)
        assert (quality_model.fit(docs, marks) == plain).all()
    tied = spark.createDataFrame(votes + [(k, 1 - q) for k, q in votes if k >= 200], "doc_id long, quality int")
    half = spark.createDataFrame([v for v in votes if v[0] < 200], "doc_id long, quality int")
    assert (quality_model.fit(docs, tied) == quality_model.fit(docs, half)).all()
    # an id of many rows counts once, with a text that does not hang on their order
    hot = docs.unionByName(spark.range(3000).selectExpr(f"{ids[0]}L AS doc_id", "concat('row ', id % 50) AS text", "0 AS quality"))
    marks = spark.createDataFrame(votes, "doc_id long, quality int")
    assert (quality_model.fit(hot.repartition(2), marks) == quality_model.fit(hot.repartition(9), marks)).all()
    assert not quality_model.fit(docs.limit(0), marks).any() and not quality_model.fit(docs, marks.limit(0)).any()


def test_rows_of_one_id_fill_no_chunk(spark):
    same, other = "the very same text of one id " * 4, "a text without any id " * 5
    rows = [(1, same)] * 600 + [(None, other)] * 600 + [(2, f"text {k} of another id with many rows") for k in range(2000)]
    rows += [(10 + k, f"document number {k} stands alone") for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([(1,), (2,), (15,)], "doc_id long")
    size, chunk_bytes = sum(len(t) for _, t in rows), 20_000
    dealt, chosen, chunks = lm_scoring._dealt(df, target, chunk_bytes)
    counted = Counter()
    for doc, chunk in ((r.doc_id, r.chunk) for r in dealt.collect()):
        counted[chunk] += {1: len(same), None: len(other), 2: 40}.get(doc, 35)
    assert chunks == size // chunk_bytes + 1 and max(counted.values()) <= 2 * chunk_bytes
    places = {tuple(r) for r in chosen.collect()}
    assert {(r.doc_id, r.chunk) for r in dealt.collect() if r.doc_id in (1, 2, 15)} <= places
    key = lambda r: (str(r.doc_id), r.n_tokens, round(r.target_loss, 9), round(r.background_loss, 9))
    one, many = (sorted(map(key, lm_scoring.score(df, target, chunk_bytes=n).collect())) for n in (1 << 24, chunk_bytes))
    assert one == many and len(one) == len(rows)


# ---------------------------------------------------------------- decontamination

def test_edit_distance_matches_a_plain_table():
    rng = random.Random(2)
    for _ in range(200):
        item, text = ([rng.choice("abc") for _ in range(rng.randint(1, n))] for n in (9, 14))
        row = [0] * (len(text) + 1)
        for i, w in enumerate(item, 1):
            new = [i]
            for j, x in enumerate(text, 1):
                new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
            row = new
        assert decontaminate.distance_ends(item, text)[0] == min(row)


def test_decontamination_recall(spark, docs, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = {k: decontaminate.words_of(t) for k, t in items}
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    want = set()
    for d, text in texts.items():
        doc = decontaminate.words_of(text)
        for k, item in words.items():  # brute force: every document against every item
            if item and decontaminate.distance_ends(item, doc)[0] <= int(0.2 * len(item)):
                want.add((d, k))
    assert found <= want and len(found) >= 0.9 * len(want)
    index, rng, hits = decontaminate.Index(items), random.Random(4), 0
    for k, text in items:
        passage = text.split()
        for _ in range(int(0.15 * len(passage))):
            passage[rng.randrange(len(passage))] = "changed"
        hits += any(m[0] == k for m in index.matches("a b c " + " ".join(passage) + " d e f"))
    assert hits >= 0.9 * len(items)


def edited(words, places, kind, rng):
    """The words with an edit at each of the places."""
    out = list(words)
    for k in sorted(places, reverse=True):
        if kind == "drop" or kind == "mixed" and rng.random() < 0.3:
            del out[k]
        elif kind == "add" or kind == "mixed" and rng.random() < 0.5:
            out.insert(k + rng.randrange(2), "more")
        else:
            out[k] = "changed"
    return out


def test_decontamination_finds_every_passage_in_a_fifth_of_edits(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    items += [(1000 + n, " ".join(f"short{n}word{k}" for k in range(n))) for n in range(1, 31)]
    words = {k: decontaminate.words_of(t) for k, t in items}
    often = Counter(w for ws in words.values() for w in ws)
    index, rng = decontaminate.Index(items), random.Random(5)
    for key, item in words.items():
        most = int(0.2 * len(item))
        rarest = sorted(range(len(item)), key=lambda k: (often[item[k]], -len(item[k]), k))[:most]
        spread = [(2 * k + 1) * len(item) // (2 * most) for k in range(most)]
        for kind in ("change", "add", "drop", "mixed"):
            for places in (rarest, spread, *(rng.sample(range(len(item)), most) for _ in range(10))):
                passage = edited(item, places, kind, rng)
                found = index.matches("a b c " + " ".join(passage) + " d e f")
                assert any(m[0] == key and m[3] <= most for m in found), (key, kind, places)


def test_walks_find_what_the_exact_finder_finds(texts):
    """All passages of the documents, copies in a row, and items of up to 400 words with a fifth of edits of each kind."""
    rng = random.Random(11)
    items = [(k, " ".join(f"w{rng.randrange(400)}" for _ in range(n))) for k, n in enumerate((1, 2, 9, 40, 41, 130, 400))]
    items.append((99, "the cat and the dog and the cat and the dog"))
    made = [" ".join([items[3][1]] * 3), "", None, "the cat and the dog and the cat and the dog " * 3, "x " * 20_000 + items[2][1]]
    for _, text in items[3:7]:
        for kind in ("change", "add", "drop", "mixed"):
            words = text.split()
            made += ["lead in " + " ".join(edited(words, rng.sample(range(len(words)), len(words) // 5), kind, rng)) + " and out" for _ in range(8)]
    walks, exact = decontaminate.Index(items), exact_passages.Exact(items)
    found = walks.matches_of([t or "" for t in made])
    pairs = [({m[0] for m in a}, {m[0] for m in exact.matches(t or "")}) for a, t in zip(found, made, strict=True)]
    assert all(a <= b for a, b in pairs) and sum(map(len, (a for a, _ in pairs))) >= 0.97 * sum(len(b) for _, b in pairs)
    assert [m[1:3] for m in found[0] if m[0] == 3] == [(0, 40), (40, 80), (80, 120)]
    for a in found:  # passages of one item do not overlap
        assert all(x[2] <= y[1] for x in a for y in a if x[0] == y[0] and x[1] < y[1])
    bench = [tuple(r) for r in texts_of_benchmark()]
    walks, exact = decontaminate.Index(bench), exact_passages.Exact(bench)
    for found, text in zip(walks.matches_of(list(texts.values())), texts.values(), strict=True):
        assert {m[0] for m in found} == {m[0] for m in exact.matches(text)}


def texts_of_benchmark():
    return duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()


def test_stretches_make_up_the_item():
    for m in range(1, 80):
        for most in range(m):
            cut = exact_passages.stretches(m, most)
            assert len(cut) == most + 1 and cut[0][0] == 0 and cut[-1][1] == m
            assert all(a < b for a, b in cut) and all(x[1] == y[0] for x, y in zip(cut, cut[1:], strict=False))
    with pytest.raises(ValueError, match="share"):
        decontaminate.Index([(1, "a b c")], 1.0)


# ---------------------------------------------------------------- near-duplicates

def slow_fingerprint(text):
    import xxhash

    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_masks_cover():
    rng = random.Random(3)
    masks = simhash.covering_masks(list(range(64)), 4)
    assert len(masks) == 31 and all(30 <= m.bit_count() <= 36 for m in masks)
    for _ in range(2000):
        flipped = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not m & flipped for m in masks)


@pytest.mark.parametrize("bucket", [2048, 2])
def test_near_duplicates(spark, docs, texts, odd, bucket):
    prints = {d: slow_fingerprint(t) for d, t in texts.items()}
    least = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and least[a] != least[b]:
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    for r in simhash.near_duplicates(docs, bucket=bucket).collect():
        assert (int(r["fingerprint"], 16), r["component_id"]) == (prints[r["doc_id"]], least[r["doc_id"]])


def test_dense_group_reaches_finer_tables(spark):
    rng = random.Random(6)
    first = simhash.covering_masks(list(range(64)), 4)[0]
    free = [b for b in range(64) if not first >> b & 1][:12]  # all meet in one bucket of the first table
    fps = {sum(1 << b for b in rng.sample(free, rng.randint(0, 6))) for _ in range(300)} | {(1 << 63) | 5}
    assert len(fps) > simhash.SMALLEST + 20
    edges = simhash.links(spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long"), bucket=2)
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 4 for a, b in edges.collect())
    root = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    groups = Counter((find(f), root.get(simhash.signed(f), simhash.signed(f))) for f in fps)
    assert len(groups) == len({g for g, _ in groups}) == len({r for _, r in groups})


def test_two_coverings_leave_sixteen_bits():
    for radius in range(simhash.MOST_RADIUS + 1):
        masks = simhash.finer_masks(simhash.covering_masks(list(range(64)), radius), radius)
        assert min(m.bit_count() for m in masks) >= 48
        assert len(masks) == ((2 << radius) - 1) ** 2


@pytest.mark.parametrize("bits", [13, 15])
def test_thousands_of_fingerprints_over_few_bits(spark, bits):
    """A family inside one bucket of the first covering, over its first free bits, and the same spread by a wide code."""
    rng = random.Random(bits)
    first = simhash.covering_masks(list(range(64)), 4)[3]
    free = [b for b in range(64) if not first >> b & 1][:bits]
    spread = lambda x: sum(1 << free[k] for k in range(bits) if x >> k & 1)
    dense = [spread(x) for x in rng.sample(range(1 << bits), 5000)]
    # five other bits set keep these words from the family; they lie three or five bits from each other
    away = sum(1 << b for b in [b for b in range(64) if b not in free][:5])
    far = [away | spread(sum(0b11111 << 5 * k for k in range(3) if c >> k & 1) & (1 << bits) - 1) for c in range(8)]
    fps = sorted({*dense, *far})
    edges = simhash.links(spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long"))
    root = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    values = np.array(fps, dtype=np.uint64)
    label = np.full(len(fps), -1)
    for start in range(len(fps)):
        if label[start] < 0:
            label[start], stack = start, [start]
            while stack:
                near = np.flatnonzero((label < 0) & (np.bitwise_count(values ^ values[stack.pop()]) <= 4))
                label[near] = start
                stack += near.tolist()
    groups = {(int(g), root.get(simhash.signed(f), simhash.signed(f))) for g, f in zip(label, fps, strict=True)}
    assert len(groups) == len({g for g, _ in groups}) == len({r for _, r in groups}) > 1


# ---------------------------------------------------------------- personal data

def slow_base(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, pattern in kinds.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            yield kind, *m.span()


def test_base_spans_match_the_patterns(texts):
    rng = random.Random(8)
    mixed = ["".join(rng.choice("0123456789.+@-() aZ_%é") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    mixed += [pii.examples(3, 40)[k][0] for k in range(40)]
    for text in [*mixed, *texts.values(), "a@b.c@d.e.f", "@a.b x@y.z"]:
        assert pii.base_spans(text) == list(slow_base(text)), text


def test_field_on_new_examples():
    field, right, wrong, missed = pii.trained(), 0, 0, 0
    for text, spans in pii.examples(seed=1234, count=200):
        found = {s for low, high in pii.stretches(text) for s in field.best(text, low, high)}
        right, wrong, missed = right + len(found & set(spans)), wrong + len(found - set(spans)), missed + len(set(spans) - found)
    assert right / (right + wrong) > 0.93 and right / (right + missed) > 0.93


def test_field_program_finds_the_best_labelling():
    field = pii.trained()
    for text, _ in pii.examples(seed=5, count=15):
        for low, high in pii.stretches(text):
            stretch = pii.Stretch(text, low, high)
            if not 0 < len(stretch.segments) <= 60:
                continue
            scores = field.scores(stretch).max(axis=1)

            def best(at, stretch=stretch, scores=scores):
                return max([0.0, *(scores[s] + best(j) for s, (i, j) in enumerate(stretch.segments) if i >= at)])

            places = {(stretch.tokens[i][0], stretch.tokens[j - 1][1]): s for s, (i, j) in enumerate(stretch.segments)}
            got = sum(scores[places[a, b]] for _, a, b in field.best(text, low, high))
            assert got == pytest.approx(best(0))


def test_spans_and_masks(spark):
    text = "Call +1 (487) 555-7209 or mail a.b@mail.example.com; 12 4111111111111111 and 10.0.0.1, not 4111111111111112."
    df = spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long")
    row = pii.find(df).first()
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 0, 1)
    at = text.index("4111111111111111")
    assert f"card:{at}:{at + 16}" in row["spans"].split(",")
    assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in slow_base(text)).encode()).hexdigest()
    masked = pii.mask(df).first()
    assert masked["text"] == "Call [PHONE] or mail [EMAIL]; 12 [CARD] and [IP], not 4111111111111112."
    assert masked["n_chars"] == len(masked["text"])
    assert pii.mask(df.withColumn("text", F.lit(None).cast("string"))).first()["text"] is None
