"""Language by trigram profiles: profiles, lines, documents and the hook of the evaluation."""

from collections import Counter

import pytest

from docgauge.operators import language
from docgauge.plans.evaluate import evaluate

LEARN = [("en", "the weather in the north is the best of the year"), ("de", "das Wetter im Norden ist das schönste des Jahres"),
         (None, "of no language"), ("en", None), ("de", "")]


@pytest.fixture(scope="module")
def profiles(spark):
    return language.learn_profiles(spark.createDataFrame(LEARN, "lang string, text string"), "lang", "text", 20)


def _grams(text):
    padded = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    return [padded[i:i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " "]


def test_profiles_are_the_most_frequent_trigrams(profiles):
    got = {(r.lang, r.gram): r.weight for r in profiles.collect()}
    for lang in ("en", "de"):
        counts = Counter(g for name, t in LEARN if name == lang for g in _grams(t or ""))
        want = sorted(counts, key=lambda g: (-counts[g], g.encode()))[:20]
        assert {g: w for (name, g), w in got.items() if name == lang} == {g: 20 - r for r, g in enumerate(want)}


def test_lines_and_documents(spark, profiles):
    texts = ["the north of the year\n\ndas ist der Norden\n 12 !\nthe end", "zzz", None, "", "  \n ", "the " * 100_000 + "\ndas ist"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, body string")
    lines = language.line_languages(docs, "k", "body", profiles)
    weight = {(r.lang, r.gram): r.weight for r in profiles.collect()}
    for r in lines.collect():
        grams = Counter(_grams(texts[r.k].split("\n")[r.line]))
        assert r.sums == {n: sum(weight.get((n, g), 0) * c for g, c in grams.items()) for n in ("de", "en")}
    got = {(r.k, r.line): r.language for r in lines.collect()}
    assert got == {(0, 0): "en", (0, 2): "de", (0, 3): "und", (0, 4): "en", (1, 0): "und", (5, 0): "en", (5, 1): "de"}
    found = {r.k: (r.n_lines, r.lang_share, r.language) for r in language.document_languages(lines, "k", ["de", "en"]).collect()}
    assert found == {0: (4, 0.5, found[0][2]), 1: (1, 0.0, "und"), 5: (2, 0.5, "en")} and found[0][2] in ("de", "en")
    assert "Python" not in lines._jdf.queryExecution().executedPlan().toString()


def test_ties_and_empty_inputs(spark):
    same = spark.createDataFrame([("b", "one text"), ("a", "one text")], "lang string, text string")
    profiles = language.learn_profiles(same, "lang", "text")
    docs = spark.createDataFrame([(1, "one")], "k int, body string")
    assert [r.language for r in language.line_languages(docs, "k", "body", profiles).collect()] == ["a"]
    assert language.line_languages(docs.limit(0), "k", "body", profiles).collect() == []
    none = language.learn_profiles(same.limit(0), "lang", "text")
    assert [r.language for r in language.line_languages(docs, "k", "body", none).collect()] == ["und"]


def test_more_profiles_than_fit_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_ROWS", 5)
    with pytest.raises(ValueError):
        language.learn_profiles(spark.createDataFrame(LEARN, "lang string, text string"), "lang", "text")


def test_evaluation_takes_a_given_share(spark, profiles):
    rows = [(1, "a.txt", "das ist der Norden des Jahres\ndas ist im Norden", "tweet"), (2, "b.txt", "the north of the year", "tweet"), (3, "c.txt", "", "tweet")]
    docs = spark.createDataFrame(rows, "doc_id int, filename string, text string, document_type string")
    shared = language.with_lang_share(docs, profiles)
    assert {r.doc_id: r.lang_share for r in shared.collect()} == {1: 0.0, 2: 1.0, 3: None}
    scores = {r.doc_id: r.type_specific_metrics[0].score for r in evaluate(shared, "2024-01-01").collect()}
    assert scores == {1: 70.0, 2: 100.0, 3: 100.0}
