"""Type-specific metrics on small documents with planted defects."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from docgauge.functions import json_fold as J
from docgauge.functions import text as X
from docgauge.functions import values as V
from docgauge.operators import contract, general, mail, markup, records, social, tabular

CONTRACT = """RENTAL AGREEMENT

this paper is made someday between party a and party b.
party a lends things. party b returns them.

there is no signature block here.
there is nothing about termination.
the governing law is open.

party a: ________
"""
RAGGED = """id|name|email|amount|day
1|Ann Lee||10.50|2023-01-01
2||bob@example.com|ten|02-01-2023
|Cy|cy@|null|
4|Di||0|99/99/9999
5|Ed||-5|
|Only two cells"""
CUSTOMERS = """ID,Name,Mail,Age,Joined,Spend,Land,State
A1,Ann Lee,ann@example.com,30,2023-01-15,15.50,France,Active
A2,Bob Ray,bob@@mail,abc,2023-13-45,NaN,,Active
A3,,cy@example.com,34,2023-07-22,20.00,France,
A1,Ann Lee,ann@example.com,30,2023-01-15,15.50,France,Active
A5,Ed   Orr,ed@example.com,-5,2024/03/10,999,FR,ACTV
A6,Flo N,flo@test.io,52,2025-11-01,75.25,Spain,Inactive
A7,Gus S,gus#example.com,41,2025-06-30,30.00,France,Active
A8,Hal M,hal@example.de,,2025-08-19,0,Italy,Active
A9,Ida P,ida@example.com,27,2025-09-05,85.00,France,Active
A10,,,,,,,"""
INVOICE = """{"invoice_number": null, "date": "2024/99/99", "vendor": 77, "items": {"0": "Pen", "1": "Ink"},
 "total": "nine", "tax": null, "status": "OPEN", "customer_info": {"name": "", "address": null, "email": "nope"}}"""
RECORDS = """[{"id":"E1","pay":100,"on":true},{"id":"E2","pay":"lots","on":true},{"id":"E3","pay":90,"on":"yes"},
 {"id":"E4","pay":null,"on":false},{"id":"E1","pay":100,"on":true},{"id":"E5","pay":-1,"on":true},{"id":"E6","pay":80,"on":"yes"}]"""
SPAM = """Date: Unknown
Subject: You WON (No Reply)
To: undisclosed-recipients:;
From: admin-1@suspicious-place.xyz

ACT NOW PLEASE.
Please click the link below to claim it immediately or your account will be closed.
http://bit.example/bad

Files:
bill.exe (Size: 1MB)
reset.zip
"""


def scores(spark, text, build, prepare=None):
    df = spark.createDataFrame([(text,)], "raw string")
    df = prepare(df) if prepare else df
    return [m["score"] for m in df.select(build(F.col("raw")).alias("m")).first().m]


def json_scores(spark, text):
    prepare = lambda df: records.with_type_checks(df.withColumn("v", F.try_parse_json("raw")), "v")
    return scores(spark, text, lambda _: records.metrics(F.col("v"), F.col("type_checks")), prepare)


def test_contract(spark):
    assert scores(spark, CONTRACT, lambda c: contract.metrics(V.no_fields(), X.normalize_text(c))) == [20.0, 20.0, 0.0, 100.0]


def test_tabular(spark):
    assert scores(spark, RAGGED, tabular.metrics) == [0.0, 80.0, 100.0, 66.7]
    assert scores(spark, CUSTOMERS, tabular.metrics) == [60.0, 100.0, 100.0, 85.0]
    assert scores(spark, "", tabular.metrics) == [50.0, 50.0, 0.0, 50.0]


def test_json(spark):
    assert json_scores(spark, INVOICE) == [75.0, 100.0, 100.0, 75.0]
    assert json_scores(spark, RECORDS) == [100.0, 100.0, 100.0, 66.7]
    assert json_scores(spark, "{bad") == [0.0, 0.0, 100.0, 0.0]
    # mixed list, number kept as text, list of one not looked into
    assert json_scores(spark, '[1,{"a":"2","z":[1,"x"],"b":{}},[{"q":"1"}]]')[1] == 70.0


def test_markup_gate(spark):
    assert scores(spark, "no tags here", markup.metrics) == [50.0] * 4
    page = "<html><body><p>x</p><img src='a'><a href='b'>l</a></body></html>"
    assert scores(spark, page, markup.metrics) == [100.0, 100.0, 50.0, 100.0]
    deep = "<b>" * 16 + "</b>" * 16
    assert scores(spark, deep, markup.metrics)[1] == 60.0


def test_mail(spark):
    assert scores(spark, SPAM, lambda c: mail.metrics(X.normalize_text(c))) == [80.0, 100.0, 100.0, 100.0]
    assert scores(spark, SPAM, lambda c: mail.metrics(X.normalize_text(X.mail_to_text(c))))[0] == 40.0


def test_general_and_social_edges(spark):
    assert scores(spark, "", general.metrics) == [50.0, 50.0, 50.0, 100.0]
    assert scores(spark, None, social.metrics) == [100.0, 100.0, 100.0]
    shout = "BUY NOW NOW NOW " * 3
    assert scores(spark, shout, social.metrics)[2] == 100 - 30 - 15


def test_flat_json_keeps_source_order(spark):
    raw = '{"b":{"y":1.0,"x":null},"a":[true,"t",[]]}'
    df = spark.createDataFrame([(raw,), ("{bad",)], "raw string")
    rows = [r.flat for r in records.with_flat_text(df, "raw", "flat").select("flat").collect()]
    assert rows == ["b: y: 1.0\nb: x: None\na: [0] True\na: [1] t\n", None]


def test_deep_json_stands_beside_flat_json(spark):
    deep = '{"a":' * 15 + '{"b":"1","c":[1,"]"]}' + "}" * 15
    df = spark.createDataFrame([(deep,), ('{"a": 1}',), ("{bad",)], "raw string").withColumn("v", F.try_parse_json("raw"))
    checks = [r[0] for r in records.with_type_checks(df, "v").select("type_checks").collect()]
    assert [c and (c["done"], c["passed"]) for c in checks] == [(18, 17.0), (1, 1.0), None]
    flat = [r.flat for r in records.with_flat_text(df, "raw", "flat").select("flat").collect()]
    assert flat[0].split("\n")[0] == "a: " * 15 + "b: 1" and flat[1:] == ["a: 1", None]


def test_escaped_strings_do_not_hide_levels(spark):
    for start in (r'"t":"a\nb"', r'"p":"C:\\"', r'"q":"\"{["', r'"u":"\u00e9\t"', '"s":"' + r"\\\"x" * 9000 + '"'):
        raw = "{" + start + ',"a":{"b":{"c":{"d":{"e":"1"}}}}}'
        df = spark.createDataFrame([(raw,)], "raw string").withColumn("v", F.try_parse_json("raw"))
        for text in (None, "raw"):
            assert tuple(records.with_type_checks(df, "v", text).first().type_checks) == (
                6, 5.5, ["'a.b.c.d.e': numeric value stored as string ('1')"])
        flat = records.with_flat_text(df, "raw", "flat").first().flat
        assert flat.endswith("\na: b: c: d: e: 1")


def slow_checks(value, path="", issues=None):
    """The rules by plain recursion: checks, credit and issues."""
    done, passed, issues = 0, 0.0, [] if issues is None else issues
    if isinstance(value, dict):
        for key, x in value.items():
            at, done, credit = f"{path}.{key}" if path else key, done + 1, 1.0
            if isinstance(x, (dict, list)):
                d, p = slow_checks(x, at, issues)
                done, passed = done + d, passed + p
            elif isinstance(x, str) and re.fullmatch(r"-?\d+\.?\d*", x.strip()):
                credit = 0.5
                issues.append(f"'{at}': numeric value stored as string ('{x.strip()}')")
            elif isinstance(x, str) and x.strip().lower() in ("true", "false"):
                credit = 0.5
                issues.append(f"'{at}': boolean stored as string ('{x.strip()}')")
            passed += credit
    elif isinstance(value, list) and len(value) > 1:
        for k, x in enumerate(value):
            if isinstance(x, (dict, list)):
                d, p = slow_checks(x, f"{path}[{k}]", issues)
                done, passed = done + d, passed + p
        seen = {type(x).__name__ for x in value}
        done += 1
        passed += 1.0 if len(seen) == 1 else 0.5
        if len(seen) > 1:
            issues.append(f"'{path}': mixed types in array ({', '.join(n for n in J.TYPES if n in seen)})")
    return done, passed


def slow_flat(value, prefix=""):
    if isinstance(value, dict):
        return "\n".join(slow_flat(x, f"{prefix}{k}: ") for k, x in value.items())
    if isinstance(value, list):
        return "\n".join(slow_flat(x, f"{prefix}[{k}] ") for k, x in enumerate(value))
    return f"{prefix}{value}"


def random_json(rng, depth):
    kind = rng.random()
    if depth and kind < 0.35:
        return {rng.choice(["a", "b", "c d", "é:", 'q"', "\\", "t\t"]): random_json(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    if depth and kind < 0.65:
        return [random_json(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return rng.choice([None, True, False, 3, -12345678901, 1.5, "12", " -3. ", "\n7.0\t", "TRUE", "false ", "", "x", 'a "b": [c]', "\\", "é\u2028{", "1e5", "trues", 123456789012345678901])


def test_folds_match_recursion(spark):
    rng = random.Random(8)
    values = [random_json(rng, 6) for _ in range(600)] + [{}, [], [[]], [{}], "1", 5, None, [1, "x"], [["1", {"a": "1"}]]]
    texts = [json.dumps(v, ensure_ascii=k % 2 == 0, indent=1 if k % 3 == 0 else None) for k, v in enumerate(values)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, raw string").withColumn("v", F.try_parse_json("raw"))
    rows = records.with_flat_text(records.with_type_checks(df, "v", "raw"), "raw", "flat").orderBy("id").collect()
    for value, row in zip(values, rows, strict=True):
        issues = []
        assert (row.type_checks.done, row.type_checks.passed) == slow_checks(value, issues=issues)
        assert row.type_checks.issues == issues
        assert row.flat == slow_flat(value)


def test_deep_and_long_texts_leave_the_plan_as_it_is(spark):
    """One text of 900 levels and one of 60,000 issues among ordinary rows; no job runs before the action."""
    deep = '{"a":[0,' * 450 + '{"b":"1"}' + "]}" * 450
    long = "[" + ",".join(f'{{"k{k}":"{k}"}}' for k in range(60_000)) + "]"
    plans = []
    for rows in ([('{"a": 1}',)], [('{"a": 1}',), (deep,), (long,), (None,), ("[" * 5000,)] + [(f'{{"x": "{k}"}}',) for k in range(50)]):
        df = spark.createDataFrame(rows, "raw string").withColumn("v", F.try_parse_json("raw"))
        spark.sparkContext.setJobGroup("building", "")
        out = records.with_flat_text(records.with_type_checks(df, "v", "raw"), "raw", "flat").drop("v")
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        plans.append(len(out._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        found = {r.raw: r for r in out.collect()}
    assert plans[0] == plans[1]
    assert (found[deep].type_checks.done, found[deep].type_checks.passed) == (901, 675.5)
    assert found[deep].flat.split("\n")[-1] == "a: [1] " * 450 + "b: 1"
    assert len(found[long].type_checks.issues) == 60_000 and found[long].type_checks.issues[-1] == "'[59999].k59999': numeric value stored as string ('59999')"
    assert found[long].flat.split("\n")[59_999] == "[59999] k59999: 59999"
    assert found[None].type_checks is None and found["[" * 5000].flat is None



def test_wide_tables_are_typed_whole(spark):
    for width in (50, 60, 100):
        line = ",".join(["7"] * width)
        text = "\n".join([",".join(f"c{k}" for k in range(width)), line, line])
        df = spark.createDataFrame([(text,)], "t string")
        assert df.select(tabular.tabular_metric(F.col("t"), "Column Type Consistency").alias("m")).first().m.score == 100.0


def test_first_seen_word_wins_a_tie(spark):
    words = "zebra apple mango zebra apple mango plum".split()
    df = spark.createDataFrame([(words,), ([],)], "w array<string>").select(general.word_profile(F.col("w")).alias("p"))
    assert [tuple(r.p) for r in df.collect()] == [(7, 4, 2, "zebra"), (0, 0, 0, "")]


def brute_profile(rows):
    """Schema compliance and drift of parsed records, first record as reference."""
    first, others = rows[0], rows[1:]
    if not others:
        return 100.0, 100.0
    keys = set(first) if isinstance(first, dict) else set()
    done = passed = drift = 0.0
    for r in others:
        if not isinstance(r, dict):
            drift += 1
            continue
        done += 1
        passed += 1 if set(r) == keys else len(set(r) & keys) / max(len(set(r) | keys), 1)
        if set(r) != keys:
            drift += 1
        elif any(type(r[k]) is not type(first[k]) for k in keys):
            drift += 0.5
    compliance = passed / done * 100 if done else 100.0
    return round(compliance, 1), round(max(0, 100 - drift / len(others) * 100), 1) if isinstance(first, dict) else 100.0


def test_record_profile_with_a_hot_group(spark):
    import json
    import random

    rng = random.Random(1)
    shapes = ['{"a":1,"b":"x"}', '{"b":"y","a":2}', '{"a":"1","b":"x"}', '{"a":1}', "3", '{"a":null,"b":"x","c":1.5}']
    rows = [("hot" if i % 3 else f"g{i % 7}", i, rng.choice(shapes)) for i in range(900)] + [("one", 1, "[1]")]
    df = spark.createDataFrame(rows, "g string, i int, r string").repartition(8)
    got = {r.g: (r.schema_compliance, r.schema_drift_rate) for r in records.profile_records(df, "g", "i", "r").collect()}
    groups = {}
    for g, i, r in sorted(rows, key=lambda x: x[1]):
        groups.setdefault(g, []).append(json.loads(r))
    want = {g: brute_profile(rs) for g, rs in groups.items()}
    assert got.keys() == want.keys()
    for g in want:
        assert abs(got[g][0] - want[g][0]) < 0.11 and abs(got[g][1] - want[g][1]) < 0.11, g


def test_tag_counts_of_many_names(spark):
    """100,000 tags of 10,000 names, every tenth left open; the whole list, and the text's five in order of appearance."""
    page = "".join(f"<t{k % 10_000}>x" + ("" if k % 10_000 % 10 == 0 else f"</t{k % 10_000}>") for k in range(100_000)) + "<br></zz>"
    df = spark.createDataFrame([(page,), ("plain",), (None,), ("<br>",), ("<b></b></b><i>",)], "html string")
    rows = df.select(markup.tag_validity(F.col("html")).alias("m"), markup.mismatched_tags(F.col("html")).alias("wrong")).collect()
    assert len(rows[0].wrong) == 1000 and rows[0].wrong[1] == "<t10>: 10 open, 0 close"
    assert rows[0].m.score == 90.0 and rows[0].m.details.endswith("Mismatches: " + "; ".join(rows[0].wrong[:5]))
    assert [r.m.score for r in rows[1:]] == [50.0, 50.0, 100.0, 0.0]
    assert rows[4].wrong == ["<b>: 1 open, 2 close", "<i>: 1 open, 0 close"]


def test_all_families_are_evaluated_by_one_plan(spark):
    from docgauge.plans import load

    plan = load().QUERIES["evaluate_families"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # the parts are only put together below the deal; the evaluation stands above it, once
    assert "RepartitionByExpression" in plan.split("Union")[0]
