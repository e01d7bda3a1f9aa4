"""Importance resampling, main text of pages and the filter audit against brute force."""

import hashlib
import html
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser
from itertools import permutations

import duckdb
import numpy as np
import pytest

import check_oracles
from docgauge.llm import filter_audit, html_text, importance
from docgauge.llm import queries as Q

SF = "/root/testdata/sf0.001"
ODD = ["", None, " \t\n ", "a", "One two\nthree ONE", "é" * 3000, "x y " * 300_000, "a_b-c #1 日本\x1cz", "same text", "same text", "W " * 30]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, odd texts, one of a megabyte, and extra columns whose names clash with inner ones."""
    rows = [(None if k == 3 else 7 if k == 9 else k, t, None if k % 4 == 1 else "en", k, "w", 1.5) for k, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, digest string, score double")
    return df.union(df.where("doc_id = 10"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---------------------------------------------------------------- importance resampling

def slow_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def slow_resample(rows, targets):
    """(doc_id, n_features, weight, score, rank) of each row, by spelled-out features."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    features = [slow_features(t) for _, t in rows]
    s, t = (Counter(bucket(f) for _, fs in group for f in fs) for group in (features, [slow_features(x) for x in targets]))
    s_all, t_all = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
    out = []
    for (key, _), (words, fs) in zip(rows, features, strict=True):
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(n * gain(b) for b, n in Counter(map(bucket, fs)).items())
        out.append([key, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(able[:5 * len(able) // 100], 1):
        r[4] = k
    return Counter(tuple(r[:5]) for r in out)


def test_resampling_matches_brute_force(spark, docs):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = Counter(tuple(r) for r in Q.QUERIES["op11_importance"](spark, SF).collect())
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    expected = slow_resample(rows, [r["text"] for r in target.collect()])
    assert found == expected
    assert sum(n for r, n in found.items() if r[4] is not None) == 5 * sum(slow_features(t)[0] >= 20 for _, t in rows) // 100 > 0


def test_resampling_of_odd_rows(spark, odd):
    """Nulls, ties and repeats: 48 copies of one row, so two are drawn of those with equal score and id."""
    many = odd.select("doc_id", "text", "score").union(spark.range(48).selectExpr("cast(5 AS long)", "repeat('tie ', 25)", "0.0"))
    target = spark.createDataFrame([("one two",), (None,), ("",)], "text string")
    found = Counter(tuple(r) for r in importance.resample(many, target).collect())
    rows = [(r["doc_id"], r["text"]) for r in many.collect()]
    assert found == slow_resample(rows, ["one two", None, ""])
    empty = importance.resample(many.where("false"), target)
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert importance.resample(many, target.where("false")).count() == many.count()


def test_checksums_compose():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcé日9") for _ in range(rng.choice([1, 2, 7, 300, 70_000]))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 6))).encode() for _ in range(40)]
    runs = importance.Runs(texts)
    gains = np.array([rng.randint(-9000, 9000) for _ in range(10_000)])
    spelled = [[zlib.crc32(f.encode()) % 10_000 for f in slow_features(t.decode())[1]] for t in texts]
    assert runs.weights(gains).tolist() == [sum(int(gains[b]) for b in bs) for bs in spelled]
    assert runs.counts().tolist() == np.bincount([b for bs in spelled for b in bs], minlength=10_000).tolist()


def test_dictionary_emits_a_payload_for_each_word():
    text = b" a  bc a abc bc "
    ends, checksum, length = importance.Dictionary(set(text.split())).scan(text)
    assert [text[e - n:e] for e, n in zip(ends, length, strict=True)] == text.split()
    assert checksum.tolist() == [zlib.crc32(w) for w in text.split()]
    assert importance.Runs([]).counts().sum() == 0


# ---------------------------------------------------------------- main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar comments-open">
<header><h1>Site name</h1><a href="/">home</a></header><div id="mainMenu"><a href=a>One</a><a href=b>Two</a></div>
<div role="alert">We use cookies on this site, as all sites do, to count how many people read it.</div>
%s
<aside>Other things to read that are quite long, so that they might count as text of their own.</aside>
<form><p>Enter your name and your address here to get letters.</p></form>
<section class="reader-comments"><p>I have read this and disagree with each of its many words.</p></section><footer>&copy; us</footer></body></html>"""
STORY = ["The title", "First para &amp; more\n  text, <b>bold</b> and <a href=x>linked</a> words of the story.",
         "Second&nbsp;para with caf&eacute;, 1 &lt; 2<br>and a line more of it.", "Short."]
PLAIN = "The title\n\nFirst para & more text, bold and linked words of the story.\n\nSecond para with café, 1 < 2 and a line more of it.\n\nShort."


@pytest.mark.parametrize("story", [
    "<article><header><h1>{0}</h1></header><p>{1}<p>{2}<p>{3}<script>x='</p>'</script><footer>tags</footer></article>",
    "<main><h1>{0}</h1><div><div><p>{1}</p></div><p>{2}</p><p>{3}</p></div><div class='share-buttons'><a href=q>Share</a></div></main>",
    "<div><h2>{0}</h2><div class=content><p>{1}</p><p>{2}</p><p>{3}</p><div class='ad'>Buy now, it is cheap and good for you.</div></div></div>",
    "<table><tr><td><a href=1>x</a><td><h1>{0}</h1><p>{1}<p>{2}<p hidden>secret<p>{3}</table>",
    "<div id=content><h1>{0}</h1>{1}<hr>{2}<hr>{3}<!-- a > b --></div>",
])
def test_main_text_of_layouts(story):
    assert html_text.main_text(PAGE % story.format(*STORY)) == PLAIN


def test_article_in_two_parts():
    part = lambda k: f"<div><p>Part {k} has some words of its own, told at length.</p><p>And then it goes on, {k} times.</p></div>"
    page = f"<body><div><a href=a>Link one</a> <a href=b>Link two</a></div><div>{part(1)}{part(2)}</div></body>"
    assert html_text.main_text(page).count("\n\n") == 3


def test_pages_give_their_articles(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = Q.QUERIES["op12_html_text"](spark, SF).collect()
    assert len(found) == len(pages)
    for r in found:
        article = re.search(r"(?s)<article>(.*)</article>", pages[r["page_id"]]["html"])[1]
        blocks = re.split(r"</?(?:p|h1)>", article)
        plain = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in blocks]
        assert r["text"] == "\n\n".join(b for b in plain if b)
        assert (r["url"], r["n_chars"]) == (pages[r["page_id"]]["url"], len(r["text"]))


class Plain(HTMLParser):
    """A plain tree of well-formed pages, as nested lists."""

    def __init__(self):
        super().__init__()
        self.root = ["#page", []]
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        self.stack[-1][1].append([tag, []])
        if tag != "br":
            self.stack.append(self.stack[-1][1][-1])

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][1].append(data)


def slow_density(node, share=None, linked=False):
    """Facts of each node in page order, by recursion: (chars, tags, link chars, link tags), own chars, linked."""
    linked = linked or node[0] == "a"
    own = sum(len("".join(x.split())) for x in node[1] if isinstance(x, str))
    total, rows = [own, 0, own * linked, int(node[0] == "a")], []
    for child in node[1]:
        if not isinstance(child, str):
            below = slow_density(child, share, linked)
            total = [a + b for a, b in zip(total, below[0][0], strict=True)]
            total[1] += 1
            rows += below
    return [(total, own, linked, node)] + rows


def test_densities_match_the_recursion():
    rng = random.Random(5)

    def made(depth):
        parts = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice(["text", "div", "p", "a", "br"] if depth else ["text"])
            body = " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 30)))
            parts.append(body if kind == "text" else "<br>" if kind == "br" else f"<{kind}>{body if kind in 'pa' else made(depth - 1)}</{kind}>")
        return "".join(parts)

    for _ in range(60):
        page = f"<html><body>{made(4)}</body></html>"
        tree, plain = html_text.Tree(page), Plain()
        plain.feed(page)
        plain.close()
        rows = slow_density(plain.root)
        assert tree.name == [r[3][0] for r in rows]
        share = rows[0][0][2] / max(rows[0][0][0], 1)

        def density(chars, tags, links, link_tags):
            if not chars:
                return 0.0
            base = max(2.0, math.log(chars / max(chars - links, 1) * links + share * chars + math.e))  # noqa: B023
            return chars / max(tags, 1) * math.log(max(1, chars * max(tags, 1) / (max(links, 1) * max(link_tags, 1)))) / math.log(base)

        of = {id(r[3]): density(*r[0]) for r in rows}
        sums = [(0.0 if r[2] else density(r[1], 1, 0, 0)) + sum(of[id(x)] for x in r[3][1] if not isinstance(x, str)) for r in rows]
        found = html_text.densities(tree, [False] * len(rows))
        assert np.allclose(found[0], list(of.values())) and np.allclose(found[1], sums)
        roots = html_text.chosen(tree, [False] * len(rows))
        body = tree.name.index("body")
        best = max(range(body, len(rows)), key=lambda k: sums[k])
        assert any(k == best or best in _below(tree, k) for k in roots)
        path, k = [best], best
        while k != body:
            k = tree.parent[k]
            path.append(k)
        threshold = min(of[id(rows[k][3])] for k in path)
        for k in roots:  # each chosen node is the greatest sum below some node at or above the threshold, or a heading
            above = [k]
            while above[-1] != body:
                above.append(tree.parent[above[-1]])
            assert any(found[0][x] >= threshold and math.isclose(max(sums[y] for y in _below(tree, x) | {x}), sums[k]) for x in above)


def _below(tree, k):
    inside = {k}
    for x in range(k + 1, len(tree.name)):
        if tree.parent[x] in inside:
            inside.add(x)
    return inside - {k}


def test_pages_of_odd_rows(spark):
    texts = [None, "", "  ", "plain", "<p>a", "<nav>x</nav>", "<script>x", "a<b", "<!-- x", "<p>" + "word &amp; " * 200_000]
    rows = [(None if k == 3 else k, None if k == 2 else "u", t, "x", 0) for k, t in enumerate(texts)] + [(4, "u", "<p>a", "x", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    found = sorted((-1 if r["page_id"] is None else r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(df).collect())
    long = ("word & " * 200_000).strip()
    assert found == sorted([(0, "", 0), (1, "", 0), (2, "", 0), (-1, "plain", 5), (4, "a", 1), (4, "a", 1), (5, "", 0), (6, "", 0), (7, "a", 1), (8, "", 0), (9, long, len(long))])
    assert html_text.extract(df.where("false")).collect() == []
    assert html_text.extract(df.drop("url")).where("url is null").count() == len(rows)


def test_hostile_pages_take_time_in_proportion():
    for page in ("<div>" * 50_000 + "x", "<ul><li>" * 30_000 + "</ol>" * 30_000, "<table><td>" + "<span>" * 50_000 + "</div>" * 50_000,
                 '<a ="' * 30_000 + ">x", "<!x" * 50_000, "<b><p>" * 30_000 + "</b>" * 30_000, "<p>x</p>" * 30_000, "&amp;<" * 50_000):
        begin = time.time()
        html_text.main_text(page)
        assert time.time() - begin < 10


# ---------------------------------------------------------------- filter audit

def slow_audit(rows, labels):
    """Runs every order over the rows."""
    good, toxic = ({d for d, *marks in labels if marks[k] == 1} for k in (0, 1))
    first = {}
    for key, text, _ in rows:
        if key is not None:
            first[text or ""] = min(key, first.get(text or "", key))
    facts = []
    for key, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                  "D": bool(re.search(r"[#$%&*|]", text)), "E": key is not None and first[text] < key}
        facts.append((part or "", {k for k, v in failed.items() if v}, key in good, key in toxic))
    out, shapley = {}, defaultdict(int)
    for part in {f[0] for f in facts}:
        for order in permutations("ABCDE"):
            left = gone = [f for f in facts if f[0] == part]
            gone = []
            for step, name in enumerate(order, 1):
                cut = [f for f in left if name in f[1]]
                left = [f for f in left if name not in f[1]]
                own = [f for f in facts if f[0] == part and f[1] == {name}]
                out[part, "".join(order), step] = [len(left), len(cut), sum(name in f[1] for f in gone), len(own), sum(f[2] for f in cut), sum(f[3] for f in cut), name]
                shapley[part, name] += len(cut)
                gone += cut
    return {k: (*v[:6], shapley[k[0], v[6]]) for k, v in out.items()}


def as_dict(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


def test_audit_matches_brute_force_and_sql(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert as_dict(Q.QUERIES["op13_filter_audit"](spark, SF)) == slow_audit(rows, labels)
    con = duckdb.connect()
    for t in check_oracles.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    line = check_oracles.check(spark, con, "op13", Q.QUERIES["op13_filter_audit"], Q.ORACLES["op13_filter_audit"], SF)
    assert line.startswith("OK"), line


def test_audit_of_odd_rows(spark, odd):
    """Null ids, texts, parts and labels, several labels of one id, copies under one id and over ids and parts."""
    copies = spark.range(300).selectExpr("100 + id % 150", "'copied text'", "if(id % 2 = 0, 'en', 'fr')", "1", "''", "0.0")
    nulls = spark.range(20).selectExpr("cast(null AS long)", "'copied text'", "'en'", "1", "''", "0.0")
    many = odd.union(copies).union(nulls)
    labels = spark.createDataFrame([(100, 1, 0), (100, 0, 1), (None, 1, 1), (4, None, 1), (10, 1, None), (555, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [tuple(r) for r in many.select("doc_id", "text", "lang").collect()]
    marks = [tuple(r) for r in labels.where("doc_id is not null").collect()]
    assert as_dict(filter_audit.audit(many, labels)) == slow_audit(rows, marks)
    assert as_dict(filter_audit.audit(many, labels.where("false"))) == slow_audit(rows, [])
    assert filter_audit.audit(many.where("false"), labels).collect() == []


def test_adders_count_positions():
    rng = np.random.default_rng(4)
    adder, expected = filter_audit.Adder(), np.zeros(32, np.int64)
    for size in (0, 1, 2, 3, 50_000, 7):
        words, times = rng.integers(0, 1 << 32, size, dtype=np.uint32), rng.integers(1, 1000, size)
        adder.add(words, times)
        expected += ((words[:, None] >> np.arange(32, dtype=np.uint32)) & 1).astype(np.int64).T @ times
    assert adder.counts() == expected.tolist()
    assert filter_audit.SURVIVAL[0] == 0xFFFFFFFF and filter_audit.SURVIVAL[31] == 1
