"""The queries of the operators, with their SQL where SQL can say it."""

from docgauge.llm import (
    bpe, decontaminate, filter_audit, html_text, importance, lm_scoring, pii, quality_model, quality_rules, sharding,
    simhash, token_counts, warc,
)
from docgauge.llm.common import table


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op2_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary_file())


def op3_lm_scoring(spark, sf_dir):
    """Target: the documents that the labels call good."""
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return lm_scoring.score(table(spark, sf_dir, "documents"), good)


def op4_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"), shards=24)


def op5_warc(spark, sf_dir):
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))


def op6_bpe(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary_file(), keep_ids=False)


def op7_quality_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def op8_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op11_importance(spark, sf_dir):
    """Target: the benchmark."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op13_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op1_sql() -> str:
    ws = r"[\x20\x09-\x0D]"
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in quality_rules.stop_forms())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '{ws}+'), lambda x: x <> '') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) > 2),
k AS (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM g),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM k) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_marks,
        len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
        len(list_filter(words, lambda x: x IN ({stops}))) AS n_stop,
        len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…){ws}*$'))) AS n_ell,
        len(list_filter(lines, lambda x: regexp_matches(x, '^{ws}*[-•*‣]'))) AS n_bul
      FROM w LEFT JOIN covered USING (r)),
q AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_word_chars,
        CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0 END AS symbol_ratio,
        CASE WHEN n_words > 0 THEN n_marks / n_words ELSE 0.0 END AS mark_ratio,
        CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0.0 END AS stop_word_ratio,
        CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_ratio,
        CASE WHEN n_lines > 0 THEN n_ell / n_lines ELSE 0.0 END AS ellipsis_line_ratio,
        CASE WHEN n_lines > 0 THEN n_bul / n_lines ELSE 0.0 END AS bullet_line_ratio,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join([f"{c} >= {a}" for c, a, _ in quality_rules.THRESHOLDS if a is not None] + [f"{c} <= {b}" for c, _, b in quality_rules.THRESHOLDS if b is not None])} AS kept,
  mean_word_chars, symbol_ratio, mark_ratio, stop_word_ratio, dup_line_ratio, ellipsis_line_ratio, bullet_line_ratio
FROM q
"""


#: Base32 of a SHA-1 in hexadecimal: five hexadecimal digits are four letters.
_BASE32 = """array_to_string(list_transform(range(32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 5 * (k // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31)::INTEGER, 1)), '')"""

_OP5_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""


_OP13_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(lab.toxic, false) AS toxic,
        {'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words),
         'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t),
         'D': regexp_matches(t, '[#$%&*|]'), 'E': w.doc_id > min(w.doc_id) OVER (PARTITION BY t)} AS x
      FROM w LEFT JOIN lab ON w.doc_id = lab.doc_id),
fails AS (SELECT part, good, toxic, CASE WHEN x.A THEN 'A' ELSE '' END || CASE WHEN x.B THEN 'B' ELSE '' END || CASE WHEN x.C THEN 'C' ELSE '' END
        || CASE WHEN x.D THEN 'D' ELSE '' END || CASE WHEN coalesce(x.E, false) THEN 'E' ELSE '' END AS failed, count(*) AS n FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a JOIN letters b ON b.l <> a.l JOIN letters c ON c.l NOT IN (a.l, b.l)
        JOIN letters d ON d.l NOT IN (a.l, b.l, c.l) JOIN letters e ON e.l NOT IN (a.l, b.l, c.l, d.l)),
steps AS (SELECT o, k, substr(o, k, 1) AS own, substr(o, 1, k - 1) AS earlier FROM orders, (SELECT unnest(range(1, 6))::INTEGER AS k)),
judged AS (SELECT part, good, toxic, n, failed, o, k, own, contains(failed, own) AS bad,
        earlier <> '' AND regexp_matches(failed, '[' || earlier || 'Z]') AS gone FROM fails, steps),
r AS (SELECT part, o AS filter_order, k AS step, own, sum(CASE WHEN NOT bad AND NOT gone THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN bad AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN bad AND gone THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN failed = own THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN bad AND NOT gone AND good THEN n ELSE 0 END) AS good_lost,
        sum(CASE WHEN bad AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost FROM judged GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_token_counts, op3_lm_scoring, op4_sharding, op5_warc, op6_bpe, op7_quality_model,
    op8_decontamination, op9_simhash, op10_pii, op11_importance, op12_html_text, op13_filter_audit)}
ORACLES = {"op1_quality_rules": _op1_sql(), "op5_warc": _OP5_SQL, "op13_filter_audit": _OP13_SQL}
