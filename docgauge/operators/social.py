"""Social media metrics: language, offensive terms, spam."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgauge import rules
from docgauge.functions.scoring import finding, metric
from docgauge.functions.text import (
    any_of, bind, content_lines, flag, hits, latin_words, percent, stripped_parts, token_count, total,
)

WORD_BREAK = r"[^\p{L}\p{N}_]+"


def step_penalty(value: Column, *steps) -> Column:
    """Penalty of the first exceeded limit; steps are (limit, penalty), highest first."""
    out = F.lit(0)
    for limit, penalty in reversed(steps):
        out = F.when(value > limit, penalty).otherwise(out)
    return out


def english_share(text: Column) -> Column:
    """Share of lines whose function words are English; NULL without lines.

    Each language has a fixed profile of function words; the language with the
    most hits wins a line and English wins ties.
    """
    profiles = rules.LANGUAGE_PROFILES

    def is_english(line: Column) -> Column:
        def judged(words: Column) -> Column:
            def of(profile: list[str]) -> Column:
                return F.size(F.filter(words, lambda w: w.isin(profile)))

            count = {n: of(p) for n, p in profiles.items()}
            return bind(
                F.struct(count["en"].alias("en"), F.greatest(*[c for n, c in count.items() if n != "en"]).alias("other")),
                lambda c: (c["en"] > 0) & (c["en"] >= c["other"]),
            )

        return bind(F.split(F.lower(line), WORD_BREAK), judged)

    return bind(
        content_lines(text),
        lambda lines: F.when(F.size(lines) > 0, F.size(F.filter(lines, is_english)) / F.size(lines)),
    )


def language_consistency(text: Column, lang_share: Column | None = None, low: Column | None = None) -> Column:
    """Penalise non-English lines, slang and shouting.

    ``lang_share`` is the share of English lines: ``english_share(text)``, a
    column from an external detector, or None to skip the language test.
    """
    text = F.coalesce(text, F.lit(""))
    lang_share = F.lit(None).cast("double") if lang_share is None else lang_share

    def judged(words: Column) -> Column:
        n = F.size(words)
        shouted = F.size(F.filter(words, lambda w: w.rlike(r"^[A-Z]{2,}$")))
        slang = hits(F.lower(text) if low is None else low, any_of(rules.SLANG_PATTERNS))
        facts = F.struct(
            n.alias("n"),
            (slang / F.greatest(n, F.lit(1))).alias("slang"),
            (shouted / F.greatest(n, F.lit(1))).alias("caps"),
            lang_share.alias("lang"),
        )

        def scored(f: Column) -> Column:
            penalty = (
                F.when(f["lang"] < 0.5, 30).when(f["lang"] < 0.8, 15).otherwise(0)
                + step_penalty(f["slang"], (0.3, 30), (0.15, 15))
                + step_penalty(f["caps"], (0.3, 20), (0.15, 10))
            )
            notes = F.concat_ws(
                "; ",
                F.when(f["lang"] < 0.5, F.concat(F.lit("Mixed language content: only "), percent(f["lang"]), F.lit(" English")))
                .when(f["lang"] < 0.8, F.concat(F.lit("Some non-English content: "), percent(f["lang"]), F.lit(" English"))),
                F.when(f["slang"] > 0.3, F.concat(F.lit("High slang ratio: "), percent(f["slang"])))
                .when(f["slang"] > 0.15, F.concat(F.lit("Moderate slang ratio: "), percent(f["slang"]))),
                F.when(f["caps"] > 0.3, F.concat(F.lit("Excessive ALL CAPS: "), percent(f["caps"]), F.lit(" of words"))),
            )
            return finding(
                F.greatest(F.lit(0), 100 - penalty),
                F.concat(
                    F.lit("Analyzed "), f["n"].cast("string"), F.lit(" words. Slang ratio: "), percent(f["slang"]),
                    F.lit(", CAPS ratio: "), percent(f["caps"]), F.lit(", Emojis: "),
                    F.regexp_count(text, F.lit(rules.EMOJI_PATTERN)).cast("string"), F.lit("."),
                    F.when(notes != "", F.concat(F.lit(" "), notes)).otherwise(""),
                ),
            )

        return F.when(n == 0, finding(F.lit(100.0), F.lit("No text to analyze"))).otherwise(bind(facts, scored))

    return metric("social_media", "Language Consistency", bind(latin_words(text), judged))


def offensive_rate(text: Column, low: Column | None = None) -> Column:
    text = F.coalesce(text, F.lit(""))
    names = list(rules.OFFENSIVE_PATTERNS)

    def judged(low: Column) -> Column:
        counts = F.array(*[total(hits(low, p) for p in rules.OFFENSIVE_PATTERNS[n]) for n in names])
        facts = F.struct(counts.alias("counts"), F.greatest(token_count(text), F.lit(1)).alias("words"))

        def scored(f: Column) -> Column:
            n = F.aggregate(f["counts"], F.lit(0), lambda acc, c: acc + c)
            where = F.array_join(
                F.array_compact(F.array(*[F.when(F.get(f["counts"], F.lit(i)) > 0, F.lit(c)) for i, c in enumerate(names)])), ", "
            )
            ratio = n / f["words"]
            say = lambda level, unit: F.concat(
                F.lit(f"{level} concerns: "), n.cast("string"), F.lit(f" flagged{unit} in "), where)
            return (
                F.when(n == 0, finding(F.lit(100.0), F.lit("No offensive content detected.")))
                .when(ratio < 0.02, finding(F.lit(80.0), say("Minor", " term(s)")))
                .when(ratio < 0.05, finding(F.lit(50.0), say("Moderate", "")))
                .otherwise(finding(F.greatest(F.lit(10), 100 - n * 20), say("Significant", "")))
            )

        return bind(facts, scored)

    return metric("social_media", "Offensive Rate", bind(F.lower(text) if low is None else low, judged))


def spam_detection(text: Column, low: Column | None = None) -> Column:
    text = F.coalesce(text, F.lit(""))

    def sentence_share(low: Column) -> Column:
        return bind(
            stripped_parts(low, r"[.!?\n]"),
            lambda s: F.when(F.size(s) > 0, F.size(F.array_distinct(s)) / F.size(s)),
        )

    def judged(low: Column) -> Column:
        facts = F.struct(
            F.greatest(token_count(text), F.lit(1)).alias("words"),
            hits(text, r"https?://\S+").alias("urls"),
            hits(text, r"#\w+").alias("tags"),
            total(hits(low, p) for p in rules.PROMO_PATTERNS).alias("promo"),
            sentence_share(low).alias("unique"),
            (F.regexp_count(text, F.lit(r"\p{Lu}")) / F.greatest(F.length(text), F.lit(1))).alias("caps"),
        )

        def scored(f: Column) -> Column:
            url_ratio = f["urls"] / f["words"]
            repetitive = F.coalesce(f["unique"] < 0.5, F.lit(False))
            penalty = (
                step_penalty(url_ratio, (0.1, 30), (0.05, 15))
                + step_penalty(f["tags"], (10, 25), (5, 10))
                + step_penalty(f["promo"], (2, 30), (0, 10))
                + flag(repetitive) * 20
                + flag(f["caps"] > 0.5) * 15
            )
            links = F.concat(f["urls"].cast("string"), F.lit(" links"))
            notes = F.concat_ws(
                "; ",
                F.when(url_ratio > 0.1, F.concat(F.lit("High URL density: "), links))
                .when(url_ratio > 0.05, F.concat(F.lit("Moderate URL density: "), links)),
                F.when(f["tags"] > 10, F.concat(F.lit("Excessive hashtags: "), f["tags"].cast("string"))),
                F.when(f["promo"] >= 3, F.concat(F.lit("Promotional language: "), f["promo"].cast("string"), F.lit(" indicators"))),
                F.when(repetitive, F.concat(F.lit("Repetitive content: "), percent(f["unique"]), F.lit(" unique sentences"))),
                F.when(f["caps"] > 0.5, F.concat(F.lit("Excessive capitals: "), percent(f["caps"]))),
            )
            return bind(
                F.greatest(F.lit(0), 100 - penalty),
                lambda score: finding(
                    score,
                    F.when(notes == "", "No spam indicators detected.").otherwise(
                        F.concat(F.lit("Spam score: "), (100 - score).cast("string"), F.lit(". "), notes)
                    ),
                ),
            )

        return bind(facts, scored)

    return metric("social_media", "Spam Detection", bind(F.lower(text) if low is None else low, judged))


def metrics(text: Column, lang_share: Column | None = None, low: Column | None = None) -> Column:
    """All three; ``low`` may hold the lower-cased text when it is already known."""
    return F.array(language_consistency(text, lang_share, low), offensive_rate(text, low), spam_detection(text, low))
