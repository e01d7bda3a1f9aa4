"""Metrics of general prose: structure, readability, sections, repetition."""

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgauge import rules
from docgauge.functions.scoring import finding, metric
from docgauge.functions.text import (
    bind, flag, has, hits, latin_words, lower_text, non_blank, percent, rx, text_syllables, token_count,
)


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _parts(text: Column, separator: str) -> Column:
    """Number of parts between separators that are not blank."""
    return F.size(F.filter(F.split(text, rx(separator)), non_blank))


def _has_any(low: Column, patterns: list[str]) -> Column:
    """Any pattern is found. Each holds a plain word, which a native search rules out far faster than a pattern."""
    word = lambda p: max(re.findall("[a-z]+", re.sub(r"\\.", " ", p)), key=len)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(word(p))) & has(low, p) for p in patterns])


def structure_quality(text: Column, words: Column | None = None) -> Column:
    """``words`` may hold the number of tokens when it is already known."""
    text = _text(text)
    facts = F.struct(
        hits(text, rules.HEADING_PATTERN, "m").alias("headings"),
        _parts(text, r"\n\s*\n").alias("paragraphs"),
        hits(text, rules.LIST_PATTERN, "m").alias("items"),
        hits(text, rules.KEY_VALUE_PATTERN, "m").alias("pairs"),
        (token_count(text) if words is None else words).alias("words"),
    )

    def scored(f: Column) -> Column:
        penalty = flag(f["headings"] == 0) * 15 + flag(f["paragraphs"] <= 1) * 10 + flag(f["words"] < 20) * 25
        say = lambda n, what: F.concat(n.cast("string"), F.lit(what))
        features = F.concat_ws(
            ", ",
            F.when(f["headings"] > 0, say(f["headings"], " heading(s)")),
            F.when(f["paragraphs"] > 1, say(f["paragraphs"], " paragraph(s)")),
            F.when(f["items"] > 0, say(f["items"], " list item(s)")),
            F.when(f["pairs"] > 3, say(f["pairs"], " key-value pair(s)")),
        )
        words = f["words"].cast("string")
        return finding(
            100 - penalty,
            F.when(features == "", F.concat(
                F.lit("Minimal structure detected. "), words, F.lit(" words, no clear sections/headings.")
            )).otherwise(F.concat(
                F.lit("Structural elements found: "), features, F.lit(". Total "), words, F.lit(" words."))),
        )

    return metric("general", "Structure Quality", bind(facts, scored))


def readability(text: Column, low: Column | None = None, words: Column | None = None) -> Column:
    """Flesch reading ease from whitespace words, sentence ends and vowel groups."""
    text = _text(text)
    facts = F.struct(
        (token_count(text) if words is None else words).alias("words"),
        F.greatest(_parts(text, r"[.!?]+\s+"), F.lit(1)).alias("sentences"),
        text_syllables(text, low, words).alias("syllables"),
    )

    def scored(f: Column) -> Column:
        length, weight = f["words"] / f["sentences"], f["syllables"] / F.nullif(f["words"], F.lit(0))
        return F.when(
            f["words"] < 10, finding(F.lit(50.0), F.lit("Insufficient text for readability analysis"))
        ).otherwise(bind(
            F.greatest(F.lit(0.0), F.least(F.lit(100.0), 206.835 - 1.015 * length - 84.6 * weight)),
            lambda s: finding(s, F.format_string(
                "Flesch score: %.0f (%s). Avg sentence: %.0f words, avg syllables: %.1f.",
                s,
                F.when(s >= 60, "Easy to read").when(s >= 30, "Moderately readable").otherwise("Difficult to read"),
                length, weight,
            )),
        ))

    return metric("general", "Readability Score", bind(facts, scored))


def section_completeness(text: Column, low: Column | None = None) -> Column:
    text = _text(text)

    def judged(low: Column) -> Column:
        found = F.array_compact(F.array(
            F.when(_has_any(low, rules.INTRO_PATTERNS), F.lit("Introduction/Overview")),
            F.when(hits(text, rules.BODY_PATTERN) >= 2, F.lit("Body sections")),
            F.when(_has_any(low, rules.CONCLUSION_PATTERNS), F.lit("Conclusion/Closing")),
        ))
        return bind(found, lambda s: F.when(
            F.size(s) == 0, finding(F.lit(50.0), F.lit("No recognizable document sections detected."))
        ).otherwise(finding(
            F.size(s) * 33.3,
            F.concat(F.lit("Found "), F.size(s).cast("string"), F.lit(" section type(s): "), F.array_join(s, ", "), F.lit(".")),
        )))

    return metric("general", "Section Completeness", bind(lower_text(text) if low is None else low, judged))


DENSE = 0.08


def frequent_word(words: Column) -> Column:
    """struct<total, distinct, top, word> of an array of words; top and word only where top / total is over ``DENSE``.

    In sorted order a word that holds a share of the places holds one of every so many places: a
    dozen candidates are left, each counted by native array functions instead of a fold over all words.
    Of equally frequent words the first seen is named.
    """
    def found(b: Column) -> Column:
        step = F.greatest(F.lit(1), F.floor(b["total"] * DENSE).cast("int"))
        places = F.sequence(F.lit(0), b["total"] - 1, step)
        candidates = F.array_distinct(F.transform(places, lambda i: F.get(b["sorted"], i)))
        counted = F.transform(candidates, lambda w: F.struct(
            (b["total"] - F.size(F.array_remove(b["sorted"], w))).alias("top"),
            (-F.array_position(b["words"], w)).alias("place"), w.alias("word")))
        return bind(F.array_max(counted), lambda m: F.struct(
            b["total"].alias("total"), b["distinct"].alias("distinct"), m["top"].alias("top"), m["word"].alias("word")))

    return bind(F.struct(
        words.alias("words"), F.sort_array(words).alias("sorted"), F.size(words).alias("total"),
        F.size(F.array_distinct(words)).alias("distinct")), found)


def word_profile(words: Column) -> Column:
    """struct<total, distinct, top, word> of an array of words.

    Sorting brings equal words together, so one pass over the runs counts them
    without leaving the row. Of equally frequent words the first seen is named.
    """
    start = F.struct(
        F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("first"), F.lit(0).alias("distinct"), F.lit(0).alias("top"),
        F.lit(0).alias("top_first"), F.lit("").alias("top_word"),
    )

    def step(acc: Column, x: Column) -> Column:
        w, same = x["w"], acc["word"] == x["w"]
        first = F.when(same, acc["first"]).otherwise(x["i"])
        better = lambda run: (run > acc["top"]) | ((run == acc["top"]) & (first < acc["top_first"]))
        return bind(
            F.when(same, acc["run"] + 1).otherwise(1),
            lambda run: F.struct(
                w.alias("word"), run.alias("run"), first.alias("first"),
                (acc["distinct"] + F.when(same, 0).otherwise(1)).alias("distinct"),
                F.greatest(acc["top"], run).alias("top"),
                F.when(better(run), first).otherwise(acc["top_first"]).alias("top_first"),
                F.when(better(run), w).otherwise(acc["top_word"]).alias("top_word"),
            ),
        )

    return bind(
        F.aggregate(F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), start, step),
        lambda a: F.struct(
            F.size(words).alias("total"), a["distinct"].alias("distinct"), a["top"].alias("top"), a["top_word"].alias("word")
        ),
    )


def keyword_density(text: Column, low: Column | None = None) -> Column:
    def judged(words: Column) -> Column:
        content = F.filter(words, lambda w: ~w.isin(rules.STOP_WORDS))

        def scored(p: Column) -> Column:
            density, variety = p["top"] / p["total"], p["distinct"] / p["total"]
            penalty = F.when(density > 0.15, 30).when(density > DENSE, 15).otherwise(0) + flag(variety < 0.3) * 15
            notes = F.concat_ws(
                "; ",
                F.when(density > DENSE, F.concat(
                    F.lit("'"), p["word"], F.lit("' appears "), p["top"].cast("string"), F.lit(" times ("),
                    percent(density), F.lit(" density)"))),
                F.when(variety < 0.3, F.concat(F.lit("Low vocabulary diversity ("), percent(variety), F.lit(" unique words)"))),
            )
            return finding(
                100 - penalty,
                F.concat(
                    F.format_string("Analyzed %d content words, %d unique. ", p["total"], p["distinct"]),
                    F.when(notes == "", "Good vocabulary diversity.").otherwise(notes),
                ),
            )

        return (
            F.when(F.size(words) < 20, finding(F.lit(100.0), F.lit("Too few words to analyze density")))
            .otherwise(bind(content, lambda c: F.when(
                F.size(c) == 0, finding(F.lit(100.0), F.lit("No significant keywords found"))
            ).otherwise(bind(frequent_word(c), scored))))
        )

    return metric("general", "Keyword Density", bind(latin_words(lower_text(text) if low is None else low, 3), judged))


def metrics(text: Column, low: Column | None = None) -> Column:
    """All four; ``low`` may hold the lower-cased text when it is already known."""
    by_tokens = bind(token_count(_text(text)), lambda n: F.array(structure_quality(text, n), readability(text, low, n)))
    return F.concat(by_tokens, F.array(section_completeness(text, low), keyword_density(text, low)))
