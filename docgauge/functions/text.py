"""Text helpers: whitespace, tokens, markup stripping, mail bodies.

All are column expressions evaluated in the JVM, one row at a time, with no
shuffle; a document is one row.
"""

from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgauge import rules


def rx(pattern: str, flags: str = "") -> str:
    """Java pattern with Unicode classes and ``\\n`` as the only line end."""
    return f"(?Ud{flags}){pattern}"


def any_of(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def has(text: Column, pattern: str, flags: str = "") -> Column:
    return text.rlike(rx(pattern, flags))


def hits(text: Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_count(text, F.lit(rx(pattern, flags)))


def bind(value: Column, fn) -> Column:
    """Evaluate ``value`` once per row and hand it to ``fn`` (a let-binding)."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def in_pieces(value: Column) -> Column:
    """The same value, but Spark compiles the projection around it in small methods.

    Whole-stage code puts a projection into one method, and a JVM never compiles one above
    8,000 bytes: wide projections would run as plain byte code.
    """
    return bind(value, lambda v: v)


def sql_text(value) -> str:
    """Value as a SQL literal; lists become arrays, tuples become structs v0, v1, ..."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, list):
        return f"array({', '.join(map(sql_text, value))})"
    if isinstance(value, tuple):
        return "named_struct(" + ", ".join(f"'v{i}', {sql_text(v)}" for i, v in enumerate(value)) + ")"
    return f"{value}D" if isinstance(value, float) else str(value)


def literal(value) -> Column:
    """Fixed rule rows as one constant column; rules stay data inside the plan."""
    return F.expr(sql_text(value))


def literal_map(table: dict) -> Column:
    return F.expr(f"map({', '.join(sql_text(x) for kv in table.items() for x in kv)})")


def total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rx(r"^\s+|\s+$"), "")


def non_blank(text: Column) -> Column:
    return has(text, r"\S")


def title(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def title_text(name: str) -> str:
    return name.replace("_", " ").title()


def percent(ratio: Column, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f%%", ratio * 100)


def normalize_text(raw: Column) -> Column:
    """Unix line ends, at most one blank line, single spaces, stripped lines.

    Blank lines are collapsed before lines are stripped, so lines that hold
    only spaces can still leave longer runs of line feeds.
    """
    lf = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\r\n?", "\n")
    collapsed = F.regexp_replace(lf, r"\n{3,}", "\n\n")
    spaced = F.regexp_replace(collapsed, rx(r"[^\S\n]+"), " ")
    lines = F.regexp_replace(spaced, rx(r"(?m)^ | $"), "")
    return strip(lines)


def lower_text(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def tokens(text: Column) -> Column:
    """Whitespace tokens."""
    return F.filter(F.split(text, rx(r"\s+")), lambda t: t != "")


def token_count(text: Column) -> Column:
    return hits(text, r"\S+")


def latin_words(text: Column, at_least: int = 1) -> Column:
    """ASCII-letter words that stand alone between non-word characters."""
    return F.regexp_extract_all(text, F.lit(rx(rf"\b[a-zA-Z]{{{at_least},}}\b")), F.lit(0))


def stripped_parts(text: Column, separator: str) -> Column:
    """Split, strip each part and drop the empty ones."""
    return F.filter(F.transform(F.split(text, separator), strip), lambda p: p != "")


def content_lines(text: Column) -> Column:
    return stripped_parts(text, "\n")


def delimiter_of(header: Column) -> Column:
    """Comma unless tab, pipe or semicolon is more frequent than the choice so far."""

    def count(c: str) -> Column:
        return F.length(header) - F.length(F.replace(header, F.lit(c), F.lit("")))

    return bind(
        F.struct(count(",").alias("comma"), count("\t").alias("tab"),
                 count("|").alias("pipe"), count(";").alias("semi")),
        lambda n: F.when((n.semi > n.comma) & (n.semi > n.tab) & (n.semi > n.pipe), ";")
        .when((n.pipe > n.comma) & (n.pipe > n.tab), "|")
        .when(n.tab > n.comma, "\t")
        .otherwise(","),
    )


def split_literal(line: Column, delimiter: Column) -> Column:
    """Split on a literal one-character delimiter, keeping empty cells."""
    return F.split(line, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E")))


_MARKS = "".join("\\" + c for c in rules.SYLLABLE_STRIP)


def syllables(word: Column) -> Column:
    """Vowel groups of a word, silent final ``e`` removed, at least one."""
    return text_syllables(F.regexp_replace(word, r"\s", ""))


def text_syllables(text: Column, low: Column | None = None, words: Column | None = None) -> Column:
    """Syllables of all whitespace tokens of a text, counted over the whole text.

    ``words`` may hold the number of tokens, which lower case leaves as it is.

    A token has as many syllables as vowel groups, one less for a final ``e``
    after another group, and at least one. So the sum is: vowel groups + tokens
    without a vowel (tokens of marks only included) - final ``e`` of tokens
    with several groups.
    """
    marks = rf"[{_MARKS}]*"
    low = F.lower(text) if low is None else low
    bare = F.regexp_replace(low, rx(rf"(?:^{marks}|{marks}\s+){marks}|{marks}$"), " ")
    silent_e = r"[aeiouy]++[^aeiouy\s]++(?:[aeiouy]++[^aeiouy\s]++)*+[aeiouy]++(?<=e)(?!\S)"
    with_vowel = r"(?<!\S)[^aeiouy\s]*+[aeiouy]\S*+"
    return bind(
        bare,
        lambda t: hits(t, "[aeiouy]+") + F.greatest(token_count(low) if words is None else words, flag(F.length(low) == 0))
        - hits(t, with_vowel) - hits(t, silent_e),
    )


# names of the HTML 4 entities, and the characters that numbers 128 to 159 stand for
_NAMED = {name: chr(point) for name, point in name2codepoint.items()} | {"apos": "'"}
_WINDOWS = {str(n): bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _character(number: Column) -> Column:
    """The character of a code point given in decimal; U+FFFD where there is none."""
    n = number.try_cast("int")
    bad = n.isNull() | (n < 1) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    point = F.when(bad, 0xFFFD).otherwise(n)
    known = F.try_element_at(literal_map(_WINDOWS), point.cast("string"))
    return F.coalesce(known, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))


def unescape(text: Column) -> Column:
    """Named and numeric character references replaced, each once; unknown names stay."""

    def part(p: Column) -> Column:
        body = F.regexp_extract(p, r"\A&(#?\w+);", 1)
        rest = F.substr(p, F.length(body) + 3)
        hexadecimal = F.conv(F.regexp_extract(body, r"\A#[xX]([0-9a-fA-F]{1,8})\z", 1), 16, 10)
        character = (
            F.when(body.rlike(r"\A#\d+\z"), _character(F.substr(body, F.lit(2))))
            .when(body.rlike(r"\A#[xX][0-9a-fA-F]+\z"), _character(hexadecimal))
            .otherwise(F.try_element_at(literal_map(_NAMED), body))
        )
        return F.when(body == "", p).otherwise(F.coalesce(F.concat(character, rest), p))

    split = F.array_join(F.transform(F.split(text, r"(?=&#?\w+;)"), part), "")
    return F.when(F.contains(text, F.lit("&")), split).otherwise(text)


def html_to_text(html: Column, drop_code: bool = True) -> Column:
    """Visible text of a page, one stripped text node per line.

    ``drop_code=False`` keeps the contents of script and style elements, which
    a plain text-node walk also returns.
    """
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", "\n")
    if drop_code:
        text = F.regexp_replace(text, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "\n")
    nodes = F.regexp_replace(text, r"(?s)<[!?/]?[a-zA-Z][^>]*>", "\n\u0001\n")
    # nodes are split at tags only; a node keeps its inner line feeds
    parts = F.transform(F.split(nodes, "\n\u0001\n"), lambda p: strip(unescape(p)))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n")


def xml_to_text(xml: Column) -> Column:
    """Text and tail of every element in document order; CDATA kept, comments
    and processing instructions dropped."""
    text = F.regexp_replace(F.coalesce(xml, F.lit("")), r"(?s)<!--.*?-->|<\?.*?\?>", "")
    text = F.regexp_replace(text, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    return html_to_text(text, drop_code=False)


def mail_header(raw: Column, name: str) -> Column:
    """Unfolded value of one header, or empty."""
    head = F.regexp_extract(raw, r"(?s)\A(.*?)(?:\r?\n\r?\n|\z)", 1)
    value = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*((?:.*(?:\r?\n[ \t].*)*))", 1)
    return strip(F.regexp_replace(value, r"\r?\n[ \t]+", " "))


def _charset_text(data: Column, charset: Column) -> Column:
    latin = F.lower(charset).isin("iso-8859-1", "latin1", "latin-1", "windows-1252", "cp1252")
    return F.when(latin, F.decode(data, "ISO-8859-1")).otherwise(F.make_valid_utf8(data.cast("string")))


def _from_base64(text: Column, charset: Column) -> Column:
    """Decoded text; the text as it is where it is no base64."""
    data = F.try_to_binary(F.regexp_replace(text, r"\s+", ""), F.lit("base64"))
    return F.coalesce(_charset_text(data, charset), text)


def _from_quoted(text: Column, charset: Column) -> Column:
    """Quoted-printable text decoded, byte by byte between the plain stretches."""
    joined = F.regexp_replace(text, r"=[ \t]*\r?\n", "")
    runs = F.regexp_extract_all(joined, F.lit(r"(?:=[0-9A-Fa-f]{2})++|[^=]++|="), F.lit(0))
    data = lambda r: F.unhex(F.replace(r, F.lit("="), F.lit("")))
    return F.array_join(F.transform(
        runs, lambda r: F.when(r.rlike(r"\A(?:=[0-9A-Fa-f]{2})+\z"), _charset_text(data(r), charset)).otherwise(r)), "")


_ENCODED = r"=\?([^?\s]+)\?([bBqQ])\?([^?\s]*)\?="


def header_text(value: Column) -> Column:
    """A header value with its encoded words decoded; space between two of them is dropped."""

    def word(p: Column) -> Column:
        part = lambda k: F.regexp_extract(p, rf"\A{_ENCODED}", k)
        rest = F.regexp_replace(p, rf"\A{_ENCODED}", "")
        decoded = F.when(F.lower(part(2)) == "b", _from_base64(part(3), part(1))).otherwise(
            _from_quoted(F.replace(part(3), F.lit("_"), F.lit(" ")), part(1)))
        return F.when(part(1) == "", p).otherwise(F.concat(decoded, rest))

    joined = F.regexp_replace(value, r"(?<=\?=)\s+(?==\?[^?\s]+\?[bBqQ]\?)", "")
    words = F.array_join(F.transform(F.split(joined, rf"(?={_ENCODED})"), word), "")
    return F.when(F.contains(value, F.lit("=?")), words).otherwise(value)


def _body_of(entity: Column) -> Column:
    """Decoded text below the headers of a message or of one of its parts."""
    body = F.regexp_extract(entity, r"(?s)\A.*?\r?\n\r?\n(.*)\z", 1)
    encoding = F.lower(mail_header(entity, "Content-Transfer-Encoding"))
    charset = F.regexp_extract(mail_header(entity, "Content-Type"), r"(?i)charset=\"?([^\";\s]+)", 1)
    return F.when(encoding == "base64", _from_base64(body, charset)).when(
        encoding == "quoted-printable", _from_quoted(body, charset)).otherwise(body)


def mail_to_text(raw: Column) -> Column:
    """Subject line, sender line and the plain (else HTML) body of a message.

    Parts inside parts are found at any depth: the text is cut at the boundaries of
    all of them, and a part that only holds others has no text of its own.
    """
    raw = F.coalesce(raw, F.lit(""))
    multipart = has(mail_header(raw, "Content-Type"), r"(?i)^multipart/")
    named = F.regexp_extract_all(raw, F.lit(r'(?i)\bboundary="?([^";\s]+)"?'), F.lit(1))
    either = F.array_join(F.transform(F.array_distinct(named), lambda n: F.concat(F.lit("\\Q"), n, F.lit("\\E"))), "|")
    # a boundary stands at the start of a line
    parts = F.split(raw, F.concat(F.lit("(?:\\A|\\r?\\n)--(?:"), either, F.lit(")(?:--)?[ \\t]*(?:\\r?\\n|\\z)")))

    def part_of(kind: str) -> Column:
        chosen = F.filter(
            F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
            lambda p: p.rlike(rf"(?is)\A(?:[^\n]+\n)*?Content-Type:[ \t]*{kind}")
            & ~p.rlike(r"(?is)\A(?:[^\n]+\n)*?Content-Disposition:[ \t]*attachment"),
        )
        return F.get(F.transform(chosen, _body_of), F.lit(0))

    whole_is_html = has(mail_header(raw, "Content-Type"), r"(?i)^text/html")
    content = (
        F.when(~multipart | (either == ""), F.when(whole_is_html, html_to_text(_body_of(raw), drop_code=False)).otherwise(_body_of(raw)))
        .otherwise(F.coalesce(part_of("text/plain"), html_to_text(part_of("text/html"), drop_code=False)))
    )
    subject, sender = header_text(mail_header(raw, "Subject")), header_text(mail_header(raw, "From"))
    return F.concat_ws(
        "\n",
        F.when(subject != "", F.concat(F.lit("Subject: "), subject)),
        F.when(sender != "", F.concat(F.lit("From: "), sender)),
        content,
    )


def extension(path: Column) -> Column:
    """Lower-case last suffix of the file name, with its dot, or empty."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def join_cells(cells: Column) -> Column:
    """Non-blank cells of a table row joined by a bar."""
    return F.array_join(F.filter(F.transform(cells, strip), lambda c: c != ""), " | ")
