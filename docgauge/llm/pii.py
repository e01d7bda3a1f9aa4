"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds to them.

The patterns give the base spans. The field looks at the stretches of a text around
digits and at signs: every segment of tokens there is a candidate of each kind, scored
as a whole (its shape, digit count, check digit, parts, neighbours), and a dynamic
program over bounded segments picks boundaries and kinds together. It finds what the
patterns lose, such as a card number in a longer run of digits or a phone number
without its prefix. Tokens far from digits and at signs cannot be part of an entity, so
leaving them out of the program does not change its result.
"""

import functools
import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.common import back, by_position

KINDS = ("email", "ip", "card", "phone")
#: Tokens of an entity at most.
LONGEST = 16

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_ANCHOR = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, by kind as listed and start."""
    out = []
    at, before = text.find("@"), 0
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        start = at
        while domain and start > before and text[start - 1] in _LOCAL:
            start -= 1
        if domain and start < at:
            out.append(("email", start, domain.end()))
            before = domain.end()
            at = text.find("@", before)
        else:
            at = text.find("@", at + 1)
    if _DIGIT.search(text) is None:
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = digits_of(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return out


# ---------------------------------------------------------------- the field

def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text that hold every token an entity can have: those near digits and at signs."""
    out: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        at = m.start()
        if out and at < out[-1][1]:
            continue
        low, high = _reach(text, at)
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def _reach(text: str, at: int) -> tuple[int, int]:
    """Bounds of the run of entity characters around a place, with a word of context on each side."""
    low = high = at
    while low > 0 and (text[low - 1] in _LOCAL or text[low - 1] in "@+()" or text[low - 1] == " " and low > 1 and (text[low - 2] in "()-0123456789")):
        low -= 1
    n = len(text)
    while high < n and (text[high] in _LOCAL or text[high] in "@+()" or text[high] == " " and high + 1 < n and text[high + 1] in "()0123456789-"):
        high += 1
    while low > 0 and text[low - 1].isspace():
        low -= 1
    for _ in range(24):
        if low == 0 or text[low - 1].isspace():
            break
        low -= 1
    return low, high


class Stretch:
    """Tokens of a stretch and its candidate segments with their features."""

    def __init__(self, text: str, low: int, high: int):
        self.tokens = [(low + m.start(), low + m.end()) for m in _TOKEN.finditer(text[low:high])]
        self.text = text
        held = [text[a:b] for a, b in self.tokens]
        anchor = np.cumsum([0] + [bool(_ANCHOR.search(w)) for w in held])
        # letters belong to an entity only beside an at sign
        letters, signs = (np.cumsum([0] + [test(w) for w in held]) for test in (str.isalpha, "@".__eq__))
        self.segments, self.features = [], []
        for i, first in enumerate(held):
            if not (first[0].isalnum() or first in "+("):
                continue
            for j in range(i + 1, min(len(held), i + LONGEST) + 1):
                last = held[j - 1]
                if any(c.isspace() and c != " " for c in last):
                    break
                if last[-1].isalnum() and anchor[j] > anchor[i] and (letters[j] == letters[i] or signs[j] - signs[i] == 1):
                    self.segments.append((i, j))
                    self.features.append(self._features(held, i, j))

    def _features(self, held, i, j) -> list[str]:
        words = held[i:j]
        text = "".join(words)
        digits = digits_of(text)
        shape = "".join(f"{len(w)}" if w[0].isdigit() else "a" if w.isalpha() else w for w in words)
        before, after = (held[i - 1] if i else " "), (held[j] if j < len(held) else " ")
        letters = any(w.isalpha() for w in words)
        groups = sum(w[0].isdigit() for w in words)
        out = ["bias", f"digits {len(digits)}", f"letters {letters}", f"groups {groups}", f"at {text.count('@')}"]
        out.append("before " + ("digit" if before[-1].isdigit() else "letter" if before.isalpha() else "sign" if not before.isspace() else "gap"))
        out.append("after " + ("digit" if after[0].isdigit() else "letter" if after.isalpha() else "sign" if after not in " .,;:!?)\n\t" else "gap"))
        if not letters:
            out.append("shape " + shape if len(shape) < 40 else "shape long")
            out.append("marks " + "".join(sorted({w for w in words if not w[0].isdigit()})))
            if 13 <= len(digits) <= 19:
                out.append(f"check {luhn(digits)} {text[0].isdigit()}")
            if groups == 4 and text.count(".") == 3 and len(words) == 7:
                out.append(f"octets {all(len(w) < 4 and int(w) < 256 for w in words[::2])}")
        elif text.count("@") == 1:
            local, _, domain = text.partition("@")
            out.append(f"mail {bool(local) and '.' in domain and ' ' not in text and not set('()') & set(text)}")
            beyond = after if after != "." else held[j + 1] if j + 1 < len(held) else " "
            out.append(f"wider {before[-1] in _LOCAL} {beyond[0].isalnum()}")
        return out


class Field:
    """Weights of (feature, kind) pairs; outside an entity each token scores zero."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    def scores(self, stretch: Stretch) -> np.ndarray:
        nothing = np.zeros(len(KINDS))
        return np.array([sum((self.weights.get(f, nothing) for f in features), nothing) for features in stretch.features]).reshape(-1, len(KINDS))

    def best(self, text: str, low: int, high: int) -> list[tuple[str, int, int]]:
        """Segments of the best labelling of a stretch."""
        stretch = Stretch(text, low, high)
        if not stretch.segments:
            return []
        scores = self.scores(stretch)
        ending: dict[int, list[int]] = {}
        for s, (_, j) in enumerate(stretch.segments):
            ending.setdefault(j, []).append(s)
        n = len(stretch.tokens)
        value, choice = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for s in ending.get(j, ()):
                kind = int(scores[s].argmax())
                total = value[stretch.segments[s][0]] + scores[s, kind]
                if total > value[j]:
                    value[j], choice[j] = total, (s, kind)
        out, j = [], n
        while j:
            if choice[j] is None:
                j -= 1
                continue
            s, kind = choice[j]
            i, end = stretch.segments[s]
            out.append((KINDS[kind], stretch.tokens[i][0], stretch.tokens[end - 1][1]))
            j = i
        return out[::-1]


def examples(seed: int = 7, count: int = 260) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences of made-up words with entities and look-alikes, and the spans of the entities."""
    rng = random.Random(seed)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "re", "in", "st", "le", "ou", "de", "au", "ch"]) for _ in range(rng.randint(1, 4)))

    def checked(n, good=True):
        body = number(n - 1)
        last = next(d for d in "0123456789" if luhn(body + d))
        return body + (last if good else str((int(last) + rng.randint(1, 9)) % 10))

    def grouped(digits, mark):
        return mark.join(digits[k:k + 4] for k in range(0, len(digits), 4))

    def entity():
        kind = rng.choice(KINDS)
        if kind == "email":
            return kind, rng.choice([word() + "." + word(), word() + number(2), word()]) + "@" + word() + rng.choice([".", number(1) + ".example."]) + rng.choice(["com", "org", "net"])
        if kind == "ip":
            return kind, ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == "card":
            digits = checked(rng.choice([13, 14, 15, 16, 16, 16, 16, 19]))
            return kind, rng.choice([digits, digits, grouped(digits, " "), grouped(digits, "-")])
        area, a, b = number(3), number(3), number(4)
        return kind, rng.choice([f"+{number(1)} ({area}) {a}-{b}", f"+{number(2)} {area} {a} {b}", f"+{number(2)}{area}{a}{b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"+{number(1)}-{area}-{a}-{b}"])

    def other():
        return rng.choice([
            lambda: checked(16, False), lambda: checked(15, False), lambda: number(rng.randint(1, 12)), lambda: f"20{number(2)}-0{rng.randint(1, 9)}-1{number(1)}",
            lambda: f"{number(1)}.{number(1)}.{number(2)}", lambda: f"{number(2)}:{number(2)}", lambda: f"{number(3)}.{number(2)}", lambda: f"{number(3)},{number(3)}",
            lambda: number(2) + "abcdef"[rng.randint(0, 5)] + number(6) + "c" + number(15) + "e" + number(3), lambda: f"{number(2)} {number(3)}", lambda: f"{number(5)}-{number(4)}",
            lambda: f"{number(3)}.{number(3)}.{number(3)}.{300 + rng.randint(0, 600)}", lambda: f"@{word()}", lambda: f"{word()}@ {word()}",
            lambda: f"(20{number(2)})", lambda: grouped(checked(16, False), " "), lambda: f"{number(1)}-{number(2)}", lambda: f"#{number(5)}",
        ])()

    out = []
    for _ in range(count):
        text, spans = word().capitalize(), []
        for _ in range(2):
            text += " " + word() + " "
            roll = rng.random()
            if roll < 0.5:
                kind, value = entity()
                if kind == "card" and rng.random() < 0.25:
                    text += number(rng.randint(1, 3)) + " "  # a number beside a card
                spans.append((kind, len(text), len(text) + len(value)))
                text += value
            elif roll < 0.95:
                text += other()
            text += rng.choice([" ", " ", ". ", ", "]) + word()
        out.append((text + ".", spans))
    return out


@functools.cache
def trained(epochs: int = 6, rate: float = 0.15, penalty: float = 0.002, seed: int = 7) -> Field:
    """A field fitted to the examples by stochastic gradient ascent on the likelihood of their labellings."""
    weights: dict[str, np.ndarray] = {}
    cases = []
    for text, spans in examples(seed):
        for low, high in stretches(text):
            stretch = Stretch(text, low, high)
            truth = {(a, b): KINDS.index(kind) for kind, a, b in spans}
            places = [(stretch.tokens[i][0], stretch.tokens[j - 1][1]) for i, j in stretch.segments]
            cases.append((stretch, [truth.get(p, -1) for p in places]))
    rng = random.Random(seed)
    field = Field(weights)
    for epoch in range(epochs):
        rng.shuffle(cases)
        for stretch, truth in cases:
            if not stretch.segments:
                continue
            expected = _expectations(stretch, field.scores(stretch))
            for s, features in enumerate(stretch.features):
                push = -expected[s]
                if truth[s] >= 0:
                    push[truth[s]] += 1
                if np.abs(push).max() < 1e-4:
                    continue
                push *= rate / (1 + 0.3 * epoch)
                for f in features:
                    old = weights.get(f)
                    weights[f] = push if old is None else old * (1 - rate * penalty) + push
    return field


def _expectations(stretch: Stretch, scores: np.ndarray) -> np.ndarray:
    """Probability of each (segment, kind) under the field, by the forward and backward sums."""
    n = len(stretch.tokens)
    total = np.logaddexp.reduce(scores, axis=1)
    ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
    ending, starting = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for s, (i, j) in enumerate(stretch.segments):
        ending[j].append((total[s], i))
        starting[i].append((total[s], j))
    for j in range(1, n + 1):
        ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(x + ahead[i] for x, i in ending[j])])
    for i in range(n - 1, -1, -1):
        behind[i] = np.logaddexp.reduce([behind[i + 1], *(x + behind[j] for x, j in starting[i])])
    outside = np.array([ahead[i] + behind[j] for i, j in stretch.segments]) - ahead[n]
    return np.exp(scores + outside[:, None])


def all_spans(text: str, base: list[tuple[str, int, int]], field: Field) -> list[tuple[str, int, int]]:
    """The base spans, and the field's spans that overlap none of them, by kind as listed and start."""
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for low, high in stretches(text):
        for span in field.best(text, low, high):
            if not any(a < span[2] and span[1] < b for a, b in taken):
                added.append(span)
    return sorted({*base, *added}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the patterns' spans, and all spans.

    A null text counts as empty and has no spans. Repeated rows stay. One pass, no shuffle.
    """
    df, at = by_position(docs)
    df = df.select(F.col(at[id_col]).alias("doc_id"), F.coalesce(F.col(at[text_col]).cast("string"), F.lit("")).alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    field = trained()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py()
                base = base_spans(text)
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_spans(text, base, field))))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return df.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans) -> str:
    """The text with each stretch of overlapping spans replaced by the kind of its first span."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with personal data in the text replaced, and the length column (if there) set anew; null texts stay null."""
    df, at = by_position(docs)
    field = trained()

    @F.pandas_udf("string")
    def cleaned(texts):
        return texts.map(lambda t: None if t is None else masked(t, all_spans(t, base_spans(t), field)))

    df = df.withColumn(at[text_col], cleaned(F.col(at[text_col])))
    if length_col in at:
        kind = df.schema[at[length_col]].dataType
        df = df.withColumn(at[length_col], F.length(at[text_col]).cast(kind))
    return back(df, docs.columns)
