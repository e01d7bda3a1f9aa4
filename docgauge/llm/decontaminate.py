"""Benchmark decontamination by CGK embedding, bit sampling and exact edit distance.

Texts and items are sequences of lower-cased words. The CGK embedding reads a sequence by a
random walk that stays at a word or moves on by a random bit of word and step, and writes the
word of each step: sequences at a small edit distance give walks that fall in step again after
an edit and so differ in few places. Bit sampling looks at two places of the walk; windows of
an item's size and the item are candidates where both words agree in one of the repetitions.
There are so many repetitions that a window at an edited copy is found with the target
recall, whichever words are edited; windows start at every item word around it, which
raises the recall further. Candidates are verified by exact word edit distance.

Windows are walked only where an edited copy can be: d edits leave m - d of an item's m words,
m - 1 - 2d of its pairs and m - 2 - 3d of its triples of neighbours as they were, so stretches
with fewer words, pairs and triples of the items hold none.
"""

import math
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.common import back, by_position, give_back

#: Edits allowed, as a share of the item's words.
EDITS = 0.2
#: Share of edited copies that the repetitions find from the window at their start alone.
TARGET = 0.98
#: A repetition finds a copy of m words with a fifth of them dropped, the worst kind of edits,
#: with a chance of about this number divided by m (measured for 20 to 120 words).
CHANCE = 2.5
#: Items up to so many times as long as another share its walks.
SIZES = 1.15
#: Seed of the walks; windows walked at once; bytes of text that are searched together.
SEED, WINDOWS, GROUP_BYTES = 8, 2048, 4 << 20
#: Bytes of benchmark text that go to the tasks at once; a larger benchmark is done in blocks.
BLOCK_BYTES = 32 << 20
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall((text or "").lower())


def distance_ends(item: list[str], text: list[str]) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of the text, and the first end of such a stretch.

    Bit-parallel columns: one big-integer step for each word of the text.
    """
    m = len(item)
    masks: dict[str, int] = defaultdict(int)
    for k, w in enumerate(item):
        masks[w] |= 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, now, best, end = full, 0, m, m, 0
    for k, w in enumerate(text, 1):
        eq = masks.get(w, 0)
        across = (((eq & plus) + plus) ^ plus) | eq
        up = (minus | ~(across | plus)) & full
        down = plus & across
        now += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        eq |= minus
        plus = (down | ~(eq | up)) & full
        minus = up & eq
        if now < best:
            best, end = now, k
    return best, end


def _unedited(m: int, most: int) -> list[int]:
    """How many single words, pairs and triples of m words any ``most`` edits leave: an edit breaks k runs of k words at most."""
    return [m - size - (size + 1) * most for size in range(3)]


class Walks:
    """The walks of items of about one size, and where their two sampled words lie.

    Windows have the size of the smallest; longer items are walked as far.
    """

    def __init__(self, numbers: list[int], ids: list[np.ndarray], edits: float, hashes: np.ndarray):
        self.numbers, self.hashes = numbers, hashes
        sizes = {(len(x), int(edits * len(x))) for x in ids}
        self.size = size = min(m for m, _ in sizes)
        #: Words within which a passage lies, and what it holds unedited at least.
        self.reach = max(m + most for m, most in sizes)
        self.least = [min(n) for n in zip(*(_unedited(m, most) for m, most in sizes), strict=True)]
        ids = [x[:size] for x in ids]
        chance = min(0.1, CHANCE / size)
        self.times = max(2, math.ceil(math.log(1 - TARGET) / math.log(1 - chance)))
        rng = np.random.default_rng([SEED, size])
        steps = max(2, 2 * size)  # after so many steps a walk is about at the end
        self.turns = rng.integers(0, 1 << 64, (steps, self.times, 1), dtype=np.uint64, endpoint=False) | np.uint64(1)
        if size == 1:
            self.sampled = np.zeros((self.times, 2), np.int64)
        else:
            self.sampled = np.sort(np.array([rng.choice(steps, 2, replace=False) for _ in range(self.times)]), axis=1)
        # repetitions in order of their first place: those that are done lie before the others
        self.sampled = self.sampled[np.argsort(self.sampled[:, 0], kind="stable")]
        #: First sampled words of the items, and then both of them, with the repetition; and the items in this order.
        self.firsts, keys, items = None, [], []
        for item, words in enumerate(ids):
            repetition, _, key = self.sampled_words(words, np.zeros(1, np.int64))
            keys.append(np.stack((repetition, *key)))
            items.append(np.full(len(repetition), item))
        keys, items = np.concatenate(keys, axis=1), np.concatenate(items)
        self.firsts = np.unique(keys[0] << 32 | keys[1])
        keys = np.searchsorted(self.firsts, keys[0] << 32 | keys[1]) << 32 | keys[2]
        order = np.argsort(keys, kind="stable")
        self.keys, self.items = keys[order], items[order]

    def sampled_words(self, ids: np.ndarray, starts: np.ndarray):
        """Repetition, start and both sampled words of the windows that begin at the starts.

        Windows whose word at the first place is none of the items' end there.
        """
        end, last = starts + self.size, len(ids) - 1
        at = np.broadcast_to(starts, (self.times, len(starts))).copy()
        done, left = 0, []
        for step in range(int(self.sampled[-1, 0]) + 1):
            word = np.where(at[done:] < end, ids[np.minimum(at[done:], last)], 0)
            now = int(np.searchsorted(self.sampled[:, 0], step, "right"))
            if now > done:
                first = word[:now - done]
                row, column = np.nonzero(first)
                first = first[row, column]
                row += done
                if self.firsts is not None:
                    known = _among(self.firsts, row << 32 | first)
                    row, column, first = row[known], column[known], first[known]
                left.append((row, column, first))
            at[done:] += ((self.hashes[word] * self.turns[step][done:]) >> np.uint64(63)).astype(np.int64)
            done = now
        row, column, first = (np.concatenate(x) for x in zip(*left, strict=True))
        place, end, second = at[row, column], end[column], np.zeros_like(first)
        begun, wanted = self.sampled[row, 0], self.sampled[row, 1]
        for step in range(int(begun.min(initial=0)), int(wanted.max(initial=-1)) + 1):
            word = np.where(place < end, ids[np.minimum(place, last)], 0)
            second = np.where(wanted == step, word, second)
            turn = ((self.hashes[word] * self.turns[step][row, 0]) >> np.uint64(63)).astype(np.int64)
            place += np.where(step > begun, turn, 0)
        kept = second > 0
        return row[kept], starts[column[kept]], (first[kept], second[kept])

    def candidates(self, ids: np.ndarray, starts: np.ndarray) -> dict[int, set[int]]:
        """For each item (by its place among those of this size) the starts whose windows agree with it somewhere."""
        found: dict[int, set[int]] = defaultdict(set)
        for k in range(0, len(starts), WINDOWS):
            row, start, (first, second) = self.sampled_words(ids, starts[k:k + WINDOWS])
            keys = np.searchsorted(self.firsts, row << 32 | first) << 32 | second
            low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
            for hit in np.flatnonzero(high > low).tolist():
                for item in self.items[low[hit]:high[hit]].tolist():
                    found[item].add(int(start[hit]))
        return found


def _among(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is one of the ordered ones."""
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values if len(ordered) else np.zeros(len(values), bool)


class Index:
    """Finds passages of some items in texts."""

    def __init__(self, items: list[tuple], edits: float = EDITS):
        import xxhash

        if not 0 <= edits < 1:
            raise ValueError("edits must be a share from 0 to below 1: with all words edited, every text matches")
        self.items = [(key, w) for key, text in items if (w := words_of(text))]
        self.sets = [frozenset(words) for _, words in self.items]
        self.edits = edits
        #: Words of the items, numbered from 1.
        self.numbers = {w: k for k, w in enumerate(sorted(set().union(*self.sets)) if self.items else [], 1)}
        hashes = np.array([0x9E3779B97F4A7C15, *(xxhash.xxh64_intdigest(w) for w in self.numbers)], dtype=np.uint64)
        ids = [np.array([self.numbers[w] for w in words], np.int64) for _, words in self.items]
        none = [np.zeros(0, np.int64)]
        #: Pairs of neighbours of the items, and their triples: a pair's place and the word after it.
        self.pairs = np.unique(np.concatenate(none + [x[:-1] << 32 | x[1:] for x in ids]))
        self.triples = np.unique(np.concatenate(none + [np.searchsorted(self.pairs, x[:-2] << 32 | x[1:-1]) << 32 | x[2:] for x in ids if len(x) > 2]))
        classes: list[list[int]] = []
        for number in sorted(range(len(ids)), key=lambda n: len(ids[n])):
            if not classes or len(ids[number]) > SIZES * len(ids[classes[-1][0]]):
                classes.append([])
            classes[-1].append(number)
        self.walks = [Walks(numbers, [ids[n] for n in numbers], edits, hashes) for numbers in classes]

    def matches(self, text: str) -> list[tuple]:
        """(item key, first word, last word + 1, distance, item words) of each passage found, by item and place."""
        return self.matches_of([text])[0]

    def matches_of(self, texts: list[str]) -> list[list[tuple]]:
        """The matches of each text; the texts are searched together. Passages of one item do not overlap."""
        words, out = [words_of(t) for t in texts], [[] for _ in texts]
        if not self.items:
            return out
        get = self.numbers.get
        ids = np.fromiter((x for doc in words for x in (*(get(w, 0) for w in doc), 0)), np.int64)
        begin = np.cumsum([0] + [len(doc) + 1 for doc in words])
        for walks in self.walks:
            starts = self._starts(ids, walks)
            if not len(starts):
                continue
            for item, at in walks.candidates(ids, starts).items():
                by_text = defaultdict(list)
                for start in sorted(at):
                    text = int(np.searchsorted(begin, start, "right")) - 1
                    by_text[text].append(start - int(begin[text]))
                for text, places in by_text.items():
                    out[text] += self._verified(walks.numbers[item], words[text], places)
        return [sorted(found, key=lambda x: (str(x[0]), *x[1:])) for found in out]

    def _starts(self, ids: np.ndarray, walks: Walks) -> np.ndarray:
        """Where windows are walked: around the places from which enough item words and pairs follow."""
        if self._counted is not ids:
            upto = lambda x: np.concatenate(([0], np.cumsum(x)))
            paired, tripled = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
            at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            codes = ids[at] << 32 | ids[at + 1]
            known = _among(self.pairs, codes)
            at, codes = at[known], codes[known]
            paired[at] = True
            inner = at + 2 < len(ids)
            at, codes = at[inner], codes[inner]
            tripled[at] = _among(self.triples, np.searchsorted(self.pairs, codes) << 32 | ids[at + 2])
            self._counted, self._runs = ids, [upto(x) for x in (ids > 0, paired, tripled)]
            least = [min(n) for n in zip(*(w.least for w in self.walks), strict=True)]
            self._near = self._holding(np.flatnonzero(ids > 0), max(w.reach for w in self.walks), least)
        return self._holding(self._near, walks.reach, walks.least)

    def _holding(self, at: np.ndarray, reach: int, least: list[int]) -> np.ndarray:
        """The places that are followed by so many item words, pairs and triples within reach."""
        for size, (upto, wanted) in enumerate(zip(self._runs, least, strict=True)):
            if wanted > 0:
                end = np.minimum(at + max(reach - size, 0), len(upto) - 1)
                at = at[upto[end] - upto[at] >= wanted]
        return at

    _counted = None

    def _verified(self, number: int, words: list[str], places: list[int]) -> list[tuple]:
        """The passages of one item around candidate starts in order, by exact distance."""
        key, item = self.items[number]
        most, out, at, free = int(self.edits * len(item)), [], 0, 0
        while at < len(places):
            last = at
            while last + 1 < len(places) and places[last + 1] - places[at] <= len(item):
                last += 1
            low, high = max(free, places[at] - most), places[last] + len(item) + most
            window = words[low:high]
            after = last + 1
            if window and len(self.sets[number].difference(window)) <= most:
                distance, end = distance_ends(item, window)
                if distance <= most:
                    _, size = distance_ends(item[::-1], window[:end][::-1])
                    out.append((key, low + end - size, low + end, distance, len(item)))
                    free = low + end
                    # places beyond the passage may hold another one
                    after = next((k for k in range(at + 1, len(places)) if places[k] + most >= free), len(places))
            at = max(after, at + 1)
        return out


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """The items as lists whose texts have about BLOCK_BYTES at most, by a hash of the item."""
    df, at = by_position(benchmark)
    df = df.select(F.col(at[id_col]).alias("id"), F.col(at[text_col]).cast("string").alias("text")).where(F.col("text").isNotNull())
    size = df.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = 2 * size // BLOCK_BYTES + 1
    for k in range(n):
        part = df if n == 1 else df.where(F.pmod(F.xxhash64(F.col("id").cast("string"), "text"), F.lit(n)) == k)
        yield [tuple(r) for r in part.collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """A row for each passage of docs within ``edits`` of an item: doc_id, item_id, first_word,
    end_word, distance, item_words.

    Words are counted from 0 over the whole text. Null texts have no words; items
    without words match nothing; repeated rows report each; of overlapping passages of
    one item the best is reported. One pass, no shuffle.
    """
    df, at = by_position(docs)
    df = df.select(F.col(at[id_col]).alias("doc_id"), F.coalesce(F.col(at[text_col]).cast("string"), F.lit("")).alias("text"))
    kind, item_kind = (x.dataType.simpleString() for x in (df.schema["doc_id"], benchmark.schema[item_col]))
    out = None
    for items in blocks(benchmark, item_col):
        part = df.mapInArrow(_find(items, edits), f"doc_id {kind}, item_id {item_kind}, first_word long, end_word long, distance long, item_words long")
        out = part if out is None else out.union(part)
    return out


def _matches(index: Index, column):
    """The matches of each text of a column, some megabytes of texts at a time."""
    held, size = [], 0
    for x in column:
        held.append(x.as_py() or "")
        size += len(held[-1])
        if size > GROUP_BYTES:
            yield from index.matches_of(held)
            held, size = [], 0
    if held:
        yield from index.matches_of(held)


def _find(items, edits):
    def run(batches):
        import pyarrow as pa

        index = Index(items, edits)
        for batch in batches:
            rows, at = [], []
            for k, found in enumerate(_matches(index, batch.column("text"))):
                rows += found
                at += [k] * len(found)
            if rows:
                names = ["doc_id", "item_id", "first_word", "end_word", "distance", "item_words"]
                columns = [pa.array(x) if k == 0 else pa.array(x, pa.int64()) for k, x in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *columns], names)

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no passage of the benchmark, with all their columns."""
    df, at = by_position(docs)
    for items in blocks(benchmark):
        def run(batches, items=items):
            import pyarrow as pa

            index = Index(items, edits)
            try:
                for batch in batches:
                    clean = [not found for found in _matches(index, batch.column(at[text_col]))]
                    yield batch.filter(pa.array(clean, pa.bool_()))
            finally:
                del index
                give_back()

        df = df.mapInArrow(run, df.schema)
    return back(df, docs.columns)
