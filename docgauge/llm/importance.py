"""Importance resampling towards a target distribution, over hashed word n-grams.

The distinct words of a group of texts form an Aho-Corasick dictionary, each bounded by
a space on both sides, whose entries carry the word's CRC-32 and length. One scan of the
texts emits the payloads in order. The checksum of a run of words follows from those of
its words alone: a checksum is moved over the bytes that come after it by a linear map
of their number, so payloads of neighbours compose into the checksums, and so buckets, of
all runs of up to three words, and no run is ever spelled out. Buckets are counted over
all rows of both tables; a bucket's gain is its log ratio of target to source, a text's
weight the sum of the gains of its runs, and a seeded Gumbel draw per id turns weights
into scores, of which the highest are drawn.
"""

import math
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.common import by_position, saved
from docgauge.llm.sharding import numbered

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 42, 5, 20
#: Bytes of text that share one dictionary; a longer text has one of its own.
GROUP_BYTES = 4 << 20
#: Letters lower-cased (A-Z only), digits and all bytes beyond ASCII stay, the rest are delimiters.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_CRC_STEP = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)
_SPACE = np.uint32(zlib.crc32(b" "))


# ---------------------------------------------------------------- checksums

@lru_cache(maxsize=64)
def _moved_by_power(k: int) -> np.ndarray:
    """What moving over 2**k bytes makes of each of the 32 bits of a checksum."""
    if k == 0:
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        return (bits >> np.uint32(8)) ^ _CRC_STEP[bits & np.uint32(255)]
    half = _moved_by_power(k - 1)
    return _applied(half, half)


def _applied(images: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The linear map with these images of the 32 bits, applied to each value."""
    chosen = (values[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
    return np.bitwise_xor.reduce(chosen * images, axis=1)


@lru_cache(maxsize=4096)
def _move_table(length: int) -> np.ndarray:
    """The map of moving over ``length`` bytes, by each value of each byte of a checksum: 4 x 256."""
    images = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for k in range(length.bit_length()):
        if length >> k & 1:
            images = _applied(_moved_by_power(k), images)
    values = np.arange(256, dtype=np.uint32)
    return np.stack([_applied(images, values << np.uint32(8 * place)) for place in range(4)])


def _moved(checksums: np.ndarray, tables: np.ndarray, which) -> np.ndarray:
    """Each checksum moved by the table that ``which`` names."""
    byte = lambda k: (checksums >> np.uint32(8 * k)) & np.uint32(255)
    return tables[which, 0, byte(0)] ^ tables[which, 1, byte(1)] ^ tables[which, 2, byte(2)] ^ tables[which, 3, byte(3)]


# ---------------------------------------------------------------- dictionary

def _distinct_words(text: bytes) -> set[bytes]:
    """The words of a plain text, gathered piece by piece so that a long text makes no long list."""
    found, at = set(), 0
    while at < len(text):
        end = text.find(b" ", at + (1 << 20))
        end = len(text) if end < 0 else end
        found.update(text[at:end].split())
        at = end
    return found


class Dictionary:
    """The distinct words of some plain texts with checksum and length as payload."""

    def __init__(self, words):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()  # payloads of 64 bits
        for word in words:
            self.automaton.add_word(f" {word.decode('latin-1')} ", len(word) << 32 | zlib.crc32(word))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Last place, checksum and length of each word of the text, which starts and ends with a space."""
        kind = np.dtype([("end", np.int64), ("payload", np.int64)])
        found = np.zeros(0, kind) if self.empty else np.fromiter(self.automaton.iter(text.decode("latin-1")), kind)
        return found["end"], (found["payload"] & 0xFFFFFFFF).astype(np.uint32), found["payload"] >> 32


class Runs:
    """The buckets of all runs of one to three words of some texts."""

    def __init__(self, texts: list[bytes], buckets: int = BUCKETS):
        whole = b" " + b" ".join(t.translate(_PLAIN) for t in texts) + b" "
        ends, one, length = Dictionary(_distinct_words(whole)).scan(whole)
        last = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        #: Words before the end of each text.
        self.upto = np.searchsorted(ends, last, side="right")
        before = np.concatenate(([0], self.upto))
        self.n_words = np.diff(before)
        lengths, which = np.unique(length, return_inverse=True)
        tables = np.stack([_move_table(int(n)) for n in lengths]) if len(lengths) else np.zeros((1, 4, 256), np.uint32)
        over_space = _move_table(1)[None]
        opened = _moved(one, over_space, 0) ^ _SPACE
        two = _moved(opened[:-1], tables, which[1:]) ^ one[1:]
        opened = _moved(two, over_space, 0) ^ _SPACE
        three = _moved(opened[:-1], tables, which[2:]) ^ one[2:]
        text_of = np.repeat(np.arange(len(texts)), self.n_words)
        #: For runs of one, two and three words: bucket and text of each; runs over two texts are left out.
        self.of_size = []
        for size, checksum in enumerate((one, two, three)):
            starts = text_of[:len(checksum)] if size == 0 else text_of[:-size]
            inside = starts == text_of[size:]
            self.of_size.append(((checksum[inside] % np.uint32(buckets)).astype(np.int64), starts[inside]))

    @property
    def n_features(self) -> np.ndarray:
        return self.n_words + np.maximum(self.n_words - 1, 0) + np.maximum(self.n_words - 2, 0)

    def counts(self, buckets: int = BUCKETS) -> np.ndarray:
        return sum(np.bincount(bucket, minlength=buckets) for bucket, _ in self.of_size)

    def weights(self, gains: np.ndarray) -> np.ndarray:
        """The sum of the gains of each text, in whole numbers."""
        out = np.zeros(len(self.n_words), np.int64)
        for bucket, text in self.of_size:
            upto = np.concatenate(([0], np.cumsum(gains[bucket])))
            out += np.diff(upto[np.searchsorted(text, np.arange(len(out) + 1))])
        return out


def _groups(batch, column: str):
    """Neighbouring rows of a batch as (first row, texts) whose texts have about GROUP_BYTES."""
    first, held, size = 0, [], 0
    for k, text in enumerate(batch.column(column)):
        held.append(text.as_py())
        size += len(held[-1])
        if size >= GROUP_BYTES:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held


# ---------------------------------------------------------------- on the cluster

def _texts(docs: DataFrame, id_col: str | None, text_col: str) -> DataFrame:
    df, at = by_position(docs)
    text = F.coalesce(F.col(at[text_col]).cast("string"), F.lit("")).cast("binary").alias("text")
    return df.select(*([F.col(at[id_col]).alias("doc_id")] if id_col else []), text)


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall in each bucket; a task sends one row for each bucket it met."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _groups(batch, "text"):
                total += Runs(texts, buckets).counts(buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["bucket", "n"])

    found = _texts(docs, None, text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in found.collect():  # one number for each bucket, whatever the size of the table
        out[bucket] = n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of target to source share of each bucket, one added to each count, floored."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))))
        for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row."""
    df = _texts(docs, id_col, text_col)
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, texts in _groups(batch, "text"):
                runs = Runs(texts, len(gains))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(texts)), *(pa.array(x, pa.int64()) for x in (runs.n_words, runs.n_features, runs.weights(gains)))],
                    ["doc_id", "n_words", "n_features", "weight"])

    out = df.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    uniform = (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return out.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))).cast("long"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS,
             seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of docs; rank is null where a row is not drawn.

    Of the N rows with ``least_words`` words or more, floor(percent * N / 100) with the
    highest scores are drawn and numbered from 1; ties go to the smaller id, null ids
    come first, and rows equal in score and id are drawn in any order. A null text is
    empty: no features, weight 0, never drawn. Repeated rows count and are drawn each.
    An empty target makes all gains favour rare buckets; an empty table gives an empty
    result. Only bucket counts and one count per task reach the driver.
    """
    gains = gains_of(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text_col, buckets))
    rows = saved(weighed(docs, gains, seed, id_col, text_col))
    able = F.col("n_words") >= least_words
    drawn = percent * rows.where(able).count() // 100
    rows = rows.withColumns({"r_last": (~able).cast("int"), "r_score": -F.col("score")})
    ranked, _ = numbered(rows, ["r_last", "r_score", "doc_id"])
    rank = F.when(able & (F.col("row_number") < drawn), F.col("row_number") + 1)
    return ranked.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))
