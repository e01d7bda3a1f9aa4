"""Cross-entropy difference of a target and a background n-gram model.

Both are interpolated bigram models over one shared vocabulary, every word of the
corpus. The background is counted over all documents, the target over the documents of
the target set; all words and bigrams are counted exactly, so the tables grow with the
corpus. Documents are dealt to chunks of about one size: by id and text hash, or by
row where an id (or a text without id) holds much of a chunk. A chunk sends each of its distinct
n-grams once, with its counts, to the block that the n-gram's hash falls in; the block
adds the counts of all chunks and answers each chunk in the order of its message. No
table is ever in one place, and a frequent n-gram costs a chunk as much as a rare one.
A document's score is the mean over its tokens of target loss less background loss: the
lower, the more like the target.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.common import by_position, saved

#: Bytes of text of a chunk; there are as many blocks of n-grams as chunks, so both are bounded.
CHUNK_BYTES = 16 << 20
#: Chunks that the rows of one id are spread over; an id with more than a part of a chunk gets a chunk for each such part.
SALTS, PARTS = 8, 4
#: Weight of the bigram model; the rest goes to the smoothed unigram model.
BIGRAM = 0.7
_WORD = re.compile(r"\w+|[^\w\s]")
_MESSAGE = "chunk int, block int, grams binary, n binary, n_target binary"
_ANSWER = "chunk int, block int, n binary, n_target binary, words long, tokens long, target_tokens long"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class _Numbers(dict):
    """Words numbered in order of appearance."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Chunk:
    """The distinct n-grams of some texts, by hash, and where each token's are."""

    def __init__(self, texts: pa.ChunkedArray):
        import xxhash
        import zstandard

        numbers, parts, unpack = _Numbers(), [], zstandard.ZstdDecompressor()
        for text in texts:
            words = words_of(unpack.decompress(text.as_py()).decode("utf-8"))
            parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        del parts
        self.starts = np.cumsum(self.sizes) - self.sizes
        inner = np.ones(len(self.words), bool)
        inner[self.starts[self.sizes > 0]] = False
        #: Places of the tokens that have one before them in their text, and their bigrams.
        self.inner = np.flatnonzero(inner)
        pairs, self.bigrams = np.unique(self.words[self.inner - 1].astype(np.int64) << 32 | self.words[self.inner], return_inverse=True)
        self.bigrams = self.bigrams.astype(np.int32)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in numbers), np.uint64, len(numbers))
        self.n_words = len(hashes)
        grams = np.concatenate((hashes & ~np.uint64(1), _mixed(hashes[pairs >> 32], hashes[pairs & 0xFFFFFFFF]) | np.uint64(1)))
        self.order = np.argsort(grams, kind="stable")
        #: Hashes in order; those of words are even, those of bigrams odd.
        self.grams = grams[self.order]

    def counts(self, among: np.ndarray) -> np.ndarray:
        """How often each n-gram is in the texts that are marked."""
        marked = np.repeat(among, self.sizes)
        both = (np.bincount(self.words[marked], minlength=self.n_words), np.bincount(self.bigrams[marked[self.inner]], minlength=len(self.grams) - self.n_words))
        return np.concatenate(both)[self.order]

    def losses(self, counts: np.ndarray, tokens: int, words: int) -> np.ndarray:
        """The mean loss of each text under the model of these counts; NaN without tokens."""
        placed = np.empty(len(counts))
        placed[self.order] = counts
        one, two = placed[:self.n_words], placed[self.n_words:]
        p = ((one + 1) / (tokens + words + 1))[self.words]
        before = one[self.words[self.inner - 1]]
        known = np.minimum(1.0, two[self.bigrams] / np.maximum(before, 1))
        p[self.inner] = np.where(before > 0, BIGRAM * known + (1 - BIGRAM) * p[self.inner], p[self.inner])
        out, some = np.full(len(self.sizes), np.nan), self.sizes > 0
        if some.any():
            out[some] = np.add.reduceat(-np.log(p), self.starts[some]) / self.sizes[some]
        return out


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _blocks_of(grams: np.ndarray, blocks: int) -> np.ndarray:
    """Where the n-grams of each block start among hashes in order, and where the last ends."""
    bounds = np.array([(k << 64) // blocks for k in range(1, blocks)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(grams, bounds), [len(grams)]))


def _text_packed(batches):
    """The rows with each text compressed, as it is shuffled."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [pack.compress(x.as_py().encode("utf-8")) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()), batch.column("chunk")], ["doc_id", "text", "chunk"])


def _messages(blocks: int):
    def run(key, rows: pa.Table, targets: pa.Table) -> pa.Table:
        chunk = Chunk(rows.column("text"))
        wanted = set(targets.column("t_id").to_pylist())
        every = chunk.counts(np.ones(rows.num_rows, bool))
        target = chunk.counts(np.fromiter((x in wanted for x in rows.column("doc_id").to_pylist()), bool, rows.num_rows))
        at, out = _blocks_of(chunk.grams, blocks), []
        for k in range(blocks):
            a, b = int(at[k]), int(at[k + 1])
            if a < b:
                steps = np.diff(chunk.grams[a:b], prepend=np.uint64(0))
                out.append((k, _packed(steps), _packed(every[a:b]), _packed(target[a:b])))
        number = key[0].as_py() if rows.num_rows else -1
        columns = [pa.array([number] * len(out), pa.int32()), *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary())))]
        return pa.table(columns, names=["chunk", "block", "grams", "n", "n_target"])

    return run


def _add(messages: pa.Table) -> pa.Table:
    """The summed counts of a block for each chunk, and its share of the totals with the first."""
    with np.errstate(over="ignore"):
        grams = [np.cumsum(_unpacked(x.as_py()), dtype=np.uint64) for x in messages.column("grams")]
    ends = np.cumsum([len(g) for g in grams])
    distinct, at = np.unique(np.concatenate(grams), return_inverse=True)
    sums = []
    for name in ("n", "n_target"):
        n = np.concatenate([_unpacked(x.as_py()) for x in messages.column(name)])
        sums.append(np.bincount(at, weights=n).astype(np.int64))
    words = (distinct & np.uint64(1)) == 0
    totals = [int(words.sum()), *(int(s[words].sum()) for s in sums)]
    parts = np.split(at, ends[:-1])
    return pa.table([
        messages.column("chunk"), messages.column("block"), *(pa.array([_packed(s[p]) for p in parts], pa.binary()) for s in sums),
        *(pa.array([t] + [0] * (len(parts) - 1), pa.int64()) for t in totals)],
        names=["chunk", "block", "n", "n_target", "words", "tokens", "target_tokens"])


def _scores(words: int, tokens: int, target_tokens: int):
    def run(key, rows: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(rows.column("text"))
        answers = answers.sort_by("block")
        columns = [rows.column("doc_id"), pa.array(chunk.sizes)]
        for name, total in (("n_target", target_tokens), ("n", tokens)):
            counts = np.concatenate([np.zeros(0, np.uint64), *(_unpacked(x.as_py()) for x in answers.column(name))])
            columns.append(pa.array(chunk.losses(counts, total, words), from_pandas=True))
        return pa.table(columns, names=["doc_id", "n_tokens", "target_loss", "background_loss"])

    return run


def _dealt(df: DataFrame, target_ids: DataFrame, chunk_bytes: int) -> tuple[DataFrame, DataFrame, int]:
    """The rows with their chunks, the target ids at each chunk that may hold them, and the number of chunks."""
    kind, text_hash = df.schema["doc_id"].dataType, F.xxhash64("text")
    df = df.withColumn("key", F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), text_hash)))
    held = saved(df.groupBy("key").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")))
    chunks = held.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] // chunk_bytes + 1
    part = max(1, chunk_bytes // PARTS)
    hot = held.where(F.col("bytes") > part).select("key", F.least(F.lit(chunks), F.ceil(F.col("bytes") / part)).cast("long").alias("places"))
    some = chunks > 1 and not hot.isEmpty()

    # an id's rows are spread by their text, rows without id all over, and target ids go to each place
    chunk_of = lambda id_, salt: F.pmod(F.xxhash64(id_, salt), F.lit(chunks)).cast("int")
    # a key with many bytes has its rows spread over neighbouring chunks, whatever their text
    next_of = lambda salt: F.pmod(F.pmod(F.col("key"), F.lit(chunks)) + salt, F.lit(chunks)).cast("int")
    salt = F.when(F.col("doc_id").isNull(), text_hash).otherwise(F.pmod(text_hash, F.lit(SALTS)))
    chunk, salts = chunk_of(F.col("doc_id"), salt), F.array(*[F.lit(k).cast("long") for k in range(SALTS)])
    chosen = target_ids.select(F.col("doc_id").cast(kind).alias("t_id")).where("t_id is not null").withColumn("key", F.xxhash64("t_id"))
    place = chunk_of(F.col("t_id"), F.col("salt"))
    if some:
        # PARTS keys a chunk at most, so they can go to all tasks
        df = df.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(hot), "key", "left")
        chosen = chosen.join(F.broadcast(hot), "key", "left")
        chunk = F.when(F.col("places").isNull(), chunk).otherwise(next_of(F.pmod(F.xxhash64("row"), F.col("places"))))
        place = F.when(F.col("places").isNull(), place).otherwise(next_of(F.col("salt")))
        salts = F.when(F.col("places").isNull(), salts).otherwise(F.sequence(F.lit(0).cast("long"), F.col("places") - 1))
    rows = df.select("doc_id", "text", chunk.alias("chunk")).mapInArrow(_text_packed, f"doc_id {kind.simpleString()}, text binary, chunk int")
    # rows are read twice, and a row's number may differ when it is computed again
    return saved(rows) if some else rows, chosen.withColumn("salt", F.explode(salts)).select("t_id", place.alias("chunk")), chunks


def score(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score (their difference) of each row.

    target_ids (doc_id) names the documents of the target set; unknown, repeated and
    null ids in it do not matter. Losses are nats per token, the first token by its
    unigram model; a null or empty text has no tokens and nulls. Without a target its
    model is uniform over the vocabulary. Repeated rows count and are scored each, rows
    of null ids belong to no target. Empty table: empty result.
    """
    df, at = by_position(docs)
    df = df.select(F.col(at[id_col]).alias("doc_id"), F.coalesce(F.col(at[text_col]).cast("string"), F.lit("")).alias("text"))
    kind = df.schema["doc_id"].dataType
    rows, chosen, chunks = _dealt(df, target_ids, chunk_bytes)

    messages = rows.groupBy("chunk").cogroup(chosen.groupBy("chunk")).applyInArrow(_messages(chunks), _MESSAGE)
    answers = saved(messages.groupBy("block").applyInArrow(_add, _ANSWER))
    totals = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "tokens", "target_tokens")]).first()
    answers = answers.select("chunk", "block", "n", "n_target")
    out = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _scores(*totals), f"doc_id {kind.simpleString()}, n_tokens long, target_loss double, background_loss double")
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))
