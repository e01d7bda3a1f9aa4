"""Quality classifier: hashed word n-grams, logistic regression trained by FTRL-proximal.

A text's features are its words, punctuation runs and their pairs, hashed to 2^BITS
places, each with weight count / sqrt(number of n-grams), and two more of its n-grams:
the share of pairs of one word twice, and the share of n-grams seen before. A score is the logistic of a
sparse dot product with the weights.
"""

import re
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.common import by_position

BITS = 18
#: Labelled rows that training uses at most, those with the least key hash first.
SAMPLE = 6000
#: Learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.15, 1.0, 0.02, 0.2
EPOCHS = 3
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and values of a text's hashed 1-grams and 2-grams; places 0 to 2 are the bias and the repeats."""
    words = np.fromiter((crc32(w.encode()) for w in _TOKEN.findall(text)), np.uint64)
    with np.errstate(over="ignore"):
        pairs = (words[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (words[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        pairs ^= pairs >> np.uint64(29)
    places = np.concatenate((words, pairs)) & np.uint64((1 << BITS) - 1)
    twice = (words[1:] == words[:-1]).mean() if len(words) > 1 else 0.0
    places, counts = np.unique(places.astype(np.int64), return_counts=True)
    total = max(1, counts.sum())
    return np.concatenate(([0, 1, 2], places + 3)), np.concatenate(([1.0, 4 * twice, 4 * (1 - len(counts) / total)], counts / np.sqrt(total)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after FTRL-proximal updates over the rows (places, values, label) in their order."""
    z, n = np.zeros((1 << BITS) + 3), np.zeros((1 << BITS) + 3)

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, label in rows:
            w = weights(at)
            g = (_logistic(w @ x) - label) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    return weights(slice(None)).astype(np.float32)


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def held_out(id_col: str = "doc_id"):
    """Rows that training never sees: crc32 of the id as text leaves remainder 0 by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from the documents of a bounded sample of labelled rows outside the held-out fold.

    The sample (ids and labels) is small by its limit and goes to all tasks; features
    are made where the texts are, and one task trains on the sample's sparse rows.
    An id counts once: with the label that most of its label rows give, and with one of
    its texts (least hash, then least text), chosen before rows meet, so that an id of
    many rows fills no task. Not used: ids whose label rows are tied, null labels and
    ids, labels of unknown documents. Null texts count as empty, other columns are not
    looked at. No labels or no documents: zero weights.
    """
    df, at = by_position(labels)
    marks = df.select(F.col(at["doc_id"]).alias("id"), (F.col(at["quality"]).cast("int") > 0).cast("int").alias("label"))
    marks = marks.where(F.col("label").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    marks = marks.groupBy("id").agg((2 * F.sum("label") - F.count("*")).alias("lead")).where("lead <> 0")
    marks = marks.select("id", (F.col("lead") > 0).cast("int").alias("label"))
    # the share of hashes that holds the sample, so that few rows are ranked
    share = min(1.0, 1.2 * sample / max(1, marks.count()))
    turn = F.xxhash64(F.col("id").cast("string"))
    marks = marks.where(F.pmod(turn, F.lit(1 << 31)) < int(share * (1 << 31))).orderBy(turn, "id").limit(sample)
    df, at = by_position(docs)
    df = df.select(F.col(at["doc_id"]).alias("id"), F.coalesce(F.col(at["text"]).cast("string"), F.lit("")).alias("text"))
    rows = df.join(F.broadcast(marks), "id").groupBy("id", "label").agg(
        F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first"))
    rows = rows.select(F.xxhash64(F.col("id").cast("string")).alias("turn"), F.col("first.text").alias("text"), "label")

    def sparse(batches):
        import pyarrow as pa

        for batch in batches:
            found = [features(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([
                batch.column("turn"), batch.column("label"), pa.array([a for a, _ in found], pa.list_(pa.int64())),
                pa.array([x for _, x in found], pa.list_(pa.float64()))], ["turn", "label", "at", "x"])

    def learn(batches):
        import pyarrow as pa

        held = [r for batch in batches for r in zip(
            batch.column("turn").to_pylist(), batch.column("label").to_pylist(),
            (a.values.to_numpy() for a in batch.column("at")), (a.values.to_numpy() for a in batch.column("x")), strict=True)]
        held.sort(key=lambda r: (r[0], r[1], len(r[2])))
        weights = train([(a, x, label) for _, label, a, x in held])
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])

    sparse_rows = rows.mapInArrow(sparse, "turn long, label int, at array<long>, x array<double>")
    out = sparse_rows.repartition(1).mapInArrow(learn, "weights binary").toArrow().column("weights").to_pylist()
    return np.frombuffer(out[0], np.float32) if out else np.zeros((1 << BITS) + 3, np.float32)


def score(docs: DataFrame, weights: np.ndarray, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= cut) of each row, in one pass.

    A null text counts as empty and has the score of the bias. Repeated rows and null
    ids keep their rows; null ids are in no fold.
    """
    df, at = by_position(docs)
    df = df.select(F.col(at["doc_id"]).alias("doc_id"), F.coalesce(F.col(at["text"]).cast("string"), F.lit("")).alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        import pyarrow as pa

        w = shared.value
        for batch in batches:
            scores = []
            for text in batch.column("text"):
                places, values = features(text.as_py())
                scores.append(float(_logistic(w[places] @ values)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    out = df.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
