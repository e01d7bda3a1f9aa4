"""What each filter removes under every order of filters, from truth-table survival words.

With five filters there are 32 sets of them. A document becomes one 32-bit word whose bit
S is 1 if it passes every filter of set S. How many documents survive each set is then a
positional popcount: per part and label, words are added bit by bit with carry-save
adders, three words of one weight giving one of that weight and one of the double, until
few are left to unpack. Everything about all 120 orders follows from the 32 counts, so
no order is ever run over the documents.

Copies of a text share a digest and so all verdicts but the last: rows are first summed
by id and text, then by text and part, and a filter on repeats needs only the smallest id
of each text. A text that a third of the rows hold is summed before it is shuffled.
"""

from collections import defaultdict
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgauge.functions.text import literal
from docgauge.llm.common import by_position

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 100, 80, 10, b"#$%&*|"
REPEAT = 4
_CAPITALS, _INNER_BYTES = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
#: Parts, with labels, whose adders a task holds before it sends its counts on.
HELD = 4096


def failing(text: bytes) -> int:
    """The filters A to D that a UTF-8 text fails, as bits 0 to 3."""
    words = text.split()  # ASCII white space only, on bytes
    distinct, n = len(set(words)), len(words)
    chars = len(text.translate(None, _INNER_BYTES))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    signs = len(text) - len(text.translate(None, SIGNS))
    return (n < LEAST_WORDS) | (100 * distinct < DISTINCT_PERCENT * n) << 1 | (100 * capitals > CAPITAL_PERCENT * chars) << 2 | (signs > 0) << 3


#: The survival word of each set of failed filters: bit S is 1 if no filter of S is among them.
SURVIVAL = np.array([sum(1 << kept for kept in range(32) if not kept & failed) for failed in range(32)], dtype=np.uint32)


class Adder:
    """Bit-sliced counters of the 32 positions of words; plane k holds words of weight 2**k."""

    #: Words of a plane above which it is reduced.
    FULL = 1 << 12

    def __init__(self):
        self.planes: dict[int, list[np.ndarray]] = defaultdict(list)
        self.sizes: dict[int, int] = defaultdict(int)

    def add(self, words: np.ndarray, times: np.ndarray) -> None:
        """Adds each word so many times: it joins the planes of the binary digits of its number."""
        for k in range(int(times.max(initial=0)).bit_length()):
            self._put(k, words[(times >> k) & 1 == 1])

    def _put(self, plane: int, words: np.ndarray) -> None:
        while len(words):
            self.planes[plane].append(words)
            self.sizes[plane] += len(words)
            if self.sizes[plane] < self.FULL:
                return
            words, plane = self._carried(plane), plane + 1

    def _carried(self, plane: int) -> np.ndarray:
        """Reduces a plane to two words at most; the carries, of twice the weight, are returned."""
        words, carries = np.concatenate(self.planes[plane]), []
        while len(words) > 2:
            third = len(words) // 3
            a, b, c, rest = words[:third], words[third:2 * third], words[2 * third:3 * third], words[3 * third:]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate((half ^ c, rest))
        self.planes[plane], self.sizes[plane] = [words], len(words)
        return np.concatenate(carries) if carries else words[:0]

    def counts(self) -> list[int]:
        """The sum of each position."""
        out, plane = [0] * 32, 0
        while plane <= max(self.planes, default=-1):
            if self.planes[plane]:
                self._put(plane + 1, self._carried(plane))
                for word in self.planes[plane][0].tolist():
                    for k in range(32):
                        out[k] += (word >> k & 1) << plane
            plane += 1
        return out


# ---------------------------------------------------------------- on the cluster

def _verdicts(docs: DataFrame, part_col: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, part, fails (A to D) and digest of each row."""
    df, at = by_position(docs)
    text = F.coalesce(F.col(at[text_col]).cast("string"), F.lit("")).cast("binary").alias("text")
    df = df.select(F.col(at[id_col]).alias("doc_id"), F.coalesce(F.col(at[part_col]).cast("string"), F.lit("")).alias("part"), text)
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            fails, digests = [], []
            for x in batch.column("text"):
                data = x.as_py()
                fails.append(failing(data))
                digests.append(hashlib.sha256(data).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(fails, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "fails", "digest"])

    return df.mapInArrow(run, f"doc_id {kind}, part string, fails int, digest binary")


def _labelled(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """rows with good and toxic; rows without id, or whose id has no label, have neither."""
    marks, at = by_position(labels)
    marks = marks.select(F.col(at[id_col]).alias("l_id"), *[F.coalesce(F.col(at[c]) == 1, F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    marks = marks.where("l_id is not null").groupBy("l_id").agg(F.bool_or("good").alias("good"), F.bool_or("toxic").alias("toxic"))
    unlabelled = rows.where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    joined = rows.where("doc_id is not null").join(marks, F.col("doc_id") == F.col("l_id"), "left").drop("l_id")
    return joined.withColumns({n: F.coalesce(n, F.lit(False)) for n in ("good", "toxic")}).unionByName(unlabelled)


def classes(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, good, toxic, fails (A to E) and n: how many rows of one text and part fail the same."""
    rows = _labelled(_verdicts(docs, part_col, id_col, text_col), labels, id_col)
    kind = ["digest", "part", "fails", "good", "toxic"]
    # rows of one id and text are one, with their number; then the ids of a text are summed, its smallest apart
    rows = rows.groupBy("doc_id", *kind).agg(F.count(F.lit(1)).alias("n"))
    texts = rows.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("lowest"), F.min_by("n", "doc_id").alias("n_lowest"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    least = F.min("lowest").over(Window.partitionBy("digest"))
    first = F.col("n_null") + F.when(F.col("lowest") == least, F.col("n_lowest")).otherwise(0)
    texts = texts.withColumn("first", F.coalesce(first, F.col("n_null")))
    both = F.array(F.struct(F.col("fails"), F.col("first").alias("n")), F.struct((F.col("fails") + (1 << REPEAT)).alias("fails"), (F.col("n") - F.col("first")).alias("n")))
    return texts.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.fails", "x.n").where("n > 0")


def survivors(found: DataFrame) -> DataFrame:
    """part, and arrays all, good and toxic: how many documents survive each of the 32 sets."""

    def run(batches):
        import pyarrow as pa

        names = ["part", "good", "toxic"]
        adders: dict[tuple, Adder] = defaultdict(Adder)

        def sent():
            rows = [(*key, adder.counts()) for key, adder in adders.items()]
            adders.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], pa.bool_()) for k in (1, 2)), pa.array([r[3] for r in rows], pa.list_(pa.int64()))], [*names, "counts"])

        for batch in batches:
            words, times = SURVIVAL[batch.column("fails").to_numpy()], batch.column("n").to_numpy()
            places = defaultdict(list)
            for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                places[key].append(k)
            for key, at in places.items():
                adders[key].add(words[at], times[at])
            if len(adders) > HELD:
                yield sent()
        yield sent()

    counts = found.mapInArrow(run, "part string, good boolean, toxic boolean, counts array<long>")
    rows = counts.select("part", "good", "toxic", F.posexplode("counts").alias("kept_set", "n"))
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    rows = rows.groupBy("part", "kept_set").agg(F.sum("n").alias("all"), of("good"), of("toxic"))
    held = F.array_sort(F.collect_list(F.struct("kept_set", "all", "good", "toxic")))  # 32 rows a part
    return rows.groupBy("part").agg(held.alias("x")).select("part", *[F.col(f"x.{c}").alias(c) for c in ("all", "good", "toxic")])


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, filter, filters before it as a set) of each step of each order."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, number in enumerate(order, 1):
            out.append(("".join(FILTERS[k] for k in order), step, number, before))
            before |= 1 << number
    return out


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each part, order of filters and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost and shapley.

    A null text is empty, a null part the empty string. A null id is smaller than none
    and has no smaller one, so such rows are no repeats; rows that repeat an id with its
    text are no repeats of each other. An id with several labels counts as good or toxic
    if one of them says so. An empty table gives an empty result; extra columns are not read.
    """
    full = (1 << len(FILTERS)) - 1
    steps = F.explode(literal(orders())).alias("x")  # 600 rows, a fixed table
    rows = survivors(classes(docs, labels, part_col, id_col, text_col)).select("part", "all", "good", "toxic", steps)
    rows = rows.select("*", F.col("x.v0").alias("filter_order"), F.col("x.v1").alias("step"), F.col("x.v2").alias("number"), F.col("x.v3").alias("before"))
    alive = lambda what, among: F.get(F.col(what), among)
    before = F.col("before")
    own = F.expr("shiftleft(1, number)")
    after = before.bitwiseOR(own)
    lost = lambda what: alive(what, before) - alive(what, after)
    rows = rows.select(
        "part", "filter_order", "step", "number",
        alive("all", after).alias("kept"), lost("all").alias("removed"),
        (alive("all", F.lit(0)) - alive("all", own) - lost("all")).alias("redundant"),
        (alive("all", F.lit(full).bitwiseXOR(own)) - alive("all", F.lit(full))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"))
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "number"))).drop("number")
