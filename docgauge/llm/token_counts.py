"""Token counts from pre-token frequencies.

Each distinct pre-token of the corpus is counted once; a document's count is the sum
of its pre-tokens' counts times their frequencies, and no ids are made. The most
frequent pre-tokens (a fixed number of bounded strings) go to all tasks, so that no
pre-token is a hot join key; the rest is joined by shuffle.
"""

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.common import by_position, most_frequent, saved
from docgauge.llm.pretokens import Splitter, library

#: Pre-tokens that go to all tasks: so many at most, of so many bytes each at most.
HOT, HOT_BYTES = 300_000, 48
#: Distinct pre-tokens that a task holds before it passes counts on.
HELD = 500_000


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """Every distinct pre-token of the column ``text`` with its frequency: piece, freq."""
    def run(batches):
        import pyarrow as pa

        split, seen, chunks = Splitter(path), Counter(), Counter()

        def flush():
            for chunk, n in chunks.items():
                for w in split.plain(" " + chunk):
                    seen[w] += n
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["piece", "freq"])
            seen.clear()
            chunks.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                text = text.as_py()
                parts = split.chunks(text)
                if parts is None:
                    seen.update(split(text))
                else:
                    seen.update(split.plain(parts[0]))
                    chunks.update(parts[1:])
                if len(seen) + len(chunks) > HELD:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "piece string, freq long").groupBy("piece").agg(F.sum("freq").alias("freq"))


def piece_tokens(distinct: DataFrame, path: str) -> DataFrame:
    """piece, freq and the number of tokens of each distinct pre-token."""
    def run(batches):
        import pyarrow as pa

        tokenizer = library(path)
        for batch in batches:
            found = tokenizer.encode_batch_fast(batch.column("piece").to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column("piece"), batch.column("freq"), pa.array([len(x) for x in found], pa.int64())], ["piece", "freq", "n"])

    return distinct.mapInArrow(run, "piece string, freq long, n long")


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row.

    A null text counts as empty: no bytes, no tokens. Rows are told apart by position,
    so null or repeated ids each keep their row. Empty table: empty result.
    """
    df, at = by_position(docs)
    df = df.select(F.col(at[id_col]).alias("doc_id"), F.coalesce(F.col(at[text_col]).cast("string"), F.lit("")).alias("text"))
    known = saved(piece_tokens(pieces(df, path), path))
    top = most_frequent(known.where(F.octet_length("piece") <= HOT_BYTES), "freq", hot).select("piece", "n").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(dict(zip(top.column("piece").to_pylist(), top.column("n").to_pylist(), strict=True)))
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        split, count = Splitter(path), shared.value.get
        chunks: dict = {}

        def look(words):
            """Tokens of the words that are known here, and the other words."""
            found = [(count(w), w) for w in words]
            return sum(n for n, _ in found if n is not None), [w for n, w in found if n is None]

        def chunk_of(chunk):
            known = look(split.plain(" " + chunk))
            known = known if known[1] else known[0]
            if len(chunk) <= 64:
                if len(chunks) > HELD:
                    chunks.clear()
                chunks[chunk] = known
            return known

        names = ["row", "doc_id", "n_bytes", "base", "piece", "freq"]
        for batch in batches:
            sizes, sums, rest, rows = [], [], [], []
            for k, text in enumerate(batch.column("text")):
                text = text.as_py()
                parts = split.chunks(text)
                total, unknown = look(split(text) if parts is None else split.plain(parts[0]))
                for known in [] if parts is None else [chunks.get(c) or chunk_of(c) for c in parts[1:]]:
                    if type(known) is int:
                        total += known
                    else:
                        total += known[0]
                        unknown += known[1]
                other = Counter(unknown)
                sizes.append(len(text.encode("utf-8")))
                sums.append(total)
                rest += other.items()
                rows += [k] * len(other)
            at_rows = batch.column("row")
            yield pa.RecordBatch.from_arrays([at_rows, batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.nulls(len(sums), pa.string()), pa.nulls(len(sums), pa.int64())], names)
            if rest:
                m = len(rest)
                yield pa.RecordBatch.from_arrays([at_rows.take(pa.array(rows, pa.int64())), pa.nulls(m, batch.column("doc_id").type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array([w for w, _ in rest], pa.string()), pa.array([c for _, c in rest], pa.int64())], names)

    flat = df.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, f"row long, doc_id {kind}, n_bytes long, base long, piece string, freq long")
    # rows without a piece get a key that no pre-token equals, else all would meet in one task
    key = F.coalesce("piece", F.concat(F.lit("\x00"), F.col("row").cast("string")))
    joined = flat.withColumn("piece", key).join(known.select("piece", "n"), "piece", "left")
    part = F.coalesce("base", F.lit(0)) + F.coalesce(F.col("freq") * F.col("n"), F.lit(0))
    out = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(part).alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
