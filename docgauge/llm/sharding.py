"""Shards from a Feistel permutation of global row numbers.

Rows are numbered 0 .. n-1 in a fixed order, the numbers are permuted by a keyed
Feistel network with cycle walking, and a row's shard and slot are the remainder
and quotient of its new number. Anyone with (n, key) can compute both from a row
number, and back.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.common import by_position, saved

ROUNDS = 6
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def half_bits(n: int) -> int:
    """Bits of each half: the network's domain is the least even power of two that holds n."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = x ^ np.uint64(key & 0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * _M1
        x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def _network(x: np.ndarray, bits: int, key: int, rounds) -> np.ndarray:
    low = np.uint64((1 << bits) - 1)
    left, right = x >> np.uint64(bits), x & low
    for r in rounds:
        left, right = right, left ^ (_mix(right, key * 0x9E3779B97F4A7C15 + r) & low)
    return (right << np.uint64(bits)) | left


def permute(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The new place of each row number below n; a bijection of 0 .. n-1."""
    return _walk(numbers, n, key, range(ROUNDS))


def unpermute(places: np.ndarray, n: int, key: int) -> np.ndarray:
    """The row numbers that ``permute`` sends to these places."""
    return _walk(places, n, key, range(ROUNDS - 1, -1, -1))


def _walk(x, n, key, rounds):
    out = np.asarray(x, dtype=np.uint64)
    bits, rounds = half_bits(n), list(rounds)
    out = _network(out, bits, key, rounds)
    while (beyond := out >= np.uint64(n)).any():  # outside the table: walk on along the cycle
        out[beyond] = _network(out[beyond], bits, key, rounds)
    return out.astype(np.int64)


def shard_and_slot(numbers: np.ndarray, n: int, shards: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    place = permute(numbers, n, key)
    return place % shards, place // shards


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows with a gapless ``row_number`` in the order of the given columns, and their count.

    Ranges of the order are dealt to tasks and written once, so both reads see the
    same tasks; only one count per task reaches the driver. A last random-free key
    (the input position) splits rows that are equal in every given column: which of
    them comes first does not change the result.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = saved(
        rows.withColumn("n_at", F.monotonically_increasing_id())
        .repartitionByRange(parts, *order, "n_at").sortWithinPartitions(*order, "n_at").drop("n_at")
        .withColumn("n_part", F.spark_partition_id()).withColumn("n_seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = dict(held.groupBy("n_part").count().collect())
    sizes = np.array([counts.get(p, 0) for p in range(max(counts, default=0) + 1)], dtype=np.int64)
    first = np.cumsum(sizes) - sizes

    @F.pandas_udf("long")
    def number(part, seq):
        import pandas as pd

        return pd.Series(first[part.to_numpy()] + seq.to_numpy())

    return held.withColumn("row_number", number("n_part", "n_seq")).drop("n_part", "n_seq"), int(sizes.sum())


def assign(docs: DataFrame, shards: int = 24, key: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row; shard sizes differ by one row at most.

    A null text has size 8 and checksum 0. The order of rows is that of (doc_id,
    checksum, size, text hash): the result does not depend on files or partitions.
    Null ids come first. Empty table: empty result.
    """
    df, at = by_position(docs)
    text = F.coalesce(F.col(at[text_col]).cast("string"), F.lit(""))
    slim = df.select(
        F.col(at[id_col]).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    rows, n = numbered(slim, ["doc_id", "text_crc32", "size", "text_hash"])

    @F.pandas_udf("long")
    def place(number):
        import pandas as pd

        return pd.Series(permute(number.to_numpy(), n, key))

    rows = rows.withColumn("place", place("row_number"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number")
