"""SimHash near-duplicates by covering locality-sensitive hashing.

Bits of a fingerprint get vectors of {0,1}^(r+1); for each nonzero vector v a mask
keeps the bits whose vector has an odd product with v. For any r differing bits some
v is orthogonal to all of them, so every pair within radius r agrees under some mask:
2^(r+1) - 1 tables find every link, none is missed. Only distinct fingerprints are
tabled, so copies never meet in a bucket. A bucket that is still large is covered once
more, over the bits that its mask leaves free; two coverings leave 16 bits free at most,
so no finer bucket holds over 65,536 fingerprints and each is linked in one place. Links
of a bucket are thinned to a spanning forest of it (components are the same), and
components are found by alternating star steps on the cluster.
"""

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgauge.llm.common import back, by_position, saved

BITS, RADIUS, SEED, SHINGLE = 64, 4, 42, 4
#: Fingerprints of a bucket of the first covering that are compared in one place; larger ones are covered again.
BUCKET = 2048
#: Buckets of so many are never covered again, whatever the caller asks.
SMALLEST = 128
#: Radius up to which two coverings of 64 bits leave 16 bits free at most.
MOST_RADIUS = 4


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The fingerprint of one UTF-8 text as a signed 64-bit integer; no words: zero."""
    import xxhash

    words = text.lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    hash_of = xxhash.xxh64_intdigest
    if len(words) <= size:
        hashes = np.array([hash_of(joined, SEED)], dtype="<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        spans = zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1:] - 1).tolist(), strict=True)
        hashes = np.array([hash_of(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at:at + (1 << 16)]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and fp of each row; a null text counts as empty."""
    df, at = by_position(docs)
    text = F.coalesce(F.col(at[text_col]).cast("string"), F.lit(""))
    df = df.select(F.col(at[id_col]).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = pa.array([fingerprint(x.as_py()) for x in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), found], ["doc_id", "text_hash", "fp"])

    return df.mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """Masks over the given bits; under some mask any ``radius`` of them are all left out."""
    vectors = (1 << (radius + 1)) - 1
    vector_of = {bit: 1 + k % vectors for k, bit in enumerate(bits)}
    return [sum(1 << b for b, a in vector_of.items() if (a & v).bit_count() % 2) for v in range(1, vectors + 1)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def forest(members: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that span the components of the members under distance <= radius.

    A member is compared with those that no link has reached yet, so close groups,
    which are soon reached, cost little.
    """
    left = np.unique(members).view(np.uint64)
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            at = stack.pop()
            near = np.bitwise_count(left ^ at) <= radius
            reached, left = left[near], left[~near]
            stack += list(reached)
            for k in reached.view(np.int64).tolist():
                yield int(at.view(np.int64)), k


def finer_masks(masks: list[int], radius: int) -> list[int]:
    """For each mask of the first covering those of a second one over the bits that it leaves free."""
    return [shared | m for shared in masks for m in covering_masks([b for b in range(BITS) if not shared >> b & 1], radius)]


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all that are within radius (0 to 4).

    Two levels at most: buckets of the first covering, and for those over ``bucket``
    the buckets of the second one, which are small by construction.
    """
    if not 0 <= radius <= MOST_RADIUS:
        raise ValueError(f"radius must be from 0 to {MOST_RADIUS}")
    bucket = max(bucket, SMALLEST)
    masks = covering_masks(list(range(BITS)), radius)
    tables = F.array(*[F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)])
    rows = distinct.select("fp", F.explode(tables).alias("x")).select("fp", "x.table", "x.key")
    counts = _counted(rows)
    small = rows.join(counts.where((F.col("n") > 2) & (F.col("n") <= bucket)).select("table", "key"), ["table", "key"])
    more = small.groupBy("table", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_spanning(radius), PAIR)
    found = _pairs(counts, radius).union(more)
    hot = counts.where(F.col("n") > bucket).select("table", "key")
    if hot.take(1):
        finer = _finer(rows.join(hot, ["table", "key"]).select("fp", "table"), finer_masks(masks, radius), len(masks))
        rows = saved(finer)
        counts = _counted(rows)
        large = rows.join(counts.where("n > 2").select("table", "key"), ["table", "key"])
        # one bucket at a time in memory, 65,536 rows at most
        found = found.union(_pairs(counts, radius)).union(large.groupBy("table", "key").applyInArrow(_spanning_one(radius), PAIR))
    return saved(found.distinct())


PAIR = "a long, b long"


def _counted(rows: DataFrame) -> DataFrame:
    """Buckets of several fingerprints with their size and the least and greatest of them."""
    return saved(rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))


def _pairs(counts: DataFrame, radius: int) -> DataFrame:
    """The links of buckets of two, which need no comparison in a task."""
    return counts.where(F.col("n") == 2).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")


def _as_batch(pairs):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def _spanning(radius):
    def run(batches):
        for batch in batches:
            yield _as_batch([p for x in batch.column("fps") for p in forest(x.values.to_numpy(zero_copy_only=False), radius)])

    return run


def _spanning_one(radius):
    def run(bucket):
        import pyarrow as pa

        members = bucket.column("fp").to_numpy()
        return pa.Table.from_batches([_as_batch(list(forest(members, radius)))])

    return run


def _finer(rows: DataFrame, masks: list[int], times: int) -> DataFrame:
    """Each row under the finer masks of its table."""
    all_masks = np.array([signed(m) for m in masks], dtype=np.int64)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                fp, table = (part.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "table"))
                fine = (table[:, None] * times + np.arange(times)).ravel().astype(np.int32)
                fp = np.repeat(fp, times)
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(fine), pa.array(fp & all_masks[fine])], ["fp", "table", "key"])

    return rows.mapInArrow(run, "fp long, table int, key long")


def components(edges: DataFrame) -> DataFrame:
    """node and the least node it is connected to, for every node of the edges (a, b) but roots.

    Alternating large-star and small-star steps until nothing changes; each step is
    aggregated joins, and its result is written to the shared folder.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = saved(moved.union(lower.select("u", F.col("m").alias("v"))).distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """doc_id, text_hash, fp, fingerprint, component_id and first (its id and text) of each row.

    component_id is the smallest id reachable over links; null ids count only where a
    component has no other, whose component_id is null. Rows without words have
    fingerprint zero and link like others. Repeated rows share a fingerprint. Empty
    table: empty result.
    """
    rows = saved(fingerprints(docs, id_col, text_col))
    kind = rows.schema["doc_id"].dataType.simpleString()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))).alias("first")
    distinct = saved(rows.groupBy("fp").agg(first))
    root = distinct.join(components(links(distinct, radius, bucket)), distinct["fp"] == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    root = saved(root)
    top = root.groupBy("root").agg(F.min("first").alias("first"))
    of_fp = root.select("fp", "root").join(top, "root").select("fp", "first")
    return rows.join(of_fp, "fp").select(
        "doc_id", "text_hash", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("first.id").cast(kind).alias("component_id"), F.col("first.hash").alias("first_hash"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs less all but one of each component: the one with the smallest id."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash"))).select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")).distinct()
    df, at = by_position(docs)
    df = df.withColumn("t_hash", F.xxhash64(F.coalesce(F.col(at[text_col]).cast("string"), F.lit(""))))
    df = df.join(kept, F.col(at[id_col]).eqNullSafe(F.col("k_id")) & (F.col("t_hash") == F.col("k_hash")), "left_semi")
    # repeated rows: one stays
    same = Window.partitionBy(at[id_col], "t_hash").orderBy("t_hash")
    return back(df.withColumn("nth", F.row_number().over(same)).where("nth = 1"), docs.columns)
