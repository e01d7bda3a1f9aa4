"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames of about a megabyte; each file ends with a
seek table (the skippable frame of the seekable format), so a reader finds any frame
without reading the others. The index maps each record id to file, frame and offset in
the frame, which is all that random access needs.
"""

import base64
import hashlib
import struct
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.common import by_position, saved, shared_dir

#: Plain bytes of a frame, and packed bytes after which a task starts another file.
FRAME_BYTES, FILE_BYTES = 1 << 20, 1 << 30
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id {kind}, path string, frame long, offset long, length long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url, payload: bytes, revisit_of=None, is_revisit: bool = False) -> bytes:
    """One record; a revisit keeps the HTTP head (so the payload's length) and no payload."""
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "about:blank")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <{_urn(page_id, payload)}>",
        "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {target}", *([] if page_id is None else [f"X-Page-Id: {quote(str(page_id))}"]),
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
    ]
    if is_revisit:
        lines += [f"WARC-Refers-To: <{_urn(revisit_of, payload)}>", f"X-Refers-To-Page-Id: {quote(str(revisit_of))}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _urn(page_id, payload: bytes) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest_of(payload)}").urn


def parse_records(data: bytes):
    """(offset, length, headers, block) of each record of a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        start = end + 4
        stop = start + int(headers["Content-Length"])
        yield at, stop + 4 - at, headers, data[start:stop]
        at = stop + 4


def what_it_says(headers: dict, block: bytes) -> dict:
    """The facts of a parsed record; a response's digest and length come from its payload."""
    head, _, payload = block.partition(b"\r\n\r\n")
    response = headers["WARC-Type"] == "response"
    declared = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    own = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if response and (digest_of(payload) != own or len(payload) != declared):
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    return {
        "page_id": _unquoted(headers, "X-Page-Id"), "payload_bytes": declared, "payload_digest": own,
        "record_type": headers["WARC-Type"], "refers_to": _unquoted(headers, "X-Refers-To-Page-Id"),
        "payload": payload if response else None,
    }


def _unquoted(headers: dict, name: str) -> str | None:
    return unquote(headers[name]) if name in headers else None


class Bundle:
    """Writes frames to a file object and notes the seek table."""

    def __init__(self, file, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.file, self.limit, self.pack = file, frame_bytes, zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.held, self.size, self.table, self.written = [], 0, [], 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame number and offset in the frame of the record."""
        if self.size and self.size + len(record) > self.limit:
            self.flush()
        place = len(self.table), self.size
        self.held.append(record)
        self.size += len(record)
        return place

    def flush(self):
        if self.held:
            frame = self.pack.compress(b"".join(self.held))
            self.file.write(frame)
            self.table.append((len(frame), self.size))
            self.written += len(frame)
            self.held, self.size = [], 0

    def close(self):
        self.flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        self.file.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), 0, SEEKABLE))
        self.file.close()


def seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame, from the end of the file."""
    file.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * n)
    sizes = struct.iter_unpack("<II", file.read(8 * n))
    out, at = [], 0
    for packed, plain in sizes:
        out.append((at, packed, plain))
        at += packed
    return out


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def frames(path: str):
    """The plain bytes of each frame of a bundle, one frame in memory at a time."""
    import zstandard

    store, name = _store(path)
    with store.open_input_file(name) as file:
        unpack = zstandard.ZstdDecompressor()
        for at, packed, plain in seek_table(file, file.size()):
            file.seek(at)
            yield unpack.decompress(file.read(packed), max_output_size=plain)


def read_record(path: str, frame: int, offset: int, length: int) -> dict:
    """One record by its index entry; reads the seek table and one frame."""
    import zstandard

    store, name = _store(path)
    with store.open_input_file(name) as file:
        at, packed, plain = seek_table(file, file.size())[frame]
        file.seek(at)
        data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)
    _, _, headers, block = next(parse_records(data[offset:offset + length]))
    return what_it_says(headers, block)


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) and returns the index of records.

    Of rows with equal payloads of at least ``min_bytes``, those with the largest
    page_id are responses and the others revisit it; a null html is an empty payload,
    null ids come before all others. Files are named anew by each attempt of a task
    and only files named in the index count, so a lost executor leaves no wrong record.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    df, at = by_position(pages)
    html = F.coalesce(F.col(at["html"]).cast("string"), F.lit(""))
    url = F.col(at["url"]).cast("string") if "url" in at else F.lit(None).cast("string")
    df = df.select(F.col(at["page_id"]).alias("page_id"), url.alias("url"), html.alias("html"))
    kind = df.schema["page_id"].dataType.simpleString()
    digest = F.sha1(F.col("html").cast("binary"))
    slim = df.select("page_id", digest.alias("digest"), F.octet_length("html").alias("size"))
    # payloads of which there is one need no join
    groups = slim.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1 and top is not null").drop("n")
    revisits = slim.join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("top"))).select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "top").distinct()
    rows = df.withColumn("digest", digest).join(revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    rows = rows.select("page_id", "url", "html", "top", (F.col("r_digest").isNotNull()).alias("again")).sortWithinPartitions("page_id", "digest")

    def run(batches):
        import pyarrow as pa

        bundle, path, place = None, "", []
        for batch in batches:
            place = []
            for page, target, text, top, again in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "top", "again")), strict=True):
                if bundle is None:
                    path = f"{folder}/part-{uuid.uuid4().hex}.warc.zst"
                    store, name = _store(path)
                    store.create_dir(name.rpartition("/")[0], recursive=True)
                    bundle = Bundle(store.open_output_stream(name, compression=None))
                elif bundle.written > FILE_BYTES:
                    bundle.close()
                    path = f"{folder}/part-{uuid.uuid4().hex}.warc.zst"
                    bundle = Bundle(_store(path)[0].open_output_stream(_store(path)[1], compression=None))
                data = record_bytes(page, target, text.encode("utf-8"), top, again)
                place.append((page, *bundle.add(data), len(data)))
            yield pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in place], batch.column("page_id").type), pa.array([path] * len(place), pa.string()),
                *[pa.array([x[k] for x in place], pa.int64()) for k in (1, 2, 3)]], ["page_id", "path", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    return saved(rows.mapInArrow(run, INDEX.format(kind=kind)))


def read_archives(index: DataFrame) -> DataFrame:
    """Every record of the files that the index names, read back frame by frame.

    A file is a task's work: the few paths are ranged into as many partitions as there
    are files, which adaptive execution leaves alone.
    """
    kind = index.schema["page_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path in batch.column("path").to_pylist():
                for data in frames(path):
                    found = [what_it_says(h, b) for _, _, h, b in parse_records(data)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([x["page_id"] for x in found], pa.string()), pa.array([x["payload_bytes"] for x in found], pa.int64()),
                        pa.array([x["payload_digest"] for x in found], pa.string()), pa.array([x["record_type"] for x in found], pa.string()),
                        pa.array([x["refers_to"] for x in found], pa.string())],
                        ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    paths = saved(index.select("path").distinct())
    paths = paths.repartitionByRange(max(1, paths.count()), "path")
    out = paths.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return out.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
