"""WARC archives with records compressed one by one against a shared dictionary.

Each archive starts with a skippable frame that embeds a Zstandard dictionary
built from a bounded sample of the archive's own records; every record is a
frame of its own. An archive is written under a name of its task attempt and
then renamed, so a repeated task replaces what an earlier one wrote.

Archives lie in the folder that ``spark.checkpoint.dir`` names (or another
shared one). Local paths are opened directly, other schemes by
``pyarrow.fs``; Spark has no writer for raw bytes.
"""

from __future__ import annotations

import hashlib
import io
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shelf, attach_group, small_batches, table

#: Payloads from this size on are stored once; repeats become revisits.
REVISIT_BYTES = 1000
#: The dictionary's size, and the bytes of records that it is built from at most.
DICT_BYTES, SAMPLE_BYTES = 32 << 10, 4 << 20
#: An archive is closed when it holds so many compressed bytes.
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
DICT_MAGIC = 0x184D2A5D
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def parse_uri(uri: str):
    """A function that opens paths, one that renames, and the path of a uri."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file" or "://" not in uri and not uri.startswith("file:"):
        path = "/" + rest.lstrip("/") if scheme == "file" else uri
        return open, os.replace, lambda d: os.makedirs(d, exist_ok=True), path
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return (lambda p, mode: store.open_output_stream(p) if "w" in mode else store.open_input_stream(p)), store.move, lambda d: store.create_dir(d), path


def record_id(kind: str, page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind} {page_id} {digest}')}>"


def record(page: dict) -> bytes:
    """One WARC record: headers, and for a response the payload."""
    payload = page["payload"] if page["record_type"] == "response" else b""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {page['record_type']}",
        f"WARC-Record-ID: {record_id(page['record_type'], page['page_id'], page['digest'])}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{page['digest']}",
        f"X-Payload-Length: {page['size']}",
    ]
    if page["page_id"] is not None:
        lines.append(f"X-Page-Id: {page['page_id']}")
    if page["url"]:
        lines.append("WARC-Target-URI: " + page["url"].replace("\r", "%0D").replace("\n", "%0A"))
    if page["record_type"] == "revisit":
        lines += [
            f"WARC-Refers-To: {record_id('response', page['refers_to'], page['digest'])}",
            f"X-Refers-To-Page-Id: {page['refers_to']}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    lines += ["Content-Type: text/html", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + payload + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields | {"payload": rest[: int(fields["Content-Length"])]}


def build_dictionary(sample: list[bytes]) -> bytes:
    """A dictionary from records; with too few of them, their bytes themselves."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, sample, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICT_BYTES]


class Archive:
    def __init__(self, uri: str, sample: list[bytes]):
        self.opened, self.rename, make, self.path = parse_uri(uri)
        make(self.path.rsplit("/", 1)[0])
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        raw = build_dictionary(sample)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        self.out = self.opened(self.temporary, "wb")
        self.out.write(struct.pack("<II", DICT_MAGIC, len(raw)) + raw)
        self.size = self.records = 0

    def add(self, raw: bytes) -> None:
        frame = self.compressor.compress(raw)
        self.out.write(frame)
        self.size += len(frame)
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        self.rename(self.temporary, self.path)
        return self.path, self.records, self.size


def write_records(pages: Iterator[dict], base: str, name: str) -> Iterator[tuple[str, int, int]]:
    """Archives of some pages: uri, records, compressed bytes. Memory holds a sample at most."""
    archive, held, size, n = None, [], 0, 0

    def begin() -> Archive:
        nonlocal n
        n += 1
        return Archive(f"{base}/{name}-{n:05d}.warc.zst", held)

    for page in pages:
        raw = record(page)
        if archive is None:
            held.append(raw)
            size += len(raw)
            if size < SAMPLE_BYTES:
                continue
            archive = begin()
            for x in held:
                archive.add(x)
            held, size = [], 0
        else:
            archive.add(raw)
        if archive.size >= ARCHIVE_BYTES:
            _, records, written = archive.close()
            yield f"{base}/{name}-{n:05d}.warc.zst", records, written
            archive = None
    if archive is None and held:
        archive = begin()
        for x in held:
            archive.add(x)
    if archive is not None:
        _, records, written = archive.close()
        yield f"{base}/{name}-{n:05d}.warc.zst", records, written


def read_records(uri: str) -> Iterator[dict]:
    """The records of an archive, one after another."""
    opened, _, _, path = parse_uri(uri)
    with opened(path, "rb") as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != DICT_MAGIC:
            raise ValueError(f"{uri}: no dictionary frame")
        raw = f.read(size)
        context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        rest = b""
        while True:
            frame = context.decompressobj()
            out = io.BytesIO()
            while not frame.eof:
                rest = rest or f.read(1 << 20)
                if not rest:
                    if out.tell():
                        raise ValueError(f"{uri}: cut short")
                    return
                out.write(frame.decompress(rest))
                rest = frame.unused_data if frame.eof else b""
            yield parse(out.getvalue())


def plan_records(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Each page with payload, size, digest, record_type and refers_to.

    Null payloads are empty. Of equal payloads of ``revisit_bytes`` or more the
    page with the largest key is the response; rows that repeat that key with
    that payload are responses too. Payloads move once.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.select("*", F.length("payload").cast("long").alias("size"), F.sha1("payload").alias("digest"), F.sha2("payload", 256).alias("__s"))
    # Small payloads are all responses: each is a group of its own.
    alone = F.when(F.col("size") < revisit_bytes, F.coalesce(F.col("page_id"), F.lit(-1))).otherwise(F.lit(-1))
    rows = rows.withColumn("__g", F.when(F.col("size") >= revisit_bytes, F.col("__s")).otherwise(F.concat_ws(":", F.lit("small"), alone.cast("string"), F.col("__s"))))
    told = attach_group(rows.drop("__s"), ["__g"], ["page_id"], {"__keep": ("max", "page_id")})
    revisit = (F.col("size") >= revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("__keep"))
    return told.select("page_id", "url", "payload", "size", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("__keep")).alias("refers_to"))


def write_archives(planned: DataFrame, base: str) -> DataFrame:
    """Write the records that ``plan_records`` made; a lazy table of uri, records, bytes.

    Without records nothing is written and the table is empty.
    """
    small_batches(planned.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():06d}"
        done = list(write_records((p for b in batches for k in range(b.num_rows) for p in b.slice(k, 1).to_pylist()), base, name))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["uri", "records", "bytes"])

    return planned.mapInArrow(run, "uri string, records long, bytes long")


def read_archives(archives: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """The records of the archives in column ``uri``, read again and verified.

    page_id, payload_bytes and payload_digest are of the full payload: a response's are
    computed from what was read and must equal its headers; a revisit's are its headers'.
    Without archives there are no records.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]

    def row(r: dict) -> tuple:
        size, digest = int(r["X-Payload-Length"]), r["WARC-Payload-Digest"].removeprefix("sha1:")
        if r["WARC-Type"] == "response":
            if (len(r["payload"]), hashlib.sha1(r["payload"]).hexdigest()) != (size, digest):
                raise ValueError(f"payload differs from its headers: {r['WARC-Record-ID']}")
        page, to = r.get("X-Page-Id"), r.get("X-Refers-To-Page-Id")
        return (int(page) if page is not None else None, r.get("WARC-Target-URI"), size, digest, r["WARC-Type"], int(to) if to is not None else None, r["payload"])[: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                held, size = [], 0
                for r in read_records(uri):
                    held.append(row(r))
                    size += len(r["payload"]) * with_payload + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return archives.select("uri").mapInArrow(run, T.StructType.fromDDL(schema))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to archives in the shared folder and read them back."""
    shelf = Shelf(spark)
    manifest = shelf.put(write_archives(plan_records(table(spark, sf_dir, "pages")), f"{shelf.base}/archives"), "manifest")
    # One archive is one task's work, so the list of archives is dealt out again.
    back = read_archives(manifest.repartition(max(1, manifest.count())))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT h, max(page_id) AS keep FROM p WHERE n >= 1000 GROUP BY h)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN g.keep IS NULL OR g.keep = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.keep <> p.page_id THEN g.keep END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h AND p.n >= 1000""",
}
