"""WARC archives with per-record Zstandard frames and an embedded dictionary (operator 4).

Each write task trains a dictionary on a bounded sample of its first records, opens every archive with a skippable frame
that holds it (magic 0x184D2A5D, as in the WARC/Zstandard proposal), and compresses each record as a frame of its own, so
a reader can start at any record. Archives are rolled at ``archive_bytes`` of records. A task names its files by attempt
and returns a manifest; only files in the stored manifest count, so lost or repeated attempts leave nothing to read.

Payloads equal to that of a page with a larger id become revisit records that refer to it. Which page that is comes from
digests alone: payloads are shuffled once, by page id, never by digest.

Cases: null payloads are empty; empty payloads are deduplicated like others unless ``least_bytes`` says more; of repeated
rows (same id and payload) each is written, and is a response if its id is the largest; pages with a null id are written
and never referred to unless all equal ones have none; an empty table writes no archive and returns no rows; further
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pagemill.session import materialise, ship_code, workspace

DICTIONARY_MAGIC = 0x184D2A5D
MANIFEST = "archive string, records long, bytes long, dictionary_bytes long"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. Revisits carry no payload; their headers name the payload they stand for."""
    name = lambda n: f"<urn:page:{'' if n is None else n}>"
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    body = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block, of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def _train(sample: list[bytes], size: int) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, sample).as_bytes()
    except zstandard.ZstdError:  # too little to train on
        return b""


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _write(folder: str, archive_bytes: int, sample_bytes: int, dictionary_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        files, root = _open(folder)
        task, rolled = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}", 0
        dictionary: bytes | None = None
        held: list[bytes] = []
        size = 0
        done: list[tuple] = []

        def roll() -> None:
            nonlocal held, size, rolled, dictionary
            if not held:
                return
            if dictionary is None:
                sample, taken = [], 0
                for raw in held:
                    if (taken := taken + len(raw)) > sample_bytes:
                        break
                    sample.append(raw)
                dictionary = _train(sample, dictionary_bytes)
            extra = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
            packer = zstandard.ZstdCompressor(level=level, **extra)
            name, written = f"{task}-{rolled:04d}.warc.zst", 0
            with files.open_output_stream(f"{root}/{name}") as out:
                written += out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary) or 0
                for raw in held:
                    written += out.write(packer.compress(raw)) or 0
            done.append((f"{folder}/{name}", len(held), written, len(dictionary)))
            held, size, rolled = [], 0, rolled + 1

        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*(batch.column(k) for k in range(5)), strict=True):
                payload = (html.as_py() or "").encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                held.append(record(page_id.as_py(), url.as_py(), payload, digest, refers_to.as_py(), revisit.as_py()))
                if (size := size + len(held[-1])) >= archive_bytes:
                    roll()
        roll()
        columns = zip(*done, strict=True) if done else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["archive", "records", "bytes", "dictionary_bytes"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, archive_bytes: int = 16 << 20, sample_bytes: int = 4 << 20, dictionary_bytes: int = 64 << 10, level: int = 3) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder`` (default: a new one in the shared folder).

    Returns the stored manifest: archive, records, bytes, dictionary_bytes. ``folder`` is a URI that Arrow can open.
    """
    spark = pages.sparkSession
    ship_code(spark)
    folder = folder or workspace(spark, "warc")
    files, root = _open(folder)
    files.create_dir(root, recursive=True)

    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.unhex(F.sha1(html.cast("binary"))).alias("digest"), (F.octet_length(html) >= least_bytes).alias("shares"))
    rows = materialise(rows.distinct(), "payload-digests")
    last = rows.where("shares").groupBy("digest").agg(F.max("page_id").alias("last_id"))
    older = rows.where("shares").join(last, "digest").where("page_id < last_id or (page_id is null and last_id is not null)")
    older = older.select(F.col("page_id").alias("old_id"), F.col("digest").alias("old_digest"), F.col("last_id").alias("refers_to"))
    own = pages.select("page_id", "url", "html")
    digest = F.unhex(F.sha1(html.cast("binary")))
    marked = own.join(older.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("old_id")) & (digest == F.col("old_digest")), "left")
    marked = marked.select("page_id", "url", "html", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))
    return materialise(marked.mapInArrow(_write(folder, archive_bytes, sample_bytes, dictionary_bytes, level), MANIFEST), "warc-manifest")


def frames(stream: io.RawIOBase, read_bytes: int = 1 << 20) -> Iterator[bytes]:
    """The records of one archive, in order, holding one at a time."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    dictionary = stream.read(size)
    extra = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if size else {}
    unpacker = zstandard.ZstdDecompressor(**extra)
    data = stream.read(read_bytes)
    while data:
        one, parts = unpacker.decompressobj(), []
        while True:
            parts.append(one.decompress(data))
            data = one.unused_data if one.eof else stream.read(read_bytes)
            if one.eof:
                break
            if not data:
                raise ValueError("the archive ends within a record")
        yield b"".join(parts)
        data = data or stream.read(read_bytes)


RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives that ``manifest`` names; each archive is read by one task, a record at a time."""
    ship_code(manifest.sparkSession)

    def page(name: str | None) -> int | None:
        found = (name or "").removeprefix("<urn:page:").removesuffix(">")
        return int(found) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                files, path = _open(archive)
                rows, size = [], 0
                with files.open_input_stream(path) as stream:
                    for raw in frames(stream):
                        h, block = parse(raw)
                        if h["warc-type"] == "response" and base64.b32encode(hashlib.sha1(block).digest()).decode() != h["warc-payload-digest"].removeprefix("sha1:"):
                            raise ValueError(f"{archive}: a payload doesn't match its digest")
                        rows.append((page(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:"), page(h.get("warc-refers-to")), block if with_payload else None))
                        if (size := size + len(block)) > 4 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return manifest.select("archive").repartition("archive").mapInArrow(run, RECORDS)
