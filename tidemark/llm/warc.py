"""WARC archives compressed record by record with a shared Zstandard dictionary.

A dictionary is built from a bounded sample of records, stored in a leading skippable frame of every archive (magic
0x184D2A5D, then the dictionary), and each record is one Zstandard frame of its own, so that a reader can start at any
record. Records with equal payloads (SHA-256 and length) are written once: the one with the largest page id is the
response, the others are revisit records that refer to it. Each task rolls over to a new archive at ``ROLL_BYTES``;
the table of archives (a row each) is the only thing that counts as written, so a task that runs again leaves
files that no row names.

Defined cases: a null html is the empty payload; a null url leaves the target out. Every row that holds the largest page
id of its payload is a response (rows may repeat), and so is every row where no row of the payload has an id. Rows with
a null id revisit the largest id. Payloads of fewer than ``min_bytes`` bytes are always responses. An empty table makes no archive.
Columns other than page_id, url and html play no part, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import filesystem, fixed, hash_sample, new_folder, ship

SKIPPABLE = 0x184D2A5D  # fixed value of the format: frame that holds the dictionary
DICT_BYTES = 112 * 1024
SAMPLE_RECORDS = 1000
SAMPLE_BYTES = 8 << 20
ROLL_BYTES = 256 << 20  # of compressed records
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(rb"<urn:page:(-?\d+|none-[0-9a-f]+)>")


def digest(payload: bytes) -> str:
    """Bare base32 SHA-1 in capitals."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(value: str) -> bytes:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value).encode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """Bytes of a response record, or of a revisit record if it refers to another page."""
    name = str(page_id) if page_id is not None else f"none-{uuid.uuid4().hex}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if refers_to is not None else b"response"), b"WARC-Record-ID: <urn:page:%s>" % name.encode(), b"WARC-Date: " + date.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _field(url))
    if refers_to is not None:
        head += [b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: " + PROFILE.encode()]
    head += [b"WARC-Payload-Digest: sha1:" + digest(payload).encode(), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record; ``payload`` is None for a revisit. The length and digest of a response are those of its body, and raise if the header differs."""
    top, _, rest = data.partition(b"\r\n\r\n")
    lines = top.split(b"\r\n")
    if lines[0] != b"WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(b": ", 1) for x in lines[1:])
    block = rest[:int(fields[b"Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields[b"WARC-Type"].decode()
    own, target = _ID.fullmatch(fields[b"WARC-Record-ID"])[1], fields.get(b"WARC-Refers-To")
    told = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:"), int(re.search(rb"Content-Length: (\d+)", http)[1])
    if kind == "response" and told != (found := (digest(payload), len(payload))):
        raise ValueError(f"record {own.decode()}: the header tells {told}, the body is {found}")
    return {
        "page_id": None if own.startswith(b"none") else int(own),
        "record_type": kind,
        "refers_to": int(_ID.fullmatch(target)[1]) if target else None,
        "url": fields[b"WARC-Target-URI"].decode() if b"WARC-Target-URI" in fields else None,
        "payload_digest": told[0],
        "payload_bytes": told[1],
        "payload": None if kind == "revisit" else payload,
    }


def build_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary; of too few samples, their plain bytes; of none, nothing."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def with_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and ``refers_to`` (null for responses) of every row."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    own = own.withColumns({"n": F.octet_length("payload"), "h": F.sha2("payload", 256)})
    best = own.where(F.col("n") >= min_bytes).groupBy("h", "n").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("copies"))
    both = own.join(best.where("copies > 1"), ["h", "n"], "left")
    return both.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("best")), F.col("best")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row; a row per archive: ``path`` (full address), ``n_records``, ``n_bytes``."""
    spark = pages.sparkSession
    ship(spark)
    chars = SAMPLE_BYTES // SAMPLE_RECORDS
    some = hash_sample(pages.select("url", F.left(F.coalesce("html", F.lit("")), F.lit(chars)).alias("html")), ["html", "url"], SAMPLE_RECORDS)
    dictionary = build_dictionary([record(0, r.url, r.html.encode(), None, date) for r in some])
    sent = spark.sparkContext.broadcast(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        data = zstandard.ZstdCompressionDict(sent.value) if sent.value else None
        press = zstandard.ZstdCompressor(level=3, write_checksum=True, **({"dict_data": data} if data else {}))
        out, path, n, size, done = None, "", 0, 0, []
        for b in batches:
            for page_id, url, payload, refers_to in zip(*[b.column(k).to_pylist() for k in range(4)]):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                    path = f"{folder.rstrip('/')}/{name}"  # a full address: readers need its scheme
                    out = fs.open_output_stream(f"{root}/{name}")
                    if data:
                        out.write(struct.pack("<II", SKIPPABLE, len(sent.value)) + sent.value)
                frame = press.compress(record(page_id, url, payload, refers_to, date))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= ROLL_BYTES:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "n_records", "n_bytes"), map(list, zip(*done)))))

    return fixed(with_types(pages, min_bytes).mapInArrow(write, "path string, n_records long, n_bytes long"))


def frames(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Records of an open archive one by one; a leading skippable frame gives the dictionary."""
    data, left = None, stream.read(8)
    if len(left) == 8 and struct.unpack("<II", left)[0] == SKIPPABLE:
        data = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<II", left)[1]))
        left = b""
    grow = zstandard.ZstdDecompressor(**({"dict_data": data} if data else {}))
    while True:
        one, parts = grow.decompressobj(), []
        while not one.eof:
            left = left or stream.read(chunk)
            if not left:
                if parts:
                    raise ValueError("archive ends within a record")
                return
            parts.append(one.decompress(left))
            left = one.unused_data if one.eof else b""
        yield b"".join(parts)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the named archives; each archive is read once, as a stream."""
    ship(archives.sparkSession)
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                fs, at = filesystem(path)
                with fs.open_input_stream(at) as f:
                    for data in frames(f):
                        rows.append(parse(data))
                        size += len(data)
                        if size > 16 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)})
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)})

    return archives.select("path").repartition(max(archives.count(), 1), "path").mapInArrow(read, schema)


def archive_report(pages: DataFrame) -> DataFrame:
    """Write all pages and read the archives back: a row per record, without the payload."""
    folder = new_folder(pages.sparkSession, "warc")
    back = read_archives(write_archives(pages.select("page_id", "url", "html"), folder), payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
