"""Token ids in binary files: a shared Zstandard dictionary, one frame per document, an offset index.

Documents are range-partitioned by (id, hash of the text), so file k holds the ids before those of file k + 1. Each task
encodes its documents with the given tokenizer, compresses every document on its own with one dictionary that was
trained on the serialized ids of a bounded sample, and writes a data file with its index at the end. The table of files
(a row each) is the only thing that counts as written: a task that runs twice leaves a file that no row names.

File format, little-endian: the magic ``TIDETOK2`` or ``TIDETOK4``; the SHA-256 of the dictionary (32 bytes); the frames;
the index, five int64 per document: its id, 1 if it has none, frame offset, frame length, number of ids; then the number
of documents (uint64) and the offset of the index (uint64). Ids are serialized as uint16, or uint32 for vocabularies over
65,536. The dictionary is a file beside them, named by its hash; an empty one stands for none (samples too small to train).

Defined cases: a null or empty text is the end id alone. Rows with a null id come after all others and are read back
with a null id. Rows that repeat an id follow one another in the order of their texts' hashes.

Texts are encoded by ``llm/coder.py``, in batches bounded by bytes.

Ids of vocabularies over 65,536 take 32 bits; the data file names their width in its magic, and readers go by that.
Columns of the input other than the id and the text play no part, whatever their names; an empty table makes no files.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.coder import Coder
from tidemark.llm.common import by_bytes, filesystem, fixed, hash_sample, new_folder, ship

MAGIC = {2: b"TIDETOK2", 4: b"TIDETOK4"}  # bytes of an id
READ_BYTES = 4 << 20  # ids that a reader hands on at once
DICT_BYTES = 64 * 1024
SAMPLE_DOCS = 1000  # documents that train the dictionary
SAMPLE_BYTES = 4 << 20
ENTRY = np.dtype([("doc_id", "<i8"), ("no_id", "<i8"), ("offset", "<i8"), ("length", "<i8"), ("n", "<i8")])


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """Bytes of a Zstandard dictionary, empty where the samples do not suffice."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    kw = {"dict_data": d} if d else {}
    return zstandard.ZstdCompressor(level=3, **kw), zstandard.ZstdDecompressor(**kw)


def _sample(docs: DataFrame, text: str, tokenizer: str, end_id: int) -> bytes:
    """Dictionary of a bounded sample: the documents of smallest hash, shortened to keep the sample under its bytes."""
    chars = SAMPLE_BYTES // SAMPLE_DOCS
    rows = hash_sample(docs.select(F.left(F.coalesce(F.col(text), F.lit("")), F.lit(chars)).alias("t")), ["t"], SAMPLE_DOCS)
    enc = Coder(tokenizer)
    return train_dictionary([np.append(x, end_id).astype(enc.kind).tobytes() for x in enc.encode([r.t for r in rows])])


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", order: list | None = None) -> DataFrame:
    """Write all documents; a row per file: ``part``, ``path``, ``n_docs``, ``n_ids``, ``dictionary`` (its hash).

    ``order``: columns that fix the order of the documents; by default the id, then the hash of the text.
    """
    spark = docs.sparkSession
    ship(spark)
    dictionary = _sample(docs, text, tokenizer, end_id)
    name = hashlib.sha256(dictionary).hexdigest()
    fs, root = filesystem(folder)
    with fs.open_output_stream(f"{root}/{name}.dict") as f:
        f.write(dictionary)
    own = docs.select(F.col(doc_id).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"), *[c.alias(f"o{k}") for k, c in enumerate(order or [])])
    by = [F.col(f"o{k}") for k in range(len(order))] if order else [F.col("i").asc_nulls_last(), F.xxhash64("t")]
    placed = own.repartitionByRange(*by).sortWithinPartitions(*by).select(F.spark_partition_id().alias("part"), "i", "t")
    sent = spark.sparkContext.broadcast(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, entries = Coder(tokenizer), None, array("q")
        press = _codec(sent.value)[0]
        for part in by_bytes(batches, "t"):
            if out is None:
                number = part.column(0)[0].as_py()
                path = f"{root}/part-{number:06d}-{uuid.uuid4().hex}.tok"
                out = filesystem(folder)[0].open_output_stream(path)
                out.write(MAGIC[enc.kind.itemsize] + hashlib.sha256(sent.value).digest())
                at = 40
            for i, ids in zip(part.column(1).to_pylist(), enc.encode(part.column(2).to_pylist())):
                frame = press.compress(np.append(ids, np.array([end_id], enc.kind)).tobytes())
                out.write(frame)
                entries.extend((0 if i is None else i, i is None, at, len(frame), len(ids) + 1))
                at += len(frame)
        if out is None:
            return
        index = np.frombuffer(entries, ENTRY)
        out.write(memoryview(index))
        out.write(np.array([len(index), at], "<u8").tobytes())
        out.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int32()), "path": [path], "n_docs": [len(index)], "n_ids": [int(index["n"].sum())], "dictionary": [name]})

    return fixed(placed.mapInArrow(write, "part int, path string, n_docs long, n_ids long, dictionary string"))


def read_index(f) -> np.ndarray:
    """Index of an open data file, for reading single documents."""
    f.seek(f.size() - 16)
    n, at = np.frombuffer(f.read(16), "<u8").tolist()
    f.seek(at)
    return np.frombuffer(f.read(n * ENTRY.itemsize), ENTRY)


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """The documents of the named files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (serialized), ``id_bytes``."""
    ship(files.sparkSession)
    # One row per file, and files are bounded by the number of partitions: the running sum is over that small table.
    placed = files.withColumn("start", F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # A stated number of parts: the table is small, but each row stands for a whole file.
    placed = placed.repartition(max(files.count(), 1), "path").select("path", "start", "dictionary")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for b in batches:
            for path, start, name in zip(*[b.column(k).to_pylist() for k in range(3)]):
                with fs.open_input_file(f"{root}/{name}.dict") as f:
                    dictionary = f.read()
                grow = _codec(dictionary)[1]
                with fs.open_input_file(path) as f:
                    index = read_index(f)
                    f.seek(0)
                    magic = f.read(8)
                    if magic not in MAGIC.values() or f.read(32) != hashlib.sha256(dictionary).digest():
                        raise ValueError(f"{path}: not a token file, or of another dictionary")
                    width = next(k for k, m in MAGIC.items() if m == magic)
                    group = np.cumsum(index["n"] * width) // READ_BYTES
                    cuts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
                    for lo, hi in zip(cuts, [*cuts[1:], len(index)]):
                        e = index[lo:hi]
                        n = e["n"]
                        ids = [grow.decompress(f.read(k), max_output_size=m * width) for k, m in zip(e["length"].tolist(), n.tolist())]
                        begin = start + np.cumsum(n) - n
                        start += int(n.sum())
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(e["doc_id"], mask=e["no_id"] == 1), "start": begin, "n_tokens": n.copy(), "ids": pa.array(ids, pa.binary()),
                            "id_bytes": np.full(len(e), width, np.int32)})

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary, id_bytes int")


def token_report(docs: DataFrame, tokenizer: str, end_id: int = 0, order: list | None = None) -> DataFrame:
    """Write the documents, read the files back: doc_id, start, n_tokens and the CRC-32 of the ids as uint32."""
    folder = new_folder(docs.sparkSession, "tokens")
    files = write_tokens(docs, folder, tokenizer, end_id, order=order)
    back = read_tokens(files, folder)

    def digest(ids: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.frombuffer(x, f"<u{w}").astype("<u4").tobytes()) for x, w in zip(ids, width)], dtype="int64")

    return back.select("doc_id", "start", "n_tokens", F.pandas_udf(digest, "long")("ids", "id_bytes").alias("ids_crc32"))
