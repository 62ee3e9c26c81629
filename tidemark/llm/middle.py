"""Fill-in-the-middle transformation by secondary sort: pieces keyed by document and output position, streamed into digests.

A text is cut into units, ``[A-Za-z]+|[^A-Za-z]``. Two cuts, drawn by hash from the id, part it into prefix, middle and
suffix, and a third draw picks the form: ``plain`` (the text), ``psm`` (<P>prefix<S>suffix<M>middle) or ``spm``
(<S>suffix<P>prefix<M>middle). The map side never builds the output: it goes through the text and emits chunks of whole
units, of some CHUNK bytes, with the key of their document and their position in the output; the first chunk of a section
carries its mark. One shuffle by key with a sort
inside the partitions (``repartition`` and ``sortWithinPartitions``, the DataFrame form of repartitionAndSortWithinPartitions)
brings each output in order, and a stream over it keeps one digest and a few bytes, however long the text.

Restoration goes by output and form alone: the stream finds the marks in the output, calls what lies between them prefix,
middle or suffix, and a second sort inside the same partitions, without a shuffle, puts the sections in their order.

Rows: a document is known by its id and the SHA-256 of its text, and rows alike in both have one output, which is made
once and counted as often as they occur. That key depends on the row alone, so that a task that runs again emits the same
pieces. A null text is empty and plain. A null id is hashed as the empty string. Other columns play no part, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_bytes, ship

MARKS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
PLAIN_PERCENT = 10  # of the texts that could be transformed
SPM_PERCENT = 20  # of those that are
SALT = "1"
CHUNK = 256 << 10
SLOT = 1 << 40  # positions of a section
ORDERS = {"psm": "PSM", "spm": "SPM"}
_MARK = re.compile(rb"<[PSM]>")
PIECES = "doc_id long, key binary, at long, form string, n long, prefix_chars long, middle_chars long, piece binary"


def draws(doc_id: int | None, salt: str = SALT) -> list[int]:
    """Four 32-bit draws from the id."""
    h = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(h[k:k + 4], "big") for k in (0, 4, 8, 12)]


def unit_starts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets at which units start, of all code points) of a UTF-8 text."""
    b = np.frombuffer(text, np.uint8)
    low = b | 0x20
    letter = (low >= 97) & (low <= 122)
    code_point = (b & 0xC0) != 0x80
    inside = np.zeros(len(b), bool)
    inside[1:] = letter[1:] & letter[:-1]
    return np.flatnonzero(code_point & ~inside), np.flatnonzero(code_point)


def plan(doc_id: int | None, text: bytes, salt: str = SALT) -> tuple[str, int, int, int, int, int]:
    """(form, units, bytes of the prefix, bytes up to the suffix, code points of prefix and of middle)."""
    h = draws(doc_id, salt)
    units, points = unit_starts(text)
    n = len(units)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    ends = [int(units[k]) if k < n else len(text) for k in (lo, hi)]
    if not text or _MARK.search(text) or h[2] % 100 >= 100 - PLAIN_PERCENT:
        return "plain", n, 0, 0, 0, 0
    chars = np.searchsorted(points, ends)
    return ("spm" if h[3] % 100 < SPM_PERCENT else "psm"), n, *ends, int(chars[0]), int(chars[1] - chars[0])


def text_pieces(text: bytes, form: str, first: int, second: int) -> Iterator[tuple[int, bytes]]:
    """(position in the output, piece) of all pieces, in the order of the text."""
    units = unit_starts(text)[0] if len(text) > CHUNK else None
    spans = [("P", 0, first), ("M", first, second), ("S", second, len(text))] if form != "plain" else [("", 0, len(text))]
    for name, lo, hi in spans:
        at = ORDERS[form].index(name) * SLOT if name else 0
        head = MARKS.get(name, b"")
        while True:
            end = hi
            if hi - lo > CHUNK:
                end = int(units[np.searchsorted(units, lo + CHUNK, "right") - 1])
                end = end if end > lo else lo + CHUNK  # one unit longer than a chunk
            yield at, head + text[lo:end]
            lo, at, head = end, at + 1, b""
            if lo >= hi:
                break


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salt: str = SALT) -> DataFrame:
    """The outputs as pieces (``PIECES``), all of a document in one partition and in order of ``at``; form and counts ride on the first."""
    ship(docs.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "t"):
            rows: list[tuple] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist()):
                t = t or b""
                key = hashlib.sha256(t).digest()[:16]
                form, n, first, second, prefix, middle = plan(i, t, salt)
                about = (form, n, None, None) if form == "plain" else (form, n, prefix, middle)
                rows += [(i, key, at, *(about if at == 0 else (None,) * 4), p) for at, p in text_pieces(t, form, first, second)]
            yield _batch(rows, _KINDS)

    cut = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).mapInArrow(emit, PIECES)
    return cut.repartition("doc_id", "key").sortWithinPartitions("doc_id", "key", "at")


_KINDS = [("doc_id", pa.int64()), ("key", pa.binary()), ("at", pa.int64()), ("form", pa.string()), ("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("piece", pa.binary())]
_SECTIONS = [("doc_id", pa.int64()), ("key", pa.binary()), ("section", pa.int32()), ("at", pa.int64()), ("copies", pa.int64()), ("form", pa.string()), ("n", pa.int64()), ("prefix_chars", pa.int64()),
             ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("piece", pa.binary())]
_REPORT = [(c, k) for c, k in _SECTIONS if c not in ("key", "section", "at", "piece", "copies")] + [("restored_sha256", pa.string())]


def _batch(rows: list[tuple], kinds: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(cols, kinds)], [c for c, _ in kinds])


def _schema(kinds: list) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{c} {names[k]}" for c, k in kinds)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in by_bytes(batches, "piece", most=1 << 20):
        yield from zip(*[c.to_pylist() for c in b.columns])


class Restorer:
    """Finds the sections of an output that comes in pieces: yields (section, bytes), 0 prefix, 1 middle, 2 suffix."""

    def __init__(self, form: str):
        self.marks, self.section, self.tail = list(ORDERS.get(form, "")), 0, b""

    def feed(self, data: bytes, last: bool = False) -> Iterator[tuple[int, bytes]]:
        data = self.tail + data
        self.tail = b""
        while self.marks:
            mark = MARKS[self.marks[0]]
            k = data.find(mark)
            if k < 0:
                break
            if k:
                yield self.section, data[:k]
            data, self.section = data[k + 3:], "PMS".index(self.marks.pop(0))
        if self.marks and not last:  # a mark may be cut here
            data, self.tail = data[:-2], data[-2:]
        if data:
            yield self.section, data


def sections(outputs: DataFrame) -> DataFrame:
    """Reads ``pieces`` as a stream: the digest of each output, and its sections found by the marks, as pieces.

    Columns of ``_SECTIONS``: pieces carry section and ``at``; a last row per document (section 3) its digest and how many
    rows are alike (``copies``). Sorted by (document, section, at) inside the partitions of ``outputs``, without a shuffle.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        now, about = None, None

        def put(found):
            nonlocal at, size
            for section, data in found:
                rows.append((*now, section, at, None, None, None, None, None, None, data))
                at += 1
                size += len(rows[-1][-1])

        def close():
            put(restorer.feed(b"", True))
            rows.append((*now, 3, 0, copies, *about, digest.hexdigest(), None))

        for i, key, k, form, n, prefix, middle, piece in _rows(batches):
            if (i, key) != now:
                if now is not None:
                    close()
                now, about, copies, at, last = (i, key), (form, n, prefix, middle), 0, 0, -1
                digest, restorer = hashlib.sha256(), Restorer(form)
            if k == 0:
                copies += 1
            if k != last:  # rows alike repeat each piece
                last = k
                digest.update(piece)
                put(restorer.feed(piece))
            if size > 4 << 20 or len(rows) > 20_000:
                yield _batch(rows, _SECTIONS)
                rows.clear()
                size = 0
        if now is not None:
            close()
            yield _batch(rows, _SECTIONS)

    return outputs.mapInArrow(read, _schema(_SECTIONS)).sortWithinPartitions("doc_id", "key", "section", "at")


def report(found: DataFrame) -> DataFrame:
    """Reads ``sections`` as a stream: a row per row of the input, with the digest of the restored text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, out = hashlib.sha256(), []
        for i, _, section, _, copies, form, n, prefix, middle, output, piece in _rows(batches):
            if section < 3:
                digest.update(piece)
                continue
            out += [(i, form, n, prefix, middle, output, digest.hexdigest())] * copies
            digest = hashlib.sha256()
            if len(out) > 10_000:
                yield _batch(out, _REPORT)
                out = []
        yield _batch(out, _REPORT)

    return found.mapInArrow(read, _schema(_REPORT))


def joined(chunks: DataFrame) -> DataFrame:
    """The whole texts of ``pieces`` (outputs) or ``sections`` (restored): doc_id, key, copies and ``text``, one row per distinct document."""
    restored = "section" in chunks.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, copies, last = None, [], 0, -1
        kinds = [("doc_id", pa.int64()), ("key", pa.binary()), ("copies", pa.int64()), ("text", pa.string())]
        row = lambda: _batch([(*now, copies, b"".join(held).decode())], kinds)
        for r in _rows(batches):
            if r[:2] != now:
                if now is not None:
                    yield row()
                now, held, copies, last = r[:2], [], 0, -1
            if restored:
                if r[2] == 3:
                    copies = r[4]
                else:
                    held.append(r[-1])
            else:
                copies += r[2] == 0
                if r[2] != last:
                    last = r[2]
                    held.append(r[-1])
        if now is not None:
            yield row()

    return chunks.mapInArrow(read, "doc_id long, key binary, copies long, text string")


def middle_report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of output and restored text, for each row."""
    return report(sections(pieces(docs))).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
