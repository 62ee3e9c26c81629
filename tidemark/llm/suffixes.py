"""Exact removal of repeated byte strings by a depth-limited radix sort of suffixes.

A document loses every byte covered by a string of DEPTH bytes that also starts in a document with a smaller id. Suffixes
need to be told apart only through their first DEPTH bytes, so they are ordered by most-significant-digit passes, and
a group is dropped as soon as it lies within one document; groups that are left after the last pass are exactly the
repeated windows. Writing every suffix out would be many times the corpus, so a pass handles windows in runs:

1. Digit: the GRAM bytes at the window's anchor, its gram of smallest hash. An anchor follows from the window's bytes
   alone, so equal windows have equal anchors, and about one position in 14 is the anchor of a run of windows.
2. Digit: all bytes of a run (at most 76). A run that an earlier document holds as a whole is removed as a whole.
3. Digit: the window itself, only for runs that pass 2 left open and whose anchor gram others hold too. Their bytes
   are sorted by gram, and windows are compared within it; the windows of grams with more than LARGE open runs are
   spelled out and aggregated instead, which gives the same.

Pass 1 only filters, by 48 bits; passes 2 and 3 decide by 96 bits. Every pass combines on the map side: of equal digits of
the documents that a task reads, one is sent on, so that a string that a third of all documents hold comes to a
task once from each other task, not once from each document.

Defined cases: a null text is empty. Texts shorter than DEPTH bytes lose nothing. Rows that share an id are one document for
the comparison, so they do not remove each other's bytes. Rows with a null id come after all others, as one document. An
empty table gives no rows. Other columns play no part, whatever their names. Long texts are worked on in pieces of PIECE bytes that overlap by a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Ids, fixed, forget, release, ship
from tidemark.llm.shingles import mix64

DEPTH = 50
GRAM = 24
PIECE = 1 << 20
BUCKET_BYTES = 32 << 20  # of texts per bucket of grams
FLUSH = 2_000_000  # anchors that a task combines before it sends them on
LARGE = 100_000  # open runs with one gram that a task compares in memory
MEET_ROWS = 50_000  # runs compared at a time, more only where one gram has more
_U = np.uint64


def words8(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number."""
    two = raw[:-1].astype(_U) | raw[1:].astype(_U) << _U(8)
    four = two[:-2] | two[2:] << _U(16)
    return four[:-4] | four[4:] << _U(32)


def chain(word: np.ndarray, at: list[np.ndarray], extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96-bit hash of the words at the given positions."""
    with np.errstate(over="ignore"):
        a, b = extra.astype(_U) + _U(3), extra.astype(_U) * _U(0xD6E8FEB86659FD93) + _U(5)
        for x in at:
            w = word[x]
            a, b = mix64((a ^ w) * _U(0x9E3779B97F4A7C15)), mix64((b + w) * _U(0xC2B2AE3D27D4EB4F))
    return a.view(np.int64), (b & _U(0x7FFFFFFF)).astype(np.int32)


class Pieces:
    """Bytes of several texts (or parts of long ones) one after the other, with their windows' anchors."""

    def __init__(self, texts: list[tuple[int, int, bytes]]):
        """``texts``: (number of the row, offset of the piece in its text, bytes)."""
        self.row = np.array([x[0] for x in texts])
        self.offset = np.array([x[1] for x in texts])
        size = np.array([len(x[2]) for x in texts])
        self.end = np.cumsum(size)
        self.start = self.end - size
        raw = np.frombuffer(b"".join(x[2] for x in texts) + bytes(DEPTH + 8), np.uint8)
        self.word = words8(raw)
        n = int(self.end[-1]) if len(texts) else 0
        with np.errstate(over="ignore"):
            m = n + DEPTH - 32
            gram = mix64(self.word[:m] * _U(0x9E3779B97F4A7C15) + self.word[8:8 + m] * _U(0xC2B2AE3D27D4EB4F) + self.word[16:16 + m] * _U(0xD6E8FEB86659FD93))
        self.gram = gram
        key = gram >> _U(24) << _U(24) | np.arange(len(gram), dtype=_U)
        wide = DEPTH - GRAM + 1
        low, have = key, 1
        while have * 2 <= wide:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        low = np.minimum(low[:len(low) - (wide - have)], low[wide - have:])
        piece = np.repeat(np.arange(len(size)), np.maximum(size - DEPTH + 1, 0))
        per = np.maximum(size - DEPTH + 1, 0)
        self.at = np.repeat(self.start - (np.cumsum(per) - per), per) + np.arange(len(piece))  # valid windows
        anchor = (low[self.at] & _U((1 << 24) - 1)).astype(np.int64)
        new = np.ones(len(piece), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(piece)) - 1
        #: Runs of windows with one anchor: piece, first window, windows after it, gram of the anchor.
        self.piece, self.s, self.n = piece[first], self.at[first], last - first
        self.h = gram[anchor[first]].view(np.int64)

    def run_hash(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of all bytes of a run: words from both ends cover its 50 to 76 bytes."""
        s, n = self.s[keep], self.n[keep]
        return chain(self.word, [s + 8 * k for k in range(6)] + [s + n + DEPTH - 8 * k for k in range(1, 5)], n)


def _pieces(texts: list[str | None], size: int = 2 * PIECE) -> Iterator[Pieces]:
    """Rows in turn; a text over PIECE bytes is cut into pieces that share DEPTH - 1 bytes."""
    held, total = [], 0
    for k, t in enumerate(texts):
        data = (t or "").encode()
        for lo in range(0, max(len(data) - DEPTH + 1, 1), PIECE):
            part = data[lo:lo + PIECE + DEPTH - 1]
            if len(part) >= DEPTH:
                held.append((k, lo, part))
                total += len(part)
            if total > size:
                yield Pieces(held)
                held, total = [], 0
    if held:
        yield Pieces(held)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a sorted sequence of keys changes, as flags."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _groups(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Values listed by owner."""
    order = np.argsort(owner, kind="stable")
    first = np.flatnonzero(_starts(owner[order]))
    return owner[order][first], pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(values[order]))


def _low(h: np.ndarray) -> np.ndarray:
    """32 bits of a gram, which suffice to find it again within one document."""
    return (h & _U(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def pack(h: np.ndarray, doc: np.ndarray, told: np.ndarray, ids: np.ndarray) -> bytes:
    """Sorted 48-bit grams with the place of their document in ``ids``, and whether they are known to be shared."""
    used, place = np.unique(doc, return_inverse=True)
    gap = np.diff(h, prepend=_U(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T
    far = np.diff(ids[used], prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T
    at = (place * 2 + told).astype("<u4").view(np.uint8).reshape(-1, 4).T
    body = b"".join(np.ascontiguousarray(x).tobytes() for x in (gap, at, far))
    return np.array([len(h), len(used)], "<u4").tobytes() + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, documents, whether known)."""
    n, m = np.frombuffer(blob[:8], "<u4").tolist()
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:]), np.uint8)
    gap = np.zeros((n, 8), np.uint8)
    gap[:, :6] = body[:6 * n].reshape(6, n).T
    at = np.ascontiguousarray(body[6 * n:10 * n].reshape(4, n).T).view("<u4")[:, 0]
    far = np.ascontiguousarray(body[10 * n:].reshape(8, m).T).view("<i8")[:, 0]
    return np.cumsum(gap.view("<u8")[:, 0]), np.cumsum(far)[at >> 1], (at & 1).astype(bool)


def _grams(buckets: int):
    """Pass 1, map side: anchor grams of many documents at a time.

    Grams of several of them are known to be shared: their documents are told at once (``i``, ``g``), and the gram is
    sent on once. Others are sent with their document. What is sent is packed by bucket of the gram.
    """

    def send(held: list, ids: list) -> Iterator[pa.RecordBatch]:
        ids, number = np.unique(np.array(ids, np.int64), return_inverse=True)
        h = np.concatenate([x[0] for x in held]).view(_U) >> _U(16)
        doc = number[np.concatenate([x[1] for x in held])]
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new = _starts(h, doc)
        h, doc = h[new], doc[new]
        first = np.flatnonzero(_starts(h))
        size = np.diff(np.append(first, len(h)))
        told = np.repeat(size > 1, size)
        if told.any():
            owner, lists = _groups(doc[told], _low(h[told]))
            yield _rows(len(owner), b=(owner % buckets).astype(np.int32), i=ids[owner], g=lists)
        h, doc, told = h[first], doc[first], size > 1
        bucket = (h % _U(buckets)).astype(np.int32)
        order = np.lexsort((h, bucket))
        cut = np.flatnonzero(_starts(bucket[order]))
        for lo, hi in zip(cut, [*cut[1:], len(order)]):
            k = order[lo:hi]
            yield _rows(1, b=bucket[k[:1]], blob=[pack(h[k], doc[k], told[k], ids)])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, total = [], [], 0
        for b in batches:
            base = len(ids)
            ids += b.column("i").to_pylist()
            for p in _pieces(b.column("t").to_pylist()):
                held.append((p.h, base + p.row[p.piece]))
                total += len(p.h)
            if total > FLUSH:
                yield from send(held, ids)
                held, ids, total = [], [], 0
        if total:
            yield from send(held, ids)

    return grams


def _rows(n: int, **cols) -> pa.RecordBatch:
    """A batch of (b, i, g, blob) with nulls for what is not given."""
    kinds = {"b": pa.int32(), "i": pa.int64(), "g": pa.list_(pa.int32()), "blob": pa.binary()}
    return pa.RecordBatch.from_pydict({k: (cols[k].cast(t) if isinstance(cols[k], pa.Array) else pa.array(cols[k], t)) if k in cols else pa.nulls(n, t) for k, t in kinds.items()})


def _answers(buckets: int):
    """Pass 1, reduce side: which documents hold which shared grams, a bucket of grams at a time.

    The pairs are packed by bucket (``d``) of the document, so that what is sent does not grow with documents x buckets.
    """

    def packed(doc: np.ndarray, low: np.ndarray) -> Iterator[pa.RecordBatch]:
        d = (mix64(doc.view(_U)) % _U(buckets)).astype(np.int32)
        order = np.lexsort((doc, d))
        doc, low, d = doc[order], low[order], d[order]
        cut = np.flatnonzero(_starts(d))
        press = zstandard.ZstdCompressor(level=1)
        for lo, hi in zip(cut, [*cut[1:], len(d)]):
            gap = np.diff(doc[lo:hi], prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T
            yield pa.RecordBatch.from_pydict({"d": d[lo:lo + 1], "pairs": [press.compress(np.ascontiguousarray(gap).tobytes() + low[lo:hi].tobytes())]})

    def answer(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        h, doc, told = [np.concatenate(x) for x in zip(*map(unpack, blobs))]
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(_starts(h[order]))
        size = np.diff(np.append(first, len(h)))
        shared = np.repeat((size > 1) | np.logical_or.reduceat(told[order], first), size) & ~told[order]
        yield from packed(doc[order][shared], _low(h[order][shared]))

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        known: list[tuple[np.ndarray, np.ndarray]] = []
        at, total = None, 0
        for b in batches:
            told = b.filter(pc.is_valid(b.column("i")))
            if told.num_rows:
                size = pc.list_value_length(told.column("g")).to_numpy()
                known.append((np.repeat(told.column("i").to_numpy(), size), told.column("g").flatten().to_numpy()))
                total += size.sum()
            if total > FLUSH:
                yield from packed(*[np.concatenate(x) for x in zip(*known)])
                known, total = [], 0
            sent = b.filter(pc.is_valid(b.column("blob")))
            for bucket, blob in zip(sent.column("b").to_pylist(), sent.column("blob").to_pylist()):
                if bucket != at and blobs:
                    yield from answer(blobs)
                    blobs = []
                at = bucket
                blobs.append(blob)
        if known:
            yield from packed(*[np.concatenate(x) for x in zip(*known)])
        if blobs:
            yield from answer(blobs)

    return answers


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (``i``) with all their shared grams (``g``), a bucket of documents at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    at = None

    def lists() -> pa.RecordBatch:
        doc, low = [np.concatenate(x) for x in zip(*held)]
        owner, values = _groups(doc, low)
        return pa.RecordBatch.from_pydict({"i": owner, "g": values})

    grow = zstandard.ZstdDecompressor()
    for b in batches:
        for d, pairs in zip(b.column("d").to_pylist(), b.column("pairs").to_pylist()):
            if d != at and held:
                yield lists()
                held = []
            at = d
            body = np.frombuffer(grow.decompress(pairs), np.uint8)
            n = len(body) // 12
            gap = np.ascontiguousarray(body[:8 * n].reshape(8, n).T).view("<i8")[:, 0]
            held.append((np.cumsum(gap), body[8 * n:].view(np.int32)))
    if held:
        yield lists()


_RUN = ["whole", "u1", "u2", "h", "i", "r", "s", "n"]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass 2, map side: the runs whose anchor gram another document holds; ``g`` has those grams of the document.

    Of equal runs of many documents at a time, only those of the smallest are left to be compared with others'.
    """

    def send(held: list[dict]) -> pa.RecordBatch:
        x = {k: np.concatenate([y[k] for y in held]) for k in held[0]}
        order = np.lexsort((x["i"], x["u2"], x["u1"]))
        x = {k: v[order] for k, v in x.items()}
        new = _starts(x["u1"], x["u2"])
        x["whole"] = x["i"] > x["i"][np.flatnonzero(new)][np.cumsum(new) - 1]
        # Decided runs need neither hash nor gram; they travel to any task.
        x["u1"] = np.where(x["whole"], x["i"] * 0x9E3779B1, x["u1"])
        x["u2"], x["h"] = np.where(x["whole"], 0, x["u2"]), np.where(x["whole"], 0, x["h"])
        return pa.RecordBatch.from_pydict({k: x[k] for k in _RUN})

    held, total = [], 0
    for b in batches:
        ids, rows, grams = b.column("i").to_numpy(), b.column("r").to_numpy(), b.column("g")
        for p in _pieces(b.column("t").to_pylist()):
            keep = np.zeros(len(p.h), bool)
            row, low = p.row[p.piece], _low(p.h.view(_U) >> _U(16))
            cut = np.flatnonzero(np.diff(row, prepend=-1))
            for lo, hi in zip(cut, [*cut[1:], len(row)]):
                keep[lo:hi] = np.isin(low[lo:hi], grams[int(row[lo])].values.to_numpy())
            keep = np.flatnonzero(keep)
            u1, u2 = p.run_hash(keep)
            row, piece = row[keep], p.piece[keep]
            held.append({"u1": u1, "u2": u2, "h": p.h[keep], "i": ids[row], "r": rows[row], "s": (p.s[keep] - p.start[piece] + p.offset[piece]).astype(np.int64), "n": p.n[keep].astype(np.int32)})
            total += len(keep)
            if total > FLUSH // 4:
                yield send(held)
                held, total = [], 0
    if total:
        yield send(held)


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass 2, reduce side: runs sorted by hash and document; all but those of the first document are removed whole."""
    last = None  # hash and first document of the group that the batch before ended in
    for b in batches:
        x = {k: b.column(k).to_numpy(zero_copy_only=False) for k in _RUN}
        ask = np.flatnonzero(~x["whole"])
        if len(ask):
            u1, u2, i = x["u1"][ask], x["u2"][ask], x["i"][ask]
            new = _starts(u1, u2)
            first = i[np.flatnonzero(new)][np.cumsum(new) - 1]
            if last and (u1[0], u2[0]) == last[:2]:
                first[: int(np.argmax(np.append(new[1:], True))) + 1] = last[2]
            last = (u1[-1], u2[-1], first[-1])
            x["whole"] = x["whole"].copy()
            x["whole"][ask] = i > first
        yield pa.RecordBatch.from_pydict({k: x[k] for k in ("h", "i", "r", "s", "n", "whole")})


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass 3: the bytes ``c`` of the open runs ``l`` (gram, start, further windows, whether its group is large)."""
    for b in batches:
        for lo in range(0, b.num_rows, 500):
            part = b.slice(lo, 500)
            data = [t.encode() for t in part.column("t").to_pylist()]
            runs = [x.values for x in part.column("l")]
            size = np.array([len(x) for x in runs])
            h, s, n, big = [np.concatenate([x.field(k).to_numpy(zero_copy_only=False) for x in runs]) for k in ("h", "s", "n", "big")]
            own = np.repeat(np.arange(len(data)), size)
            yield pa.RecordBatch.from_pydict({
                "h": h, "i": part.column("i").to_numpy()[own], "r": part.column("r").to_numpy()[own], "s": s, "big": big,
                "c": [data[k][x:x + y + DEPTH] for k, x, y in zip(own.tolist(), s.tolist(), n.tolist())]})


def _window_rows(t: pa.Table) -> dict[str, np.ndarray]:
    """Every window of the runs' bytes: 96 bits, document, row and start."""
    parts = t.column("c").to_pylist()
    size = np.array([len(x) for x in parts])
    word = words8(np.frombuffer(b"".join(parts) + bytes(8), np.uint8))
    n = size - DEPTH + 1
    own = np.repeat(np.arange(len(parts)), n)
    step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(size) - size)[own] + step
    u1, u2 = chain(word, [at + 8 * k for k in range(6)] + [at + DEPTH - 8], np.zeros(len(at), np.int64))
    return {"u1": u1, "u2": u2, "i": t.column("i").to_numpy()[own], "r": t.column("r").to_numpy()[own], "s": t.column("s").to_numpy()[own] + step}


def _spell_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            yield pa.RecordBatch.from_pydict(_window_rows(pa.Table.from_batches([b.slice(lo, 2000)])))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that a smaller document holds too, for runs sorted by gram: whole grams at a time, many at once."""

    def hits(t: pa.Table) -> pa.RecordBatch:
        w = _window_rows(t)
        order = np.lexsort((w["i"], w["u2"], w["u1"]))
        u1, u2, i = w["u1"][order], w["u2"][order], w["i"][order]
        new = np.ones(len(i), bool)
        new[1:] = (u1[1:] != u1[:-1]) | (u2[1:] != u2[:-1])
        first = i[np.flatnonzero(new)][np.cumsum(new) - 1]
        keep = order[i > first]
        return pa.RecordBatch.from_pydict({k: w[k][keep] for k in ("i", "r", "s")})

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= MEET_ROWS:
            t = pa.Table.from_batches(held)
            h = t.column("h").to_numpy()
            cut = int(np.argmax(h == h[-1]))
            if cut:
                yield hits(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                rows = len(h) - cut
    if held:
        yield hits(pa.Table.from_batches(held))


def _with_first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``first``, the smallest document of the group, null where the group lies in one document."""
    shared = rows.groupBy(*keys).agg(F.min("i").alias("first"), F.max("i").alias("last")).where("first < last").drop("last")
    return rows.join(shared, keys, "left")


def buckets_for(own: DataFrame) -> int:
    """Buckets of grams: a task holds the grams of one, so their number follows the bytes of the texts (a third of which come as grams)."""
    total = own.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    return max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ids: Ids | None = None) -> DataFrame:
    """A row per (``i``, ``r``: id and text hash) that loses bytes: ``starts`` and ``sizes`` of overlapping runs of removed bytes."""
    ship(docs.sparkSession)
    ids = ids or Ids(docs, doc_id)
    own = docs.select(ids.inner(doc_id).alias("i"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("r"), F.col(text).alias("t")).where(F.octet_length("t") >= DEPTH)
    buckets = buckets_for(own)
    sent = own.mapInArrow(_grams(buckets), "b int, i long, g array<int>, blob binary").repartition(buckets, "b").sortWithinPartitions("b")
    pairs = sent.mapInArrow(_answers(buckets), "d int, pairs binary").repartition(buckets, "d").sortWithinPartitions("d")
    lists = fixed(pairs.mapInArrow(_lists, "i long, g array<int>"))
    release(lists)
    runs = own.join(lists, "i").mapInArrow(_runs, "whole boolean, u1 long, u2 int, h long, i long, r long, s long, n int")
    runs = runs.repartition("u1").sortWithinPartitions("u1", "u2", "i")
    found = fixed(runs.mapInArrow(_firsts, "h long, i long, r long, s long, n int, whole boolean"))
    forget(lists)
    release(found)
    left = found.where("not whole")
    two = left.groupBy("h").agg(F.min("i").alias("a"), F.max("i").alias("b"), (F.count(F.lit(1)) > LARGE).alias("big")).where("a < b").select("h", "big")
    open_ = left.join(two, "h").groupBy("i", "r").agg(F.collect_set(F.struct("h", "s", "n", "big")).alias("l"))
    text = own.join(open_, ["i", "r"]).dropDuplicates(["i", "r"])
    rows = text.mapInArrow(_contents, "h long, i long, r long, s long, big boolean, c binary")
    # Groups of up to LARGE runs meet in one task; the windows of larger ones are spelled out and aggregated.
    few = rows.where("not big").repartition("h").sortWithinPartitions("h").mapInArrow(_meet, "i long, r long, s long")
    many = _with_first(rows.where("big").mapInArrow(_spell_out, "u1 long, u2 int, i long, r long, s long"), ["u1", "u2"]).where(F.col("first") < F.col("i")).select("i", "r", "s")
    single = few if left.join(two.where("big"), "h", "left_semi").isEmpty() else few.unionAll(many)
    single = fixed(single.groupBy("i", "r").agg(F.array_distinct(F.collect_list("s")).alias("w")))
    release(single)
    whole = found.where("whole").groupBy("i", "r").agg(F.collect_set(F.struct("s", (F.col("n") + DEPTH).alias("n"))).alias("a"))
    each = whole.join(single, ["i", "r"], "full").select("i", "r", F.array_sort(F.concat(F.coalesce("a", F.array().cast("array<struct<s:long,n:int>>")), F.transform(F.coalesce("w", F.array().cast("array<long>")), lambda x: F.struct(x.alias("s"), F.lit(DEPTH).alias("n"))))).alias("l"))
    spans = fixed(each.select("i", "r", F.col("l.s").alias("starts"), F.col("l.n").alias("sizes")))
    forget(found, single)
    release(spans)
    return spans


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kept: bool = True) -> DataFrame:
    """A row per row of ``docs``: its id, ``n_bytes``, ``n_removed``, ``spans`` (maximal removed runs: start, size), the
    SHA-256 of the remaining bytes and, if ``kept``, those bytes (which need not be valid UTF-8)."""
    ids = Ids(docs, doc_id)
    spans = repeated_spans(docs, doc_id, text, ids)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), ids.inner(doc_id).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("r", F.xxhash64("t"))
    both = own.join(spans.withColumnsRenamed({"i": "k2", "r": "r2"}), (F.col("k") == F.col("k2")) & (F.col("r") == F.col("r2")), "left").select("doc_id", "t", "starts", "sizes")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                yield _cut(b.slice(lo, 1000), kept)

    return both.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,size:long>>, kept_sha256 string" + ", kept binary" * kept)


def _cut(b: pa.RecordBatch, kept: bool) -> pa.RecordBatch:
    sizes, removed, spans, shas, rest = [], [], [], [], []
    for t, starts, lengths in zip(b.column("t").to_pylist(), b.column("starts"), b.column("sizes")):
        data = t.encode()
        runs: list[list[int]] = []
        if starts.is_valid:
            s, n = starts.values.to_numpy(), lengths.values.to_numpy()
            reach = np.maximum.accumulate(s + n)
            new = np.ones(len(s), bool)
            new[1:] = s[1:] > reach[:-1]
            first = np.flatnonzero(new)
            runs = np.stack([s[first], reach[np.append(first[1:], len(s)) - 1]], 1).tolist()
        at, parts = 0, []
        for lo, hi in runs:
            parts.append(data[at:lo])
            at = hi
        out = b"".join([*parts, data[at:]])
        sizes.append(len(data))
        removed.append(len(data) - len(out))
        spans.append([{"start": lo, "size": hi - lo} for lo, hi in runs])
        shas.append(hashlib.sha256(out).hexdigest())
        rest.append(out)
    cols = {
        "doc_id": b.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
        "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))), "kept_sha256": pa.array(shas, pa.string())}
    return pa.RecordBatch.from_pydict({**cols, "kept": pa.array(rest, pa.binary())} if kept else cols)


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    return cut_repeats(docs, kept=False).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
