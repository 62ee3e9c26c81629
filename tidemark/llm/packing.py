"""Best-fit packing of documents into sequences of at most CAPACITY tokens.

Best-fit decreasing goes through the pieces from the longest to the shortest and puts each into the open sequence whose
remaining room is the tightest that still holds it. Pieces of one length are alike, and so are open sequences with equal
room: a run of pieces of length L fills every sequence of the tightest room r with r // L of them, one sequence after the
other, before the next tightest room is looked up. So the whole packing of any corpus follows from its histogram of
lengths (at most CAPACITY numbers), and is the same as if each document had been placed by itself. A segment tree over
the remaining rooms finds the tightest in logarithmic time.

``best_fit`` gives the packing as flows: "ranks from f on among the pieces of length L go to m sequences from b on, k to
each, from offset o on". Their number depends on CAPACITY alone: a step splits at most one range of sequences and makes at
most three, and a range meets each length once, of which at most sqrt(2 CAPACITY) fit into one sequence.

Spark does the rest: texts are encoded and cut where they lie, and each task numbers its own pieces of each length; counts
per (part, length) give each part its first rank, and a piece finds its flow by bisection. Only the histogram and the
flows pass the driver.

Rows: a null or empty text is the end id alone. Rows with a null id and rows that repeat an id or a text are documents of
their own. Columns of the input other than id and text play no part, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.coder import Coder
from tidemark.llm.common import by_bytes, fixed, ship

CAPACITY = 4096
END_ID = 1


class Rooms:
    """Segment tree over remaining rooms 0 to ``most``: which of them some open sequence has."""

    def __init__(self, most: int):
        self.base = 1 << most.bit_length()
        self.any = np.zeros(2 * self.base, bool)

    def mark(self, room: int, there: bool) -> None:
        k = self.base + room
        self.any[k] = there
        while k > 1:
            k >>= 1
            self.any[k] = self.any[2 * k] or self.any[2 * k + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest marked room of at least ``least``."""
        k = self.base + least
        while not self.any[k]:
            while k & 1:  # a right child: on to what lies right of its parent
                k >>= 1
            if k == 0:
                return None
            k += 1
        while k < self.base:
            k = 2 * k if self.any[2 * k] else 2 * k + 1
        return k - self.base


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(flows, number of sequences) of best-fit decreasing. Flow: length, first rank, first sequence, pieces per sequence, offset."""
    rooms, open_, flows, made = Rooms(capacity), [deque() for _ in range(capacity + 1)], [], 0

    def keep(room: int, first: int, many: int) -> None:
        if many:
            open_[room].append((first, many))
            rooms.mark(room, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit into sequences of {capacity}")
        while left:
            room = rooms.tightest(length)
            if room is None:
                room, first, many = capacity, made, -(-left // (capacity // length))
                made += many
            else:
                first, many = open_[room].popleft()
                rooms.mark(room, bool(open_[room]))
            each = room // length
            full, rest = min(many, left // each), 0
            if full:
                flows.append((length, rank, first, each, capacity - room))
                keep(room - each * length, first, full)
            if full < many and (rest := left - full * each):
                flows.append((length, rank + full * each, first + full, rest, capacity - room))
                keep(room - rest * length, first + full, 1)
            unused = many - full - (rest > 0)
            if unused:  # back to the front: its room is still the same
                open_[room].appendleft((first + many - unused, unused))
                rooms.mark(room, True)
            rank += full * each + rest
            left -= full * each + rest
    return np.array(flows, np.int64).reshape(-1, 5), made


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and (if asked for) ``ids``, little-endian 32-bit, of every piece."""
    ship(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(tokenizer)
        for b in by_bytes(batches, "t"):
            rows: list[tuple] = []
            for i, own in zip(b.column(0).to_pylist(), coder.encode(b.column(1).to_pylist())):
                own = np.append(own, np.array([end_id], coder.kind)).astype("<u4")
                for k, lo in enumerate(range(0, len(own), capacity)):
                    part = own[lo:lo + capacity].tobytes()
                    rows.append((i, k, lo, len(part) // 4, zlib.crc32(part), part))
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:len(names)], kinds)], names)

    own = docs.select(F.col(doc_id).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return own.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: best-fit decreasing over all rows. Other columns pass through.

    The input may not hold columns of these two names. A length over ``capacity``, under one or null raises.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    spark = pieces.sparkSession
    ship(spark)
    taken = set(pieces.columns)
    part, rank, before = [next(n for n in (f"__{base}{k or ''}" for k in range(len(taken) + 1)) if n not in taken) for base in ("part", "rank", "before")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, own = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            n = b.column(b.schema.get_field_index(length)).to_numpy(zero_copy_only=False)
            if b.num_rows and not ((n >= 1) & (n <= capacity)).all():
                raise ValueError(f"lengths must lie between 1 and {capacity}")
            n = n.astype(np.int64)
            order = np.argsort(n, kind="stable")
            run = np.arange(len(n)) - np.searchsorted(n[order], n[order])
            local = np.empty(len(n), np.int64)
            local[order] = run + seen[n[order]]
            seen += np.bincount(n, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), own, np.int64)), pa.array(local)], [*b.schema.names, part, rank])

    added = StructType([*pieces.schema.fields, StructField(part, LongType()), StructField(rank, LongType())])
    rows = fixed(pieces.mapInArrow(number, added))
    counts = rows.groupBy(part, length).agg(F.count(F.lit(1)).alias("n"))
    first = fixed(counts.withColumn(before, F.sum("n").over(Window.partitionBy(length).orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")))
    totals = {r[0]: r[1] for r in first.groupBy(length).agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    names = pieces.columns
    flows, _ = best_fit(totals, capacity)
    flows = flows[np.lexsort((flows[:, 1], flows[:, 0]))]
    # Bounded by the capacity, not by the corpus (see the module).
    sent = spark.sparkContext.broadcast((flows, flows[:, 0] << 48 | flows[:, 1]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flow, keys = sent.value
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64)
            n, r = col(length), col(rank) + col(before)
            f = flow[np.searchsorted(keys, n << 48 | r, "right") - 1]
            into, nth = np.divmod(r - f[:, 1], np.maximum(f[:, 3], 1))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(len(names))], pa.array(f[:, 2] + into), pa.array(f[:, 4] + nth * n)], [*names, "sequence_id", "offset"])

    ranked = rows.join(first.select(part, length, before), [part, length]).select(*names, rank, before)
    return ranked.mapInArrow(place, StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and ``ids`` of every sequence: its pieces' ids one after the other (packed pieces with ``ids``)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for b in by_bytes(batches, "ids"):
            for s, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if s != now and held:
                    out.append((now, b"".join(held)))
                    held = []
                now = s
                held.append(ids)
            if out:
                yield pa.RecordBatch.from_pydict({"sequence_id": [r[0] for r in out], "ids": pa.array([r[1] for r in out], pa.binary())})
                out = []
        if held:
            yield pa.RecordBatch.from_pydict({"sequence_id": [now], "ids": pa.array([b"".join(held)], pa.binary())})

    return packed.select("sequence_id", "ids", "offset").repartition("sequence_id").sortWithinPartitions("sequence_id", "offset").select("sequence_id", "ids").mapInArrow(join, "sequence_id long, ids binary")


def packing_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    return pack(token_pieces(docs, tokenizer, ids=False))
