"""Vector codes by integer codebooks, with LAESA pivots that order and prune the exact evaluations.

Components become integers, floor(SCALE * x), and vectors are cut into PARTS equal consecutive parts. Each part position
has a codebook that starts as that part of the ENTRIES smallest kept ids; ROUNDS times every part goes to its nearest
entry (squared Euclidean distance, ties to the lower index) and each entry that is used becomes the componentwise
floor(sum / count) of its parts; then parts are assigned a last time.

LAESA: PIVOTS of the first entries, far from each other, stay fixed. The distances of every part to its pivots are computed
once and stored with it. A round computes only the distances of the pivots to the entries; by the triangle inequality
|d(part, pivot) - d(pivot, entry)| bounds d(part, entry) from below. Entries are tried in the order of their bounds, by
exact integer arithmetic, until the next bound exceeds the best distance. Stored distances are 32-bit, and a bound gives
way by 2^-22 of both, so that rounding never prunes an entry that is nearest or ties.

A round is a scan of the written table: every task sums up its parts by entry and sends PARTS x ENTRIES rows for each
component, whose sums (never rows of the table) come to the driver. Codebooks are a few kilobytes.

Defined cases: rows whose vector is null or holds a null or non-finite component are dropped, and so are vectors of
another length than that of the smallest kept id. Where the length is no multiple of PARTS, parts differ by one component.
Rows that repeat an id are rows of their own; ties among the smallest ids go by their vectors, null ids come last. Fewer
than ENTRIES rows give fewer entries. An integer beyond 2^28 raises, as its squares would not fit. Other columns play
no part, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.llm.common import fixed, same, ship

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
PIVOTS = 4
LARGEST = 1 << 28
SLACK = 2.0 ** -22


def usable(v: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(odd, F.lit(False))


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    q = np.floor(values.astype(np.float64) * scale)
    if q.size and np.abs(q).max() > LARGEST:
        raise ValueError("a component is too large for exact squares")
    return q.astype(np.int64)


def bounds_of(width: int, parts: int = PARTS) -> list[int]:
    """Where parts begin and end."""
    return [k * width // parts for k in range(parts + 1)]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of integers."""
    return np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(2).astype(np.float64))


def choose_pivots(entries: np.ndarray, many: int) -> np.ndarray:
    """Indexes of entries: each next one has the largest sum of distances to those before it."""
    d = distances(entries, entries)
    chosen = [0]
    while len(chosen) < min(many, len(entries)):
        far = d[chosen].sum(0)
        far[chosen] = -1
        chosen.append(int(far.argmax()))
    return np.array(chosen)


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivot_entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry, squared distance, number of exact evaluations) of each part."""
    d = to_pivots.astype(np.float64)
    bound = np.zeros((len(x), len(entries)))
    for j in range(d.shape[1]):
        a, b = d[:, j, None], pivot_entry[None, j, :]
        np.maximum(bound, np.abs(a - b) - SLACK * (a + b), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(entries))
    rows, evaluated = np.arange(len(x)), 0
    for step in range(len(entries)):
        e = order[rows, step]
        if step:
            open_ = bound[rows, e] ** 2 <= best[rows] * (1 + 1e-9)
            rows, e = rows[open_], e[open_]
        if not len(rows):
            break
        diff = x[rows] - entries[e]
        exact = np.einsum("ij,ij->i", diff, diff)
        evaluated += len(rows)
        better = (exact < best[rows]) | ((exact == best[rows]) & (e < at[rows]))
        best[rows[better]], at[rows[better]] = exact[better], e[better]
    return at, best, evaluated


class Codebooks:
    """Entries of every part position, with the fixed pivots."""

    def __init__(self, first: np.ndarray, parts: int = PARTS, pivots: int = PIVOTS):
        cut = bounds_of(first.shape[1], parts)
        self.spans = list(zip(cut, cut[1:]))
        self.entries = [first[:, lo:hi].copy() for lo, hi in self.spans]
        self.pivots = [x[choose_pivots(x, pivots)] for x in self.entries]

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([distances(x[:, lo:hi], p) for (lo, hi), p in zip(self.spans, self.pivots)], 1).astype("<f4")

    def assign(self, x: np.ndarray, stored: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indexes, squared distances) by part."""
        many = len(self.pivots[0])
        got = [nearest(x[:, lo:hi], stored[:, k * many:(k + 1) * many], e, distances(p, e))[:2] for k, ((lo, hi), e, p) in enumerate(zip(self.spans, self.entries, self.pivots))]
        return np.stack([a for a, _ in got], 1), np.stack([b for _, b in got], 1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for e in self.entries for row in e for v in row.tolist()).encode()).hexdigest()


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Rows of equal length from a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def fit(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, Codebooks] | None:
    """(the written table: i, l, x, p; the fitted codebooks), or None for a table without a usable vector."""
    spark = vectors.sparkSession
    ship(spark)
    own = vectors.select(F.col(vec_id).cast("long").alias("i"), F.col(label).alias("l"), F.col(vector).alias("v")).where(usable(F.col("v")))
    by = [F.col("i").asc_nulls_last(), F.col("v")]
    head = own.orderBy(*by).select("v").limit(1).collect()
    if not head:
        return None
    width = len(head[0].v)
    own = own.where(F.size("v") == width)
    first = integers(np.array([r.v for r in own.orderBy(*by).select("v").limit(entries).collect()], np.float64).reshape(-1, width), scale)
    books = Codebooks(first, parts)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = integers(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width), scale)
            p = books.to_pivots(x)
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("l"), pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary()), pa.array([r.tobytes() for r in p], pa.binary())], ["i", "l", "x", "p"])

    kinds = StructType([StructField("i", LongType()), own.schema["l"], *StructType.fromDDL("x binary, p binary").fields])
    table = fixed(own.mapInArrow(prepare, kinds))
    stored = sum(map(len, books.pivots))
    for _ in range(rounds):
        now = books

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            many = len(now.entries[0])
            count, total = np.zeros((parts, many), np.int64), np.zeros((many, width), np.int64)
            for b in batches:
                x = _matrix(b.column("x"), "<i4", width).astype(np.int64)
                at, _ = now.assign(x, _matrix(b.column("p"), "<f4", stored))
                for k, (lo, hi) in enumerate(now.spans):
                    count[k] += np.bincount(at[:, k], minlength=many)
                    for c in range(lo, hi):  # exact: a batch's sums stay under 2^53
                        total[:, c] += np.bincount(at[:, k], x[:, c], minlength=many).astype(np.int64)
            part = np.repeat(np.arange(parts), [hi - lo for lo, hi in now.spans])
            e, c = np.divmod(np.arange(many * width), max(width, 1))
            used = count[part[c], e] > 0
            yield pa.RecordBatch.from_pydict({"c": c[used], "e": e[used], "n": count[part[c], e][used], "s": total[e, c][used]})

        # One row per entry and component: parts x entries x components, whatever the rows of the table.
        new = table.select("x", "p").mapInArrow(sums, "c long, e long, n long, s long").groupBy("c", "e").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
        books = _copy(books)
        where = {c: (k, c - lo) for k, (lo, hi) in enumerate(books.spans) for c in range(lo, hi)}
        for r in new:
            k, c = where[r.c]
            books.entries[k][r.e, c] = r.s // r.n
    return table, books


def _copy(books: Codebooks) -> Codebooks:
    out = object.__new__(Codebooks)
    out.spans, out.pivots, out.entries = books.spans, books.pivots, [e.copy() for e in books.entries]
    return out


def codes(table: DataFrame, books: Codebooks) -> DataFrame:
    """i, l, ``code`` and ``error`` of every row of a fitted table."""
    width, stored = books.spans[-1][1], sum(map(len, books.pivots))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, d = books.assign(_matrix(b.column("x"), "<i4", width).astype(np.int64), _matrix(b.column("p"), "<f4", stored))
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("l"), pa.array([bytes(r).hex() for r in at.astype(np.uint8)], pa.string()), pa.array(d.sum(1))], ["i", "l", "code", "error"])

    kinds = StructType([table.schema["i"], table.schema["l"], StructField("code", StringType()), StructField("error", LongType())])
    return table.mapInArrow(encode, kinds)


def code_report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row."""
    got = fit(vectors)
    if got is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    rows = fixed(codes(*got))
    # Written first, so that Spark knows its size: it is broadcast under the threshold, else hot labels are split by adaptive execution.
    labels = fixed(rows.groupBy("l").agg(F.sum("error").alias("label_error"))).withColumnRenamed("l", "m")
    both = rows.join(labels, same(rows, labels, [("l", "m")]), "left")
    return both.select(F.col("i").alias("vec_id"), "code", "error", "label_error", F.lit(got[1].digest()).alias("codebooks_sha256"))
