"""Bootstrap counts without drawing rows: exact multinomial counts per cell of equal rows.

A statistic of a row bootstrap depends on how often each distinct row was drawn, and those counts are multinomial. So rows
are first counted into cells. The cells of a stratum, in the order of their values, are the leaves of a binary tree; a
replicate starts with as many draws as the stratum has rows and splits them at every node, the left child getting a
binomial number of them. Cost and output are cells x replicates, whatever the number of rows.

A binomial number is found by inversion: probabilities are added up from the mode outwards (mode, mode + 1, mode - 1, ...)
until they pass a uniform number, the md5 of seed, replicate, stratum and node. Every engine and every retry that follows these
rules draws the same counts. A task walks one part of the tree of at most FAN leaves for CHUNK replicates; strata of more
cells are walked level by level, each level's counts being the next one's starting numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidemark.operators.ordered import numbered, order_rows
from tidemark.session import materialize, ship

FAN = 4096
CHUNK = 125  # replicates that a task takes through one part of a tree


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 1: Stirling's series after a shift to x >= 10."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for _ in range(9):
        low = x < 10
        if not low.any():
            break
        shift = np.where(low, shift + np.log(x), shift)
        x = np.where(low, x + 1, x)
    r = 1 / x
    series = r * (1 / 12 - r * r * (1 / 360 - r * r * (1 / 1260 - r * r * (1 / 1680 - r * r / 1188))))
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - shift


def binomial(n: np.ndarray, p: np.ndarray | float, u: np.ndarray) -> np.ndarray:
    """Numbers of successes of n trials, by inversion of u from the mode outwards; ``p`` is one number or one for each."""
    p = np.broadcast_to(np.asarray(p, float), n.shape)
    mode = np.minimum(np.floor((n + 1) * p), n).astype(np.int64)
    out = mode.copy()
    if n.size and n.max() < n.size:  # few numbers, many times each
        factorial = log_gamma(np.arange(n.max() + 1) + 1.0)
        ways = factorial[n] - factorial[mode] - factorial[n - mode]
    else:
        ways = log_gamma(n + 1.0) - log_gamma(mode + 1.0) - log_gamma(n - mode + 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = np.exp(ways + mode * np.log(p) + (n - mode) * np.log1p(-p))
    odds = p / (1 - p)
    reach = np.ceil(10 * np.sqrt(n * p * (1 - p))).astype(np.int64) + 10
    # What is still open, in arrays of its own, so that a step costs as much as it has numbers left.
    open_ = np.flatnonzero(at <= u)
    total, mode, m, odds, u, reach = at[open_], mode[open_], n[open_], odds[open_], u[open_], reach[open_]
    up, down = total.copy(), total.copy()
    step = 0
    while len(open_):
        above, below = mode + step, mode - step
        up = np.where(above < m, up * (m - above) / (above + 1.0) * odds, 0.0)
        total = total + up
        over = (above < m) & (total > u)
        out[open_[over]] = above[over] + 1
        down = np.where(below > 0, down * below / (m - below + 1.0) / odds, 0.0)
        total = np.where(over, total, total + down)
        under = ~over & (below > 0) & (total > u)
        out[open_[under]] = below[under] - 1
        step += 1
        # What rounding leaves over after all probable numbers: the last of them.
        last = ~over & ~under & (step >= np.minimum(reach, np.maximum(mode, m - mode)))
        out[open_[last]] = np.where(mode - step >= 0, mode - step, np.minimum(mode + step, m))[last]
        rest = ~(over | under | last)
        open_, total, up, down, mode, m, odds, u, reach = (x[rest] for x in (open_, total, up, down, mode, m, odds, u, reach))
    return out


def uniforms(keys: Iterable[bytes]) -> np.ndarray:
    """First fifteen hex digits of the md5 of each key as a number in [0, 1)."""
    heads = b"".join([hashlib.md5(k).digest()[:8] for k in keys])
    return (np.frombuffer(heads, ">u8") >> np.uint64(4)).astype(float) / float(1 << 60)


_BLOCK = 8192  # keys that are hashed at a time: their working arrays stay in the cache
_LONGEST = 55  # bytes of a key that fit in one block of md5
_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_PLACES = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)


def _md5_heads(words: Sequence[np.ndarray | None], n: int) -> np.ndarray:
    """First 64 bits of the md5 of n blocks, given as 16 arrays of words (None: all zero), as in the digest's hex digits."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:  # c ^ (b | ~d)
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f), np.add(f, _SINES[i], out=f)
        w = words[_PLACES[i]]
        if w is not None:
            np.add(f, w, out=f)
        np.left_shift(f, np.uint32(_TURNS[i]), out=t), np.right_shift(f, np.uint32(32 - _TURNS[i]), out=f)
        np.bitwise_or(f, t, out=f), np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    high, low = ((x + x0).byteswap().astype(np.uint64) for x, x0 in ((a, _START[0]), (b, _START[1])))
    return high << np.uint64(32) | low


def _blocks(texts: Sequence[bytes], at: int, whole: bool) -> np.ndarray:
    """16 words x texts: each text from byte ``at`` on; with ``whole`` it ends the key, whose end and length are set."""
    out = np.zeros((len(texts), 64), np.uint8)
    for n in sorted({len(x) for x in texts}):
        rows = np.flatnonzero([len(x) == n for x in texts])
        out[rows, at:at + n] = np.frombuffer(b"".join([texts[r] for r in rows]), np.uint8).reshape(len(rows), n)
        if whole:
            out[rows, at + n] = 0x80
            out[rows, 56:64] = np.frombuffer(np.uint64(8 * (at + n)).astype("<u8").tobytes(), np.uint8)
    return np.ascontiguousarray(out.view("<u4").T.astype(np.uint32))


def uniforms_of(heads: Sequence[bytes], tails: Sequence[bytes], head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """:func:`uniforms` of the keys ``heads[head] + tails[tail]``, hashed many at a time."""
    out = np.empty(len(head))
    sizes = np.array([len(x) for x in heads])
    most = max(map(len, tails), default=0)
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes[head] == size) if (sizes != size).any() else np.arange(len(head))
        if size + most > _LONGEST:
            out[own] = uniforms(heads[h] + tails[t] for h, t in zip(head[own].tolist(), tail[own].tolist()))
            continue
        first = _blocks([x if len(x) == size else b"" for x in heads], 0, False)
        rest = _blocks(tails, size, True)
        for lo in range(0, len(own), _BLOCK):
            at = own[lo:lo + _BLOCK]
            h, t = head[at], tail[at]
            words = []
            for j in range(16):
                x = first[j][h] if first[j].any() else None
                y = rest[j][t] if rest[j].any() else None
                words.append(x if y is None else y if x is None else x | y)
            out[at] = (_md5_heads(words, len(at)) >> np.uint64(4)).astype(float) / float(1 << 60)
    return out


def split_counts(n: np.ndarray, weights: np.ndarray, keys: Sequence[str], first: int = 0) -> np.ndarray:
    """Replicates x cells: ``n`` draws of each replicate split over cells of these weights; ``keys`` name the replicates, ``first`` the first cell.

    All nodes of a depth are split at once.
    """
    before = np.concatenate([[0], np.cumsum(weights)])
    out = np.zeros((len(n), len(weights)), np.int64)
    names = [f"{k}|".encode() for k in keys]
    lo, hi, have = np.array([0]), np.array([len(weights)]), n.astype(np.int64)[None, :]  # nodes, nodes x replicates
    while len(lo):
        leaf = hi - lo == 1
        out[:, lo[leaf]] = have[leaf].T
        lo, hi, have = lo[~leaf], hi[~leaf], have[~leaf]
        mid = (lo + hi) // 2
        p = (before[mid] - before[lo]) / np.maximum(before[hi] - before[lo], 1)
        node, rep = np.nonzero(have)
        spans = [f"{first + a}|{first + b}".encode() for a, b in zip(lo.tolist(), hi.tolist())]
        u = uniforms_of(names, spans, rep, node)
        left = np.zeros_like(have)
        left[node, rep] = binomial(have[node, rep], p[node], u)
        lo, hi, have = np.concatenate([lo, mid]), np.concatenate([mid, hi]), np.concatenate([left, have - left])
    return out


def count_cells(df: DataFrame, cells: Sequence[str], strata: Sequence[str] = (), slices=None) -> DataFrame:
    """Distinct rows of ``cells`` per stratum with their number ``w_`` and their place ``i_`` in the order of their values."""
    names = [c for c in cells if c not in strata]
    counted = df.groupBy(*strata, *names).agg(F.count(F.lit(1)).alias("w_"))
    return materialize(numbered(counted, list(strata), [F.col(c).asc_nulls_first() for c in names], "i_", None, slices).withColumn("i_", F.col("i_") - 1))


COUNTS = "kid_ bigint, have_ array<bigint>"


def _count_lists(kid: np.ndarray, got: np.ndarray, carried: dict) -> dict[str, pa.Array]:
    """Cells that a chunk of replicates drew, with their counts in each of them."""
    used = np.flatnonzero(got.any(1))
    return {"kid_": pa.array(kid[used]), "have_": lists(got[used])}


def lists(rows: np.ndarray) -> pa.ListArray:
    """One list per row of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def deal(rows: DataFrame, reps: int, seed: int, strata: Sequence[str] = (), carry: Sequence[str] = (), leaf=_count_lists, fields: str = COUNTS) -> tuple[DataFrame, list[str]]:
    """Draws of all replicates for cells numbered by :func:`count_cells`, and the names that the strata have in them.

    ``leaf(places, cells x replicates, carried)`` turns the counts of a part of at most FAN cells into columns ``fields``;
    ``carried`` holds the integer columns ``carry`` of those cells.
    """
    ship(rows.sparkSession)
    top = rows.groupBy(*strata).agg(F.sum("w_").alias("n_"), F.max("i_").alias("last_"))
    most = top.agg(F.max("last_")).first()[0]
    levels = 0  # parts of parts above the cells
    while most is not None and most // FAN ** (levels + 1) > 0:
        levels += 1
    label = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(s).cast("string"), F.lit("")) for s in strata]) if strata else F.lit(str(seed))
    chunks = F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // CHUNK)))
    # Draws of the parts of a level: (strata, part, chunk, counts of the chunk's replicates).
    mine = [f"of_{k}_" for k in range(len(strata))]  # strata, under names of their own
    draws = top.select(*[F.col(s).alias(m) for s, m in zip(strata, mine)], F.lit(0).cast("long").alias("part_"), chunks.alias("chunk_"), F.array_repeat(F.col("n_"), CHUNK).alias("have_"))
    for level in range(levels, -1, -1):
        last = level == 0
        own = ["kid_", "w_", *(carry if last else [])]
        child = F.floor(F.col("i_") / F.lit(FAN ** level)).cast("long")
        kids = rows.withColumn("kid_", F.col("i_")) if last else rows.groupBy(*strata, child.alias("kid_")).agg(F.sum("w_").alias("w_"))
        nodes = kids.groupBy(*strata, F.floor(F.col("kid_") / F.lit(FAN)).cast("long").alias("node_")).agg(
            F.array_sort(F.collect_list(F.struct(*own))).alias("kids_"))  # at most FAN
        nodes = nodes.select(*strata, "node_", *[F.col(f"kids_.{c}").alias(c) for c in own])
        both = [F.col(s).eqNullSafe(F.col(m)) for s, m in zip(strata, mine)] + [F.col("node_") == F.col("part_")]
        joined = nodes.join(draws, both).select(*strata, *own, "chunk_", "have_", label.alias("key_"))
        schema = StructType([*[StructField(m, rows.schema[s].dataType) for s, m in zip(strata, mine)], StructField("chunk_", IntegerType()), *StructType.fromDDL(fields if last else COUNTS).fields])

        def split(batches: Iterator[pa.RecordBatch], level: int = level, own: Sequence[str] = own, of=leaf if last else _count_lists) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    col = {c: np.array(b.column(c)[r].values) for c in own}
                    chunk, have, key = b.column("chunk_")[r].as_py(), np.array(b.column("have_")[r].values), b.column("key_")[r].as_py()
                    many = min(CHUNK, reps - chunk * CHUNK)
                    keys = [f"{key}|{level}|{chunk * CHUNK + k}" for k in range(many)]
                    kid = col.pop("kid_")
                    made = of(kid, split_counts(have[:many], col.pop("w_"), keys, int(kid[0])).T, col)
                    size = len(next(iter(made.values())))
                    yield pa.RecordBatch.from_pydict({**{m: pa.repeat(b.column(s)[r], size) for s, m in zip(strata, mine)}, "chunk_": pa.array(np.full(size, chunk, np.int32)), **made})

        # Few and small rows, each of them much work: as many partitions as a shuffle has, which a bare repartition would merge.
        dealt = joined.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *strata, F.element_at("kid_", 1), "chunk_").mapInArrow(split, schema)
        draws = dealt if last else materialize(dealt.withColumnRenamed("kid_", "part_"))
    return draws, mine


def resample_cells(df: DataFrame, reps: int, seed: int, cells: Sequence[str], strata: Sequence[str] = (), slices=None) -> DataFrame:
    """(rep, strata, cells, times): how often each distinct row of ``cells`` was drawn, ``times`` > 0, in resamples as large as each stratum."""
    names = [c for c in cells if c not in strata]
    rows = count_cells(df, cells, strata, slices)
    draws, mine = deal(rows, reps, seed, strata)
    same = [F.col(s).eqNullSafe(F.col(m)) for s, m in zip(strata, mine)] + [F.col("i_") == F.col("kid_")]
    long = rows.join(draws, same).select(*strata, *names, "chunk_", F.posexplode("have_").alias("k_", "times")).where("times > 0")
    return long.select((F.col("chunk_") * CHUNK + F.col("k_")).cast("int").alias("rep"), *strata, *names, "times")


# ------------------------------------------------------------------ AUC of the resamples
PARTIAL = "first_ bigint, last_ bigint, p_ array<double>, n_ array<double>, u_ array<double>, pf_ array<double>, nl_ array<double>"


def part_of_auc(at: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> dict[str, pa.Array]:
    """What one range of scores adds to the AUC of each replicate; ``at`` is the place of the score, ``pos`` and ``neg`` cells x replicates."""
    order = np.argsort(at, kind="stable")
    at, cut = np.unique(at[order], return_index=True)
    pos, neg = (np.add.reduceat(x[order], cut, axis=0).astype(float) for x in (pos, neg))
    wins = (pos * (np.cumsum(neg, 0) - neg / 2)).sum(0)
    one = lambda x: lists(x[None, :])
    return {"first_": pa.array(at[:1]), "last_": pa.array(at[-1:]), "p_": one(pos.sum(0)), "n_": one(neg.sum(0)), "u_": one(wins), "pf_": one(pos[0]), "nl_": one(neg[-1])}


def join_parts(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rep, auc) from the ranges of scores ``block_`` of a chunk of replicates; replicates with one class are left out.

    Two ranges may share a score: its pairs across them are ties and not wins.
    """
    d = parts.select(*keys, "block_", "chunk_", "first_", "last_", F.posexplode(F.arrays_zip("p_", "n_", "u_", "pf_", "nl_")).alias("k_", "x_"))
    d = d.select(*keys, (F.col("chunk_") * CHUNK + F.col("k_")).cast("int").alias("rep"), "block_", "first_", "last_", "x_.*")
    w = Window.partitionBy(*keys, "rep").orderBy("block_")  # a row per FAN cells
    below = F.coalesce(F.sum("n_").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    shared = F.when(F.lag("last_").over(w) == F.col("first_"), F.col("pf_") * F.lag("nl_").over(w) / 2).otherwise(0.0)
    d = d.select(*keys, "rep", "p_", "n_", (F.col("u_") + F.col("p_") * below - shared).alias("u_"))
    g = d.groupBy(*keys, "rep").agg(F.sum("p_").alias("p_"), F.sum("n_").alias("n_"), F.sum("u_").alias("u_"))
    return g.where("p_ > 0 AND n_ > 0").select(*keys, "rep", (F.col("u_") / (F.col("p_") * F.col("n_"))).alias("auc"))


def places(rows: DataFrame, score: Column, strata: Sequence[str], name: str, slices=None) -> DataFrame:
    """``rows`` with ``name``: the number of rows of the stratum with a smaller score, -1 without a score."""
    d = rows.withColumn("s_", score)
    each = d.where("s_ IS NOT NULL").groupBy(*strata, "s_").agg(F.count(F.lit(1)).alias("rows_"))
    at = order_rows(each, list(strata), [F.col("s_")], slices).scan(sums_before={name: F.col("rows_")})
    at = at.select(*[F.col(s).alias(f"at_{k}_") for k, s in enumerate(strata)], F.col("s_").alias("at_s_"), name)
    same = [F.col(s).eqNullSafe(F.col(f"at_{k}_")) for k, s in enumerate(strata)] + [F.col("s_") == F.col("at_s_")]
    return d.join(at, same, "left").withColumn(name, F.coalesce(name, F.lit(-1))).drop("s_", "at_s_", *[f"at_{k}_" for k in range(len(strata))])


def _signs(label: str) -> Column:
    return F.when(F.col(label) == 1, 1).when(F.col(label) == 0, 0).otherwise(-1).cast("long").alias("y_")


def resampled_auc(df: DataFrame, reps: int, seed: int, score: str, label: str, strata: Sequence[str] = (), slices=None) -> DataFrame:
    """(strata, rep, auc) of row resamples of each stratum.

    The cells lie in the order of the scores, so the task that draws a part of them reduces it to five numbers per replicate.
    """
    rows = count_cells(df, [score, label], strata, slices)
    rows = materialize(places(rows, F.col(score), strata, "at_", slices).withColumn("y_", _signs(label)))

    def leaf(kid: np.ndarray, got: np.ndarray, of: dict) -> dict[str, pa.Array]:
        some = of["at_"] >= 0
        at, y, got = (of["at_"][some], of["y_"][some], got[some]) if some.any() else (np.array([-1]), np.array([-1]), got[:1])
        block = pa.array([int(kid[0]) // FAN])
        return {"block_": block, **part_of_auc(at, got * (y == 1)[:, None], got * (y == 0)[:, None])}

    parts, mine = deal(rows, reps, seed, strata, ["at_", "y_"], leaf, f"block_ bigint, {PARTIAL}")
    return join_parts(parts, mine).select(*[F.col(m).alias(s) for s, m in zip(strata, mine)], "rep", "auc")


def resampled_auc_of_both(df: DataFrame, reps: int, seed: int, score_a: str, score_b: str, label: str, strata: Sequence[str] = (), slices=None) -> DataFrame:
    """(s, strata, rep, auc) of two scores, ``s`` a and b, on the same row resamples of each stratum.

    Cells cannot lie in the order of both scores. So a part sends its counts on, summed per score and class, as one list per
    chunk of replicates, to the range of scores where they belong.
    """
    rows = count_cells(df, [score_a, score_b, label], strata, slices)
    for k, c in enumerate((score_a, score_b)):
        rows = places(rows, F.col(c).cast("double"), strata, f"at_{k}", slices)
    rows = materialize(rows.withColumn("y_", _signs(label)))

    def leaf(kid: np.ndarray, got: np.ndarray, of: dict) -> dict[str, pa.Array]:
        s, at, y, have = [], [], [], []
        for k in range(2):
            use = np.flatnonzero((of[f"at_{k}"] >= 0) & (of["y_"] >= 0) & got.any(1))
            code, back = np.unique(of[f"at_{k}"][use] * 2 + of["y_"][use], return_inverse=True)
            total = np.zeros((len(code), got.shape[1]), np.int64)
            np.add.at(total, back, got[use])
            s.append(np.full(len(code), k, np.int32)), at.append(code // 2), y.append(code % 2), have.append(total)
        return {"s_": pa.array(np.concatenate(s)), "at_": pa.array(np.concatenate(at)), "y_": pa.array(np.concatenate(y)), "have_": lists(np.concatenate(have))}

    counts, mine = deal(rows, reps, seed, strata, ["at_0", "at_1", "y_"], leaf, "s_ int, at_ bigint, y_ bigint, have_ array<bigint>")
    keys = ["s_", *mine]
    counts = counts.withColumn("block_", F.floor(F.col("at_") / FAN).cast("long"))

    def part(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        y, have = t["y_"].to_numpy(), t["have_"].chunk(0).flatten().to_numpy().reshape(t.num_rows, -1)
        made = part_of_auc(t["at_"].to_numpy(), have * (y == 1)[:, None], have * (y == 0)[:, None])
        return pa.table({**{c: t[c].slice(0, 1) for c in [*keys, "block_", "chunk_"]}, **made})

    schema = StructType([*[counts.schema[c] for c in [*keys, "block_", "chunk_"]], *StructType.fromDDL(PARTIAL).fields])
    parts = counts.groupBy(*keys, "block_", "chunk_").applyInArrow(part, schema)
    return join_parts(parts, keys).select(F.when(F.col("s_") == 0, "a").otherwise("b").alias("s"), *[F.col(m).alias(s) for s, m in zip(strata, mine)], "rep", "auc")


def cluster_auc(cells: DataFrame, draws: DataFrame, group: str, slices=None) -> DataFrame:
    """(rep, auc) of resamples of whole groups from ``cells`` (group, score, pos, neg) and ``draws`` (rep, group, times).

    The cells of a group in a range of scores are one row, which meets one list of draws per chunk of replicates.
    """
    ship(cells.sparkSession)
    cells = places(cells, F.col("score"), [], "at_", slices).withColumn("block_", F.floor(F.col("at_") / FAN).cast("long"))
    lots = cells.groupBy(group, "block_").agg(F.collect_list(F.struct("at_", "pos", "neg")).alias("c_"))
    lots = lots.select(group, "block_", *[F.col(f"c_.{c}").alias(c) for c in ("at_", "pos", "neg")])
    dealt = draws.groupBy(group, F.floor(F.col("rep") / CHUNK).cast("int").alias("chunk_")).agg(F.collect_list(F.struct((F.col("rep") % CHUNK).alias("k_"), "times")).alias("t_"))
    dealt = dealt.select(group, "chunk_", F.col("t_.k_").alias("k_"), F.col("t_.times").alias("times"))
    last = draws.agg(F.max("rep")).first()[0]

    def part(t: pa.Table) -> pa.Table:
        chunk = t["chunk_"][0].as_py()
        at, pos, neg = [], [], []
        for r in range(t.num_rows):
            have = np.zeros(min(CHUNK, last + 1 - chunk * CHUNK), np.int64)
            have[np.array(t["k_"][r].values)] = np.array(t["times"][r].values)
            at.append(np.array(t["at_"][r].values))
            pos.append(np.array(t["pos"][r].values)[:, None] * have)
            neg.append(np.array(t["neg"][r].values)[:, None] * have)
        return pa.table({"block_": t["block_"].slice(0, 1), "chunk_": t["chunk_"].slice(0, 1), **part_of_auc(np.concatenate(at), np.concatenate(pos), np.concatenate(neg))})

    met = lots.join(dealt, group).select("block_", "chunk_", "at_", "pos", "neg", "k_", "times")
    return join_parts(met.groupBy("block_", "chunk_").applyInArrow(part, f"block_ long, chunk_ int, {PARTIAL}"), [])
