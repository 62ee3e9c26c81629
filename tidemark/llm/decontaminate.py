"""Benchmark decontamination by exact TF-IDF retrieval and word-order checks.

Documents are cut into passages of PASSAGE words, half overlapping. A passage is a TF-IDF vector over the words of the
benchmark, with document frequencies counted over all passages. Texts are split once, into a table of the numbers of
their benchmark words, which both passes read.

The space is that of the words themselves, not a reduced one. A randomised SVD of the passages was tried and given up, since
leading directions of a corpus say little about which item a passage holds: figures are in the README. In the whole
space a cosine is exact, and an inverted index finds all pairs over the threshold.

An item longer than a passage is searched by its pieces of PASSAGE words, the last one shifted back to be whole; a hit on any
piece makes the item a candidate. A passage hits a piece by its cosine, or by COVER: the share of the piece's squared weights
that the passage has too, whatever else is in it, since the cosine of a copy of a few words falls with the rest of the passage.

Passages need not meet all items. The most frequent words are set aside as long as they alone cannot bring any item to
the threshold; a pair over it then shares another word, which an index of the items lists. Pairs from the index
whose shared words and an upper bound for the rest stay under the threshold are skipped, the others are worked out.

A candidate is checked on the words around the passage: the longest common subsequence with the whole item, as a share of
the item's words (pieces between white space, in lower case, without signs at their ends). From SAME on it is a leak; from PARAPHRASE on it is one if the answer (the item's last sentence) is
there too, by ANSWER of its words in order.

Benchmarks of more than BLOCK pieces are worked off in blocks of about that size, read from the table one after the other, so
that what the driver holds and sends to the tasks is bounded by BLOCK and the longest item. A block costs two passes.

Defined cases: null or empty texts leak nothing; items without words are ignored; rows that repeat are judged alike, each
on its own; an empty benchmark finds nothing. Items that repeat each report. Other columns pass through, whatever their
names. An empty table of documents gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Ids, by_bytes, fixed, forget, free_names, ship
from tidemark.llm.shingles import plain

PASSAGE = 64
HALF = PASSAGE // 2
BLOCK = 8192  # pieces of items that are searched at a time
COSINE = 0.35
COVER = 0.35
SAME = 0.8
PARAPHRASE = 0.5
ANSWER = 0.6
SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
LEAK = "i long, r long, item_id long, cosine double, lcs double, answer double, word long"


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct pieces between white space, number of the piece at each place, pieces per text)."""
    text = pc.ascii_trim_whitespace(plain(texts))
    parts = pc.ascii_split_whitespace(text)
    n = np.where(pc.equal(text, "").to_numpy(zero_copy_only=False), 0, np.diff(parts.offsets.to_numpy()))
    coded = parts.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    if (n == 0).any():  # an empty text splits into one empty piece
        code = code[np.repeat(n > 0, np.maximum(n, 1))]
    return coded.dictionary, code, n


def word(piece: str) -> str:
    """The piece in lower case without signs at its ends."""
    return piece.strip(SIGNS).lower() if piece.isascii() else EDGE.sub("", piece).lower()


def piece_starts(n: int) -> list[int]:
    """First words of the pieces of an item of n words."""
    return [*range(0, n - PASSAGE, PASSAGE), max(n - PASSAGE, 0)]


@dataclass
class Items:
    """A block of benchmark items over their own vocabulary."""

    ids: list[int]
    terms: dict[str, int]
    words: list[list[int]]
    answers: list[list[int]]

    @staticmethod
    def of(rows: Sequence[tuple[int, str]]) -> "Items":
        last = [([x for x in re.split(r"[.!?\n]+", t) if re.search(r"\w", x)] or [""])[-1] for _, t in rows]
        names, code, n = split_words(pa.array([t for _, t in rows] + last, pa.string()))
        names = [word(x) for x in names.to_pylist()]
        terms: dict[str, int] = {}
        for k in code.tolist():
            if names[k]:
                terms.setdefault(names[k], len(terms))
        code, end = code.tolist(), np.cumsum(n).tolist()
        lists = [[terms[names[c]] for c in code[e - k:e] if names[c]] for e, k in zip(end, n.tolist())]
        keep = [k for k in range(len(rows)) if lists[k]]
        return Items([rows[k][0] for k in keep], terms, [lists[k] for k in keep], [lists[len(rows) + k] for k in keep])

    @property
    def pieces(self) -> list[tuple[int, list[int]]]:
        """(number of the item, words) of what is searched: whole items, or each PASSAGE words of longer ones."""
        return [(k, w[x:x + PASSAGE]) for k, w in enumerate(self.words) for x in piece_starts(len(w))]

    @property
    def kind(self) -> np.dtype:
        return np.dtype("<i2" if len(self.terms) < 1 << 15 else "<i4")

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Term of every word (-1: not of the benchmark), and words per text; pieces without a letter or digit are none."""
        names, code, n = split_words(texts)
        get = self.terms.get
        term = np.fromiter((get(w, -1) if (w := word(x)) else -2 for x in names.to_pylist()), np.int64, len(names))[code] if len(names) else np.zeros(0, np.int64)
        full = term > -2
        if not full.all():
            n = np.bincount(np.repeat(np.arange(len(n)), n)[full], minlength=len(n))
            term = term[full]
        return term, n


def passages(term: np.ndarray, n: np.ndarray, vocabulary: int, overlap: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(passage, term, count) of every benchmark word in a passage, then the document and first word of each passage."""
    per = np.maximum(-(-n // HALF) - 1, 1) * (n > 0)
    base = np.cumsum(per) - per
    doc = np.repeat(np.arange(len(n)), n)
    half = (np.arange(len(term)) - np.repeat(np.cumsum(n) - n, n)) // HALF
    own, which = [], []
    for back in (0, 1):
        j = half - back
        ok = (term >= 0) & (j >= 0) & (j < per[doc])
        if not overlap:
            ok &= (j % 2 == 0)
        own.append((base[doc] + j)[ok])
        which.append(term[ok])
    key, count = np.unique(np.concatenate(own) * vocabulary + np.concatenate(which), return_counts=True)
    owner = np.repeat(np.arange(len(n)), per)
    first = (np.arange(len(owner)) - np.repeat(base, per)) * HALF
    return key // vocabulary, key % vocabulary, count, owner, first


def coded_words(docs: DataFrame, items: Items, doc_id: str, text: str) -> DataFrame:
    """A row per row of ``docs`` with words: ``i``, ``r`` (id and text hash) and ``w``, its words' terms, compressed."""
    own = docs.select(F.col(text).alias("t"), Ids(docs, doc_id).inner(doc_id).alias("i"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("r")).where(F.length("t") > 0)
    kind = items.kind

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for part in by_bytes(batches, "t"):
            term, n = items.codes(part.column(0))
            end = np.cumsum(n)
            raw = term.astype(kind)
            yield pa.RecordBatch.from_pydict({"i": part.column(1), "r": part.column(2), "w": [press.compress(raw[x:y].tobytes()) for x, y in zip(end - n, end)]})

    return own.mapInArrow(code, "i long, r long, w binary")


def _coded(batches: Iterator[pa.RecordBatch], kind: np.dtype, rows: int = 1000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, terms of all their words, words per row)."""
    grow = zstandard.ZstdDecompressor()
    for b in by_bytes(batches, "w", most=256 << 10):
        for lo in range(0, b.num_rows, rows):
            part = b.slice(lo, rows)
            words = [np.frombuffer(grow.decompress(x), kind) for x in part.column("w").to_pylist()]
            yield part, np.concatenate(words).astype(np.int64), np.array([len(x) for x in words])


def term_frequencies(coded: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """Passages that hold each term, and passages in all, over the whole corpus."""
    size, kind = len(items.terms), items.kind

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(size + 1, np.int64), 0
        for _, words, n in _coded(batches, kind):
            _, term, _, owner, first = passages(words, n, size, overlap=False)
            df[:size] += np.bincount(term, minlength=size)
            total += int((first % PASSAGE == 0).sum())
        df[size] = total
        yield pa.RecordBatch.from_pydict({"k": np.flatnonzero(df), "n": df[df > 0]})

    got = coded.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(size + 1, np.int64)
    for r in got:
        df[r.k] = r.n
    return df[:size], int(df[size])


def weights(count: np.ndarray, term: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(count)) * idf[term]


def item_vectors(items: Items, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries of unit vectors of the items' pieces (piece, term, weight), by piece and term, and the lengths before."""
    piece, term, weight = [], [], []
    for k, (_, w) in enumerate(items.pieces):
        t, count = np.unique(w, return_counts=True)
        piece.append(np.full(len(t), k))
        term.append(t)
        weight.append(weights(count, t, idf))
    piece, term, weight = map(np.concatenate, (piece, term, weight))
    length = np.sqrt(np.bincount(piece, weight * weight))
    return piece, term, weight / length[piece], length


def common_subsequence(a: Sequence[int], b: Sequence[int]) -> int:
    """Length of the longest common subsequence, a bit per word of ``a``."""
    masks: dict[int, int] = {}
    for k, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = masks.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Search:
    """What a task needs to find the leaks of a block of items."""

    def __init__(self, items: Items, idf: np.ndarray):
        self.items, self.idf = items, idf
        piece, term, weight, self.length = item_vectors(items, idf)
        many = len(self.length)
        self.owner = np.array([k for k, _ in items.pieces])
        self.key, self.value = piece * len(idf) + term, weight  # entries by piece and term
        # Frequent words first; those are common that together stay under the threshold with every item.
        order = np.argsort(idf, kind="stable")
        rank = np.empty(len(idf), np.int64)
        rank[order] = np.arange(len(idf))
        reach = lambda m: np.sqrt(np.bincount(piece, np.where(rank[term] < m, weight * weight, 0.0), many).max())
        lo, hi = 0, len(idf)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if reach(mid) < 0.95 * COSINE else (lo, mid - 1)
        self.common = rank < lo
        usual = self.common[term]
        self.rest = np.sqrt(np.bincount(piece[usual], weight[usual] ** 2, many))  # of each piece, in common words
        at = np.flatnonzero(~usual)
        at = at[np.argsort(term[at], kind="stable")]
        self.entry = np.searchsorted(term[at], np.arange(len(idf) + 1))  # pieces of term t: entry[t] to entry[t + 1]
        self.item, self.weight = piece[at], weight[at]

    def candidates(self, term: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(document, first word, item, best cosine) of the passages near a piece of an item, or that cover one."""
        row, t, count, owner, first = passages(term, n, len(self.idf), overlap=True)
        val = weights(count, t, self.idf)
        norm = np.sqrt(np.bincount(row, val * val, len(owner)))
        usual = self.common[t]
        common = np.sqrt(np.bincount(row[usual], val[usual] ** 2, len(owner)))
        k = np.flatnonzero(~usual)
        size = self.entry[t[k] + 1] - self.entry[t[k]]
        at = np.repeat(self.entry[t[k]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        pair, back = np.unique(np.repeat(row[k], size) * len(self.rest) + self.item[at], return_inverse=True)
        shared = np.bincount(back, np.repeat(val[k], size) * self.weight[at], len(pair))
        p, item = pair // len(self.rest), pair % len(self.rest)
        both = np.minimum(np.repeat(val[k], size) / self.length[self.item[at]], self.weight[at])
        covers = np.bincount(back, both * self.weight[at], len(pair)) + self.rest[item] ** 2 >= COVER
        near = covers | (shared + common[p] * self.rest[item] >= COSINE * norm[p])
        p, item, covers, shared = p[near], item[near], covers[near], shared[near]
        if not len(p):
            return
        # The common words of the passage add the rest of the cosine.
        low, r = np.flatnonzero(usual), row[usual]
        begin, size = np.searchsorted(r, p), np.searchsorted(r, p, "right") - np.searchsorted(r, p)
        of = np.repeat(np.arange(len(p)), size)
        at = low[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        want = item[of] * len(self.idf) + t[at]
        found = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        cosine = (shared + np.bincount(of, np.where(self.key[found] == want, self.value[found], 0.0) * val[at], len(p))) / norm[p]
        hit = covers | (cosine >= COSINE)
        pair, back = np.unique(p[hit] * len(self.items.ids) + self.owner[item[hit]], return_inverse=True)
        best = np.full(len(pair), -np.inf)
        np.maximum.at(best, back, cosine[hit])
        for x, k, c in zip((pair // len(self.items.ids)).tolist(), (pair % len(self.items.ids)).tolist(), best.tolist()):
            yield int(owner[x]), int(first[x]), k, c

    def leaks(self, term: np.ndarray, n: np.ndarray) -> list[tuple[int, dict]]:
        """(document, leak) for the best place of each item that a document leaks."""
        end = np.cumsum(n)
        best: list[dict[int, dict]] = [{} for _ in range(len(n))]
        for doc, first, k, cosine in self.candidates(term, n):
            item, answer = self.items.words[k], self.items.answers[k]
            lo = end[doc] - n[doc]
            near = term[lo + max(first - len(item), 0):min(lo + first + PASSAGE + len(item), end[doc])].tolist()
            lcs = common_subsequence(item, near) / len(item)
            if lcs < PARAPHRASE:
                continue
            told = common_subsequence(answer, near) / len(answer) if answer else 1.0
            if (lcs >= SAME or told >= ANSWER) and (k not in best[doc] or best[doc][k]["lcs"] < lcs):
                best[doc][k] = {"item_id": self.items.ids[k], "cosine": cosine, "lcs": lcs, "answer": told, "word": first}
        return [(doc, x) for doc, b in enumerate(best) for x in b.values()]


def fit(coded: DataFrame, items: Items) -> Search:
    df, total = term_frequencies(coded, items)
    return Search(items, np.log((1 + total) / (1 + df)) + 0.1)


def blocks(rows: Iterable[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most BLOCK pieces; an item of more is a block of its own."""
    block, size = [], 0
    for row in rows:
        n = len(piece_starts(len(row[1].split())))
        if block and size + n > BLOCK:
            yield block
            block, size = [], 0
        block.append(row)
        size += n
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``docs`` and item that it leaks: ``i``, ``r`` (id and text hash), item_id, cosine, lcs, answer, word."""
    spark = docs.sparkSession
    ship(spark)
    known = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    out = spark.createDataFrame([], LEAK)
    for block in blocks((r.item_id, r.text) for r in known.orderBy("item_id", "text").toLocalIterator()):
        items = Items.of(block)
        if not items.ids:
            continue
        coded = fixed(coded_words(docs, items, doc_id, text))
        search = fit(coded, items)

        def find(batches: Iterator[pa.RecordBatch], search: Search = search) -> Iterator[pa.RecordBatch]:
            for part, words, n in _coded(batches, search.items.kind, 500):
                found = search.leaks(words, n)
                if found:
                    at = np.array([doc for doc, _ in found])
                    yield pa.RecordBatch.from_pydict({"i": part.column("i").to_numpy()[at], "r": part.column("r").to_numpy()[at], **{k: [x[k] for _, x in found] for k in found[0][1]}})

        out = out.unionAll(fixed(coded.mapInArrow(find, LEAK)))
        forget(coded)
    return out


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document and leaked item: doc_id, item_id, cosine, lcs, answer, word."""
    found = find_leaks(docs, benchmark)
    return found.select(Ids(docs, "doc_id").outer("i").alias("doc_id"), "item_id", "cosine", "lcs", "answer", "word")


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that leak no item."""
    key, row, i, r = free_names(docs, "key", "row", "leak_key", "leak_row")
    gone = find_leaks(docs, benchmark, doc_id, text).select(F.col("i").alias(i), F.col("r").alias(r)).distinct()
    own = docs.withColumns({key: Ids(docs, doc_id).inner(doc_id), row: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    return own.join(gone, (F.col(key) == F.col(i)) & (F.col(row) == F.col(r)), "left_anti").drop(key, row)
