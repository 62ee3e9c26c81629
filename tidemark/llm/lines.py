"""Line deduplication: range-partitioned line hashes, streamed first occurrences, keep bitmaps.

Only DataFrame functions. Lines travel as 96-bit hashes; texts are shuffled once, for the join with their bitmaps.
The hashes are range-partitioned and sorted by (hash, document, position), and one pass of a window over each run of
equal hashes streams its first document. A line that a large part of the corpus shares would be one run in one task, so
a mergeable frequent-items sketch of fixed size names such runs; their first documents come from an aggregate with
map-side combining (at most ``HOT_KEYS`` rows, broadcast) and their lines are never sorted. The sketch decides only
which of the two equal ways a line takes, so that what it misses or adds changes no row.

Defined cases: a null or empty text is one empty line. Rows with a null id are one document after all others. Rows that
repeat an id are one document; each row is judged on its own lines. Other columns pass through untouched, and
columns of the input called like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, Ids, ascii_lower, fixed, free_names

HOT_KEYS = 1000  # entries of the sketch, and so the bound of the broadcast table
HOT_TRACKED = 10_000
HOT_LINES = 256  # a run of fewer lines is sorted like any other
_WORD = 64


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _row_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10, ids: Ids | None = None) -> DataFrame:
    """One row per (id, row hash) that loses lines: ``words``, the non-empty 64-bit words of its drop bitmap by number.

    A bit that is set (or a word that is missing: none is) marks a line to drop, so the keep bitmap is the complement;
    words without a dropped line are left out, which is the compression.
    """
    ids = ids or Ids(docs, doc_id)
    lines = docs.select(ids.inner(doc_id).alias("i"), _row_key(text).alias("r"), F.posexplode(split_lines(F.col(text))).alias("p", "line"))
    lines = lines.select("i", "r", "p", line_key(F.col("line")).alias("k")).where(F.length("k") >= min_chars)
    lines = fixed(lines.select("i", "r", "p", F.xxhash64("k").alias("h"), F.hash("k").alias("g")))
    sketch = lines.agg(F.expr(f"approx_top_k(h, {HOT_KEYS}, {HOT_TRACKED})").alias("t")).select(F.explode("t").alias("t"))
    hot = F.broadcast(sketch.where(F.col("t.count") >= HOT_LINES).select(F.col("t.item").alias("h")))
    w = Window.partitionBy("h", "g").orderBy("i", "p")
    cold = lines.join(hot, "h", "left_anti").repartitionByRange("h", "g").withColumn("first", F.first("i").over(w))
    warm = lines.join(hot, "h", "left_semi")
    firsts = F.broadcast(warm.groupBy("h", "g").agg(F.min("i").alias("first")))
    seen = [x.where(F.col("i") > F.col("first")).select("i", "r", "p") for x in (cold, warm.join(firsts, ["h", "g"]))]
    words = seen[0].unionAll(seen[1]).groupBy("i", "r", F.floor(F.col("p") / _WORD).cast("int").alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, p % {_WORD})")).alias("bits"))
    return words.groupBy("i", "r").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("w", "bits")))).alias("words"))


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """The documents with ``n_lines``, ``n_dropped`` and ``kept_text``.

    A line's key is the line stripped of white space at both ends, A-Z lower-cased. Keys of at least ``min_chars`` code
    points that two or more documents hold lose all their lines but those of the smallest id.
    """
    base = docs.drop("n_lines", "n_dropped", "kept_text")
    ids = Ids(docs, doc_id)
    k, t, i, r, words = free_names(base, "key", "row", "own_key", "own_row", "words")
    maps = keep_bitmaps(docs, doc_id, text, min_chars, ids).withColumnsRenamed({"i": i, "r": r}).withColumnRenamed("words", words)
    keyed = base.withColumns({k: ids.inner(doc_id), t: _row_key(text)})
    both = keyed.join(maps, (F.col(k) == F.col(i)) & (F.col(t) == F.col(r)), "left")
    lines = split_lines(F.col(text))
    kept = F.filter(lines, lambda x, n: F.coalesce(F.getbit(F.element_at(words, F.floor(n / _WORD).cast("int")), F.pmod(n, F.lit(_WORD))), F.lit(0)) == 0)
    n_dropped = F.aggregate(F.map_values(words), F.lit(0).cast("long"), lambda a, x: a + F.bit_count(x))
    out = both.withColumns({
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.coalesce(n_dropped, F.lit(0).cast("long")),
        "kept_text": F.when(F.col(words).isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(kept, "\n")),
    })
    return out.drop(k, t, i, r, words)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what is left, for each row."""
    return drop_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
