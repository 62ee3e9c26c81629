"""Mixing sources to target weights: a Pfair schedule of blocks.

Documents of a source are shuffled by hash and cut into blocks of ``block`` documents. With integer weights q_s of sum W,
block k (from 1) of source s is released at slot floor((k-1) W / q_s) and must be placed before
its deadline ceil(k W / q_s); each slot takes the released block with the earliest deadline. On one processor at full
load this is feasible, so after any number t of slots a source has had t q_s / W blocks, off by less than one. The
schedule repeats after W slots, so one period is laid out on the driver (at most ``MAX_PERIOD`` slots, whatever the
data) and every block finds its slot by arithmetic and a lookup in that table.

All documents are placed. When a source has used its last block, the phase ends, and the next phase shares the slots
among the sources that are left, by the same weights; within each phase the deviation stays under one block.

Defined cases: a null source, and any source without a stated weight, belongs to the group ``OTHER``, which has a weight
of its own. Rows that repeat an id are ordered by the hash of their text; rows equal in both are interchangeable.
A null id takes part like any other. An empty table gives no rows. Other columns pass through, whatever their names;
those called like the added ones are replaced.

Texts travel once, to their file: rows are numbered in 2^BITS parts of a source by hash, so that the part that a task sorts is
a 65,536th of a source, and the counts of the parts are summed up by a window over that small table.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from heapq import heappop, heappush
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fixed, free_names

OTHER = "(other)"
SMALL = 100_000  # rows of a slot table that is broadcast
BLOCK = 16
BITS = 16  # of the hash that deals a source to parts
ADDED = ["mix_source", "mix_phase", "mix_block", "mix_slot", "mix_rank"]


def period(weights: Mapping[str, int], slots: int | None = None) -> list[tuple[str, int]]:
    """Source and number (from 0) of the block in each slot of one period, or of its first ``slots``."""
    total = sum(weights.values())
    if any(q <= 0 or q != int(q) for q in weights.values()):
        raise ValueError("weights must be positive integers")
    later = [(0, -(-total // q), s, 0) for s, q in sorted(weights.items())]  # release, deadline, source, number
    later.sort()
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(total if slots is None else min(total, slots)):
        while later and later[0][0] <= slot:
            _, deadline, s, k = heappop(later)
            heappush(ready, (deadline, s, k))
        deadline, s, k = heappop(ready)
        out.append((s, k))
        if k + 1 < weights[s]:
            heappush(later, ((k + 1) * total // weights[s], -(-(k + 2) * total // weights[s]), s, k + 1))
    return out


def phases(blocks: Mapping[str, int], weights: Mapping[str, int]) -> list[dict]:
    """A dict per phase: ``begin`` (its first slot), ``total`` (slots of a period) and by source ``span``: (first block, end block, weight, slots in the period).

    ``blocks``: blocks that each source has. A phase lists at most one period, and no slot after its end.
    """
    used = {s: 0 for s, n in blocks.items() if n}
    out, begin = [], 0
    while used:
        shared = reduce(gcd, [weights[s] for s in used])
        q = {s: weights[s] // shared for s in used}
        total = sum(q.values())
        left = {s: blocks[s] - used[s] for s in used}
        # The first source to run out does so before all blocks that are left have had a slot.
        table = period(q, sum(left.values()))
        slots: dict[str, list[int]] = {s: [] for s in used}
        for slot, (s, _) in enumerate(table):
            slots[s].append(slot)
        last = {s: (left[s] - 1) // q[s] * total + slots[s][(left[s] - 1) % q[s]] for s in used if (left[s] - 1) % q[s] < len(slots[s])}
        end = min(last.values()) + 1  # the slot after the last block of the first source that runs out
        span = {}
        for s in list(used):
            own = np.array(slots[s], np.int64)
            took = end // total * q[s] + int((own < end % total).sum())
            span[s] = (used[s], used[s] + took, q[s], own[:took])
            used[s] += took
            if used[s] == blocks[s]:
                del used[s]
        out.append({"begin": begin, "total": total, "span": span})
        begin += end
    return out


def mix(docs: DataFrame, weights: Mapping[str, int], other: int = 1, block: int = BLOCK, source: str = "source", doc_id: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """The documents with ``mix_source``, ``mix_phase``, ``mix_block`` (of the source), ``mix_slot`` and ``mix_rank`` (in the block)."""
    spark = docs.sparkSession
    q = {**weights, OTHER: other}
    base = docs.drop(*[c for c in ADDED if c not in (source, doc_id, text)])
    key, part, before, n, lo, hi, weight, total, begin, turn, k, slot = free_names(base, "key", "part", "before", "n", "lo", "hi", "weight", "total", "begin", "turn", "k", "slot")
    group = F.when(F.col(source).isin(list(weights)), F.col(source)).otherwise(F.lit(OTHER))
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.hex(F.xxhash64(F.coalesce(F.col(text), F.lit(""))))))
    own = base.withColumns({"mix_source": group, key: hashed})
    own = own.withColumn(part, F.shiftright(F.conv(F.substring(key, 1, 4), 16, 10).cast("int"), 16 - BITS))
    counts = own.groupBy("mix_source", part).agg(F.count(F.lit(1)).alias(n))
    sums = Window.partitionBy("mix_source").orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = fixed(counts.withColumn(before, F.sum(n).over(sums) - F.col(n)))
    have = {r[0]: r[1] for r in offsets.groupBy("mix_source").agg(F.sum(n)).collect()}  # a row per stated source
    plan = phases({s: -(-c // block) for s, c in have.items()}, q)
    spans = spark.createDataFrame([(s, p, x[0], x[1], x[2], f["total"], f["begin"]) for p, f in enumerate(plan) for s, x in f["span"].items()],
                                  f"mix_source string, mix_phase int, `{lo}` long, `{hi}` long, `{weight}` long, `{total}` long, `{begin}` long")
    rows = sum(len(x[3]) for f in plan for x in f["span"].values())
    parts = [pd.DataFrame({"mix_source": s, "mix_phase": np.int32(p), k: np.arange(len(x[3])), slot: x[3]}) for p, f in enumerate(plan) for s, x in f["span"].items()]
    slots = spark.createDataFrame(pd.concat(parts) if parts else [], f"mix_source string, mix_phase int, `{k}` long, `{slot}` long")
    slots = F.broadcast(slots) if rows <= SMALL else fixed(slots)

    w = Window.partitionBy("mix_source", part).orderBy(key)
    own = own.withColumn(n, F.row_number().over(w) - 1).join(offsets.drop(n), ["mix_source", part])
    own = own.withColumn(n, F.col(n) + F.col(before))
    own = own.withColumns({"mix_block": F.floor(F.col(n) / block), "mix_rank": F.pmod(F.col(n), F.lit(block))})
    # A row per source and phase, and no more phases than sources.
    inside = (own["mix_source"] == spans["mix_source"]) & (own["mix_block"] >= spans[lo]) & (own["mix_block"] < spans[hi])
    own = own.join(F.broadcast(spans), inside).drop(spans["mix_source"])
    own = own.withColumn(n, F.col("mix_block") - F.col(lo))
    own = own.withColumns({turn: F.floor(F.col(n) / F.col(weight)), k: F.pmod(F.col(n), F.col(weight))})
    own = own.join(slots, ["mix_source", "mix_phase", k])
    own = own.withColumn("mix_slot", F.col(begin) + F.col(turn) * F.col(total) + F.col(slot))
    return own.select(*base.columns, *[c for c in ADDED if c not in base.columns])


def mixed_order(docs: DataFrame, **kw) -> DataFrame:
    """The documents alone, stored in the order of the mix: files in turn, rows in turn."""
    by = ["mix_slot", "mix_rank"]
    clash = dict(zip(ADDED, free_names(docs, *(f"own_{c}" for c in ADDED))))  # columns of the input keep their values
    held = docs.withColumnsRenamed({c: clash[c] for c in docs.columns if c in ADDED})
    out = mix(held, **kw).repartitionByRange(*by).sortWithinPartitions(*by).drop(*ADDED)
    return out.withColumnsRenamed({v: c for c, v in clash.items()}).select(docs.columns)
