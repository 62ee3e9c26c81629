"""Statistics of whole texts, an Arrow batch at a time."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = r"[#*$%&|<>]"
GRAM = 5
PART = 2_000_000

#: Counted inside Python, then by patterns over the whole batch.
COUNTS = ["n_chars", "n_words", "word_chars", "n_repeat_words", "n_distinct", "longest_word", "adjacent", "n_lines", "n_dup_lines", "n_symbols", "n_upper", "n_digits", "n_marks", "n_bars"]
_PATTERNS = {"n_symbols": SYMBOLS, "n_upper": r"\p{Lu}", "n_digits": r"\p{Nd}", "n_marks": r"[!?]"}


def _repeated(words: list[str]) -> int:
    """Words inside windows of GRAM words that occur twice or more, the first occurrence too."""
    grams = list(zip(*[words[k:] for k in range(GRAM)]))
    if len(set(grams)) == len(grams):
        return 0
    counts: dict[tuple, int] = {}
    for g in grams:
        counts[g] = counts.get(g, 0) + 1
    total = end = 0
    for at, g in enumerate(grams):
        if counts[g] > 1:
            total += at + GRAM - max(at, end)
            end = at + GRAM
    return total


def text_counts(texts: pd.Series) -> pd.DataFrame:
    """A row of COUNTS per text, worked out some PART characters at a time; a null text counts as empty."""
    texts = texts.fillna("")
    size = texts.str.len().to_numpy(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(size + 1) // PART, prepend=-1)).tolist()
    parts = [_counts(texts.iloc[lo:hi].tolist()) for lo, hi in zip(cuts, [*cuts[1:], len(texts)])]
    return pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64), columns=COUNTS)


def _counts(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    for k, t in enumerate(texts):
        words, lines = WORD.findall(t), t.split("\n")
        full = [x for x in lines if WORD.search(x)]
        out[k, :9] = (len(t), len(words), sum(map(len, words)), _repeated(words), len(set(words)), max(map(len, words), default=0), sum(map(str.__eq__, words, words[1:])), len(lines), len(full) - len(set(full)))
        out[k, 13] = t.count("|")
    column = pa.array(texts, pa.large_string())
    for name, pattern in _PATTERNS.items():
        out[:, COUNTS.index(name)] = pc.count_substring_regex(column, pattern).to_numpy(zero_copy_only=False)
    return out
