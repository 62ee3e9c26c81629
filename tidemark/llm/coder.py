"""Token ids of many texts with a file of the tokenizers library: exact, fast on repeated words, in bounded memory.

Two families of files are known by their settings, and cut where their own patterns must cut:

- ``spaced``: byte-level BPE whose words carry the space before them. A text of ordinary characters is cut before a
  single space and around a single line feed; every other text is encoded whole.
- ``dropped``: BPE with word ends, white space dropped. Any text may be cut at any space or line feed, as nothing
  reaches across white space.

Each distinct piece of a batch is parted into letters and trailing signs, where both patterns part, and the ids of the
texts are put together with numpy. A text that contains an added token goes whole, and so does every text under a file
of another family. Encoded parts are kept in flat arrays, found by hash and compared in full, of ``CACHE_BYTES`` together:
when they are full, the parts that no batch has met since the last time go. A coder lives as long as the task that made it.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

CACHE_BYTES = 12 << 20
BATCH_BYTES = 4 << 20
# Space characters besides the space and the line feed, and others that some tables count as such: texts with them go whole.
_ODD = r"[\x00-\x09\x0b-\x1f\x7f-\x{a0}\x{ad}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]|  | \n|\n |\n\n|\A[ \n]|[ \n]\z"
# Letters of Latin alphabets that every Unicode table knows as such and whose small form is one letter.
_LETTERS = r"\A ?[A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž]+\z"
_SIGNS = "!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~-"
_SPACES = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
_DROPPED = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes are themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


def family(settings: dict) -> str:
    """``spaced``, ``dropped`` or ``other``, from the settings of a tokenizer file."""
    cut, norm = settings.get("pre_tokenizer") or {}, settings.get("normalizer")
    if norm is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space"):
        return "spaced"
    steps = (norm or {}).get("normalizers") or []
    cuts = cut.get("pretokenizers") or []
    if ([x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1] == _SPACES and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["pattern"] == {"Regex": _DROPPED} and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]):
        return "dropped"
    return "other"


class _Parts:
    """Serialized ids of parts met before: words, their hashes in order, and one flat array of ids."""

    def __init__(self, kind: np.dtype):
        self.kind = kind
        self._set(pa.array([], pa.large_string()), np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, kind))

    def _set(self, words: pa.Array, hashes: np.ndarray, ends: np.ndarray, ids: np.ndarray, met: np.ndarray | None = None) -> None:
        self.words, self.hashes, self.ends, self.ids = words, hashes, ends, ids
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        self.met = np.zeros(len(hashes), bool) if met is None else met

    def _trim(self) -> None:
        """Past the bound, only what was met since the last time stays; past half of it then, nothing."""
        size = lambda: self.words.nbytes + self.ids.nbytes + 33 * len(self.hashes)
        for keep in (np.flatnonzero(self.met), np.zeros(0, np.int64)):
            if size() > CACHE_BYTES / (1 if len(keep) else 2):
                n = np.diff(self.ends)[keep]
                at = np.repeat(self.ends[keep] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                self._set(self.words.take(pa.array(keep)), self.hashes[keep], np.concatenate([[0], np.cumsum(n)]), self.ids[at])

    def find(self, parts: pa.Array, encode) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) in ``ids`` of each of distinct parts; ``encode(numbers)`` yields the ids of those parts, which are new."""
        self._trim()
        h = pd.util.hash_array(parts.to_numpy(zero_copy_only=False), categorize=False) if len(parts) else np.zeros(0, np.uint64)
        at = np.zeros(len(h), np.int64)
        known = np.zeros(len(h), bool)
        if len(self.hashes):
            at = self.order[np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)]
            known = (self.hashes[at] == h) & pc.equal(self.words.take(pa.array(at)), parts).to_numpy(zero_copy_only=False)
            self.met[at[known]] = True
        new = np.flatnonzero(~known)
        if len(new):
            fresh = parts.take(pa.array(new))
            ids, ends = array(self.kind.char), []
            for own in encode(new, fresh):
                ids.extend(own)
                ends.append(len(ids))
            n = np.diff(np.array(ends), prepend=0)
            at[new] = len(self.hashes) + np.arange(len(new))
            self._set(pa.concat_arrays([self.words, fresh]), np.concatenate([self.hashes, h[new]]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(n)]),
                      np.concatenate([self.ids, np.frombuffer(ids, self.kind)]), np.concatenate([self.met, np.ones(len(new), bool)]))
        return self.ends[at], self.ends[at + 1] - self.ends[at]


def _gather(ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` that start and length name, one after the other."""
    end = np.cumsum(n)
    return ids[np.repeat(start - (end - n), n) + np.arange(n.sum())]


_read: dict = {}  # the tokenizer that a worker read last


class Coder:
    """Token ids of many texts; see the module."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        if path not in _read:
            _read.clear()
            _read[path] = Tokenizer.from_file(path)
        self.tok = _read[path]
        part = lambda x: json.loads(x.__getstate__()) if x is not None else None
        self.family = family({"normalizer": part(self.tok.normalizer), "pre_tokenizer": part(self.tok.pre_tokenizer)})
        self.size = self.tok.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 65536 else "<u4")
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.parts = _Parts(self.kind)
        self.feed = self.tok.encode("\n", add_special_tokens=False).ids

    def _whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _new(self, parts: pa.Array, letters: np.ndarray):
        """Ids of each part; parts of letters alone go to the model at once, in the byte-level alphabet."""
        names = parts
        if self.family == "dropped":
            names = pc.if_else(pa.array(letters), pc.utf8_lower(parts), parts)
        names = pc.if_else(pa.array(letters), pc.replace_substring(names, " ", "\u0120"), names)
        high = np.flatnonzero(letters & ~pc.string_is_ascii(parts).to_numpy(zero_copy_only=False))
        names = names.to_pylist()
        for k in high.tolist():
            names[k] = names[k].replace("\u0120", " ").encode().decode("latin-1").translate(self.letters)
        tokenize = self.tok.model.tokenize
        for name, plain in zip(names, letters.tolist()):
            yield [t.id for t in tokenize(name)] if plain else self._whole(name)

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, length) of distinct pieces."""
        stem = pc.ascii_rtrim(pieces, _SIGNS)
        simple = pc.match_substring_regex(stem, _LETTERS)
        stem = pc.if_else(simple, stem, pieces)
        cut, full = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (stem, pieces))
        signed = np.flatnonzero(full > cut)
        offsets, data = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset:][:len(pieces)], np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
        n = (full - cut)[signed]
        tail = _gather(data, (offsets + cut)[signed], n)
        signs = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int64)), pa.py_buffer(tail.tobytes()))
        coded = pa.concat_arrays([stem, signs]).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        letters = np.zeros(len(coded.dictionary), bool)
        letters[code[:len(stem)][simple.to_numpy(zero_copy_only=False)]] = True
        start, n = self.parts.find(coded.dictionary, lambda new, fresh: self._new(fresh, letters[new]))
        first, second = code[:len(stem)], code[len(stem):]
        # A piece's runs: its stem, then its signs if it has some.
        slot = np.arange(len(stem)) + np.searchsorted(signed, np.arange(len(stem)))
        runs = np.empty(len(code), np.int64)
        runs[slot] = first
        runs[slot[signed] + 1] = second
        ids = _gather(self.parts.ids, start[runs], n[runs])
        total = n[first].copy()
        total[signed] += n[second]
        return ids, np.cumsum(total) - total, total

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        if not texts:
            return []
        column = pa.array(texts, pa.large_string())
        whole = pc.match_substring_regex(column, _ODD) if self.family == "spaced" else pa.array([self.family == "other"] * len(texts))
        for a in self.added:
            whole = pc.or_(whole, pc.match_substring(column, a))
        plain, size = [], 0
        for i, (t, odd) in enumerate(zip(texts, whole.to_pylist())):
            if odd or not t:
                out[i] = np.array(self._whole(t), self.kind)
                continue
            plain.append(i)
            size += len(t)
            if size > BATCH_BYTES:
                self._plain([texts[k] for k in plain], plain, out)
                plain, size = [], 0
        if plain:
            self._plain([texts[k] for k in plain], plain, out)
        return out

    def _plain(self, texts: list[str], where: list[int], out: list) -> None:
        """Lines, then pieces, with Arrow; each distinct piece once; ids put together with numpy."""
        spaced = self.family == "spaced"
        lines = pc.split_pattern(pa.array(texts, pa.large_string()), "\n")
        per_doc = np.diff(lines.offsets.to_numpy())
        words = pc.split_pattern(lines.values, " ")
        per_line = np.diff(words.offsets.to_numpy())
        coded = words.values.dictionary_encode()
        kind = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = coded.dictionary
        last_line = np.cumsum(per_doc)
        pieces = np.add.reduceat(per_line, last_line - per_doc)
        if spaced:
            # Kinds of pieces: a word at the head of a line (no space before it), else one with its space.
            starts = np.cumsum(per_line) - per_line
            head = np.zeros(len(kind), bool)
            head[starts] = True
            kind = kind * 2 + ~head
            used = np.flatnonzero(np.bincount(kind))
            number = np.empty(2 * len(names), np.int64)
            number[used] = np.arange(len(used))
            name = names.take(pa.array(used >> 1))
            ids, begin, size = self._pieces(pc.if_else(pa.array(used & 1 == 1), pc.binary_join_element_wise(pa.scalar("", pa.large_string()), name, pa.scalar(" ", pa.large_string())), name))
            # One more kind: the line feed, before every line but the first of a document.
            begin, size = np.append(begin, len(ids)), np.append(size, len(self.feed))
            ids = np.append(ids, np.array(self.feed, self.kind))
            first_line = np.zeros(len(per_line), bool)
            first_line[last_line - per_doc] = True
            seq = np.insert(number[kind], starts[~first_line], len(used))
            pieces = pieces + per_doc - 1
        else:
            ids, begin, size = self._pieces(names)
            seq = kind
        n = size[seq]
        all_ids = _gather(ids, begin[seq], n)
        cut = np.cumsum(n)[np.cumsum(pieces) - 1]
        lo = 0
        for i, hi in zip(where, cut.tolist()):
            out[i] = all_ids[lo:hi]
            lo = hi
