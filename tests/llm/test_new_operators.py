"""Packing, vector codes and the fill-in-the-middle transformation against brute force, with awkward rows."""

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import coder, middle, packing, pivots, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    letters = "aB's \n\t1.é́İſ<|>P]"
    out = [None, "", " ", "\n\n", "<P> in the text", "a<M", "it's IT'S 'LL", "x" * 300_000, "é" * 400, "aé" * 90_000, "word " * 30_000, "a<", "S>", "<|endoftext|> x", "tab\tend"]
    out += ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(150)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = list(enumerate(texts)) + [(None, texts[20]), (None, texts[20]), (None, None), (3, texts[3]), (3, "another text"), (2**63 - 1, "last id"), (-5, "negative")]
    data = [(i, t, "x", 1, 2.0) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, key string, at int, __part double").repartition(6).cache()


# Fill in the middle


def brute_middle(i, t):
    t = t or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    n = len(u)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_middle_matches_brute_force(spark, docs):
    want = Counter()
    for r in docs.collect():
        *head, out = brute_middle(r.doc_id, r.text)
        want[(r.doc_id, *head, sha(out), sha(r.text or ""))] += 1
    got = middle.middle_report(docs).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in got) == want
    assert {"plain", "psm", "spm"} == {r.form for r in got}


def test_middle_gives_whole_outputs_and_restores_them(spark, docs):
    rows = docs.select("doc_id", "text").distinct().collect()
    cut = middle.pieces(docs)
    outputs = Counter((r.doc_id, r.text) for r in middle.joined(cut).collect())
    assert outputs == Counter((r.doc_id, brute_middle(r.doc_id, r.text)[-1]) for r in rows if r.text is not None or r.doc_id not in (None,)) + Counter([(None, "")])
    back = middle.joined(middle.sections(cut)).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter({(r.doc_id, r.text or "") for r in rows})
    assert sum(r.copies for r in back) == docs.count()
    assert cut.where("at > 0").where("octet_length(piece) > 300000").count() == 0


def test_middle_pieces_end_between_units():
    t = ("abc, " * 200_000).encode()
    form, n, a, b, *_ = middle.plan(7, t)
    starts = set(middle.unit_starts(t)[0].tolist()) | {len(t)}
    at = 0
    for _, p in middle.text_pieces(t, form, a, b):
        at += len(re.sub(rb"^<[PSM]>", b"", p))
        assert at in starts
    assert at == len(t) and n == 600_000


def test_middle_finds_marks_cut_by_pieces():
    for form in ("psm", "spm"):
        parts = {"P": b"ab<", "S": b"<S", "M": b">c"}
        out = b"".join(middle.MARKS[m] + parts[m] for m in middle.ORDERS[form])
        for size in (1, 2, 3, 5):
            r, got = middle.Restorer(form), defaultdict(bytes)
            for k in range(0, len(out), size):
                for s, d in r.feed(out[k:k + size]):
                    got[s] += d
            for s, d in r.feed(b"", True):
                got[s] += d
            assert got == {0: b"ab<", 1: b">c", 2: b"<S"}


def test_middle_of_nothing(spark, docs):
    assert middle.middle_report(docs.where("false")).collect() == []


# Packing


def brute_rooms(lengths, capacity):
    """Best-fit decreasing, a piece at a time: the rooms left."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, n)
        room = rooms.pop(k) if k < len(rooms) else capacity
        bisect.insort(rooms, room - n)
    return Counter(rooms)


def test_best_fit_equals_piece_by_piece():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([1, 5, 10, 50, 97])
        lengths = [min(capacity, int(rng.paretovariate(0.7) * rng.choice([1, 3, 9]))) for _ in range(rng.randrange(400))]
        flows, made = packing.best_fit(dict(Counter(lengths)), capacity)
        fill = defaultdict(list)
        for n, c in Counter(lengths).items():
            own = [f for f in flows.tolist() if f[0] == n]
            for rank in range(c):
                f = max((f for f in own if f[1] <= rank), key=lambda f: f[1])
                fill[f[2] + (rank - f[1]) // f[3]].append((f[4] + (rank - f[1]) % f[3] * n, n))
        assert sorted(fill) == list(range(made))
        for pieces in fill.values():
            end = 0
            for at, n in sorted(pieces):
                assert at == end
                end += n
            assert end <= capacity
        assert Counter(capacity - sum(n for _, n in p) for p in fill.values()) == brute_rooms(lengths, capacity)


def test_tree_finds_the_tightest_room():
    rng, rooms, there = random.Random(2), packing.Rooms(100), set()
    for _ in range(3000):
        k = rng.randrange(101)
        if rng.random() < 0.5:
            there ^= {k}
            rooms.mark(k, k in there)
        least = rng.randrange(101)
        assert rooms.tightest(least) == min((x for x in there if x >= least), default=None)


def test_flows_are_bounded_by_the_capacity():
    rng = random.Random(3)
    few, many = ({n: rng.randrange(1, k) for n in range(1, 513)} for k in (20, 10**9))
    a, b = (len(packing.best_fit(x, 512)[0]) for x in (few, many))
    assert max(a, b) < 3 * 512 * 32


def check_packed(rows, capacity):
    seq = defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
    for p in seq.values():
        end = 0
        for at, n in sorted(p):
            assert at == end
            end += n
        assert end <= capacity
    return len(seq)


def test_packing_report_matches_the_tokenizer(spark, docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = Counter()
    for r in docs.collect():
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        for k, lo in enumerate(range(0, len(ids), 4096)):
            part = ids[lo:lo + 4096]
            want[(r.doc_id, k, lo, len(part), zlib.crc32(part.tobytes()))] += 1
    got = packing.packing_report(docs, path).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert check_packed(got, 4096) == sum(brute_rooms([r.length for r in got], 4096).values())


def test_packed_sequences_hold_the_ids(spark, docs):
    path = queries.tokenizer_path("word_bpe_49k.json")
    packed = packing.pack(packing.token_pieces(docs, path)).cache()
    seqs = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(packed).collect()}
    rows = packed.collect()
    assert len(seqs) == len({r.sequence_id for r in rows})
    for r in rows:
        assert seqs[r.sequence_id][r.offset:r.offset + r.length].tobytes() == r.ids


def test_pack_keeps_clashing_columns_and_refuses_bad_lengths(spark):
    df = spark.createDataFrame([(n % 7 + 1, n, "r") for n in range(500)], "length long, __part long, __rank string").repartition(9)
    got = packing.pack(df, capacity=10).collect()
    assert Counter((r["length"], r["__part"], r["__rank"]) for r in got) == Counter((n % 7 + 1, n, "r") for n in range(500))
    assert check_packed(got, 10) == sum(brute_rooms([r.length for r in got], 10).values())
    assert packing.pack(df.where("false")).count() == 0
    for bad in (0, 11, None):
        with pytest.raises(Exception, match="between 1 and 10"):
            packing.pack(spark.createDataFrame([(bad,)], "length long"), capacity=10).collect()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_coder_is_exact_and_bounded(texts, name, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(coder, "CACHE_BYTES", 4000)
    monkeypatch.setattr(coder, "BATCH_BYTES", 2000)
    path = queries.tokenizer_path(name)
    tok, c = Tokenizer.from_file(path), coder.Coder(path)
    assert c.family == {"b": "spaced", "w": "dropped"}[name[0]]
    rng = random.Random(4)
    some = [t or "" for t in texts] + [" ".join(str(rng.randrange(3000)) + rng.choice(["ab", "é.", "x,"]) for _ in range(60)) for _ in range(200)]
    for _ in range(2):
        assert [x.tolist() for x in c.encode(some)] == [tok.encode(t, add_special_tokens=False).ids for t in some]
    big = 4000 + 33 * 4000
    assert c.parts.words.nbytes + c.parts.ids.nbytes + 33 * len(c.parts.hashes) < big and c.encode([]) == []


# Vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, l, [int(np.floor(4096 * float(x))) for x in v]) for i, v, l in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    cut = [k * len(kept[0][2]) // parts for k in range(parts + 1)]
    books = [[r[2][a:b] for r in kept[:entries]] for a, b in zip(cut, cut[1:])]

    def assign():
        out = []
        for _, _, x in kept:
            best = [min((sum((p - q) ** 2 for p, q in zip(x[a:b], e)), k) for k, e in enumerate(book)) for book, a, b in zip(books, cut, cut[1:])]
            out.append(best)
        return out

    for _ in range(rounds):
        at = assign()
        for p, (a, b) in enumerate(zip(cut, cut[1:])):
            for e in range(len(books[p])):
                own = [r[2][a:b] for r, x in zip(kept, at) if x[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    at = assign()
    error = [sum(d for d, _ in x) for x in at]
    by = Counter()
    for (_, l, _), e in zip(kept, error):
        by[l] += e
    h = sha(",".join(str(v) for book in books for e in book for v in e))
    return Counter((i, "".join(f"{e:02x}" for _, e in x), d, by[l], h) for (i, l, _), x, d in zip(kept, at, error))


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumns({"i": F.lit("clash"), "x": F.lit(1), "code": F.lit(2)}).repartition(5)


def found(df):
    return Counter(tuple(r) for r in pivots.code_report(df).collect())


def test_codes_match_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), rng.normal(size=16).astype(np.float32).round(2).tolist(), int(k) % 3 if k % 5 else None) for k in rng.permutation(300)]
    rows += [(500 + k, rows[7][1], 1) for k in range(60)]  # one vector very often
    rows += [(3, rows[1][1], 0), (None, rows[2][1], 0), (None, None, 1), (900, [float("nan")] * 16, 1), (901, [float("inf")] + [0.0] * 15, 1), (902, [None] + [0.0] * 15, 1), (903, [1.0] * 8, 1), (904, [], 1)]
    assert found(vectors(spark, rows)) == brute_codes(rows)


def test_codes_with_ties_few_rows_and_uneven_parts(spark):
    grid = [(k, [float(k % 2), float(k // 2 % 2)] * 5, k % 2) for k in range(40)]  # many equal entries
    assert found(vectors(spark, grid)) == brute_codes(grid)
    few = [(k, [0.1 * k] * 8, 0) for k in range(5)]
    assert found(vectors(spark, few)) == brute_codes(few)
    assert found(vectors(spark, [])) == Counter()
    with pytest.raises(Exception, match="too large"):
        found(vectors(spark, [(1, [1e9] * 8, 0)]))


def test_pivots_prune_without_changing_the_nearest():
    rng = np.random.default_rng(6)
    centres = rng.integers(-3000, 3000, (16, 8))
    x = centres[rng.integers(0, 16, 5000)] + rng.integers(-60, 60, (5000, 8))
    p = centres[pivots.choose_pivots(centres, 4)]
    at, d, evaluated = pivots.nearest(x, pivots.distances(x, p).astype("<f4"), centres, pivots.distances(p, centres))
    exact = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (at == exact.argmin(1)).all() and (d == exact.min(1)).all()
    assert evaluated < 2.5 * len(x)  # of 16 each
