"""The text operators against brute force on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import boosted, decontaminate, jaccard, lines, mixing, outliers, queries, stats, suffixes, tokens, urls, warc
from tidemark.llm.common import new_folder
from tidemark.llm.graph import components

SF = "/root/testdata/sf0.001"
WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "re", "so", "té", "vu") for b in ("", "ran", "del", "pol", "sty", "gim")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(200)) for _ in range(n))


def edited(rng, text, share):
    w = text.split(" ")
    for _ in range(max(1, int(len(w) * share))):
        w[rng.randrange(len(w))] = "x" + str(rng.randrange(10**6))
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    """(id, text): copies, near copies, shared passages, nulls, empty and very long texts."""
    rng = random.Random(5)
    out = [None, "", " \n\t ", "one two", "One  TWO", "short", "é" * 60, "é" * 60]
    base = prose(rng, 150)
    out += [edited(rng, base, s) for s in (0.003, 0.003, 0.01, 0.01, 0.02, 0.02, 0.03) for _ in range(4)] + [base, base, base]
    passage = prose(rng, 40)
    out += [prose(rng, 60) + "\n" + passage + "\n" + prose(rng, 30) for _ in range(12)]
    out += ["A common line of text\n" + prose(rng, 8) + "\n a common LINE of text \n\n" + prose(rng, 5) for _ in range(6)]
    out += [prose(rng, 4000), "la " * 500, "aaaa" * 100, "aaaa" * 90]
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    more = [(rows[3][0], rows[3][1]), (None, "row without an id, with a few words in it"), (None, rows[20][1]), (4, "another text of the same id as one above")]
    data = [(i, t, "en", "src0", len(t or ""), 1, "x") for i, t in rows + more]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score int, kept string").repartition(5).cache()


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(pairs):
    sets = [(i, shingles(t)) for i, t in pairs]
    parent = {i: i for i, _ in pairs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1:]:
            both = len(x & y)
            if x and y and 100 * both >= 80 * (len(x) + len(y) - both):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("chunk,partners", [(4096, 400), (8, 3)])
def test_jaccard(spark, docs, monkeypatch, chunk, partners):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "PARTNERS", partners)
    last = 1 << 62
    all_rows = [(last if r.doc_id is None else r.doc_id, r.text) for r in docs.collect()]
    want = brute_components(all_rows)
    got = jaccard.jaccard_report(docs).collect()
    assert len(got) == len(all_rows)
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((None if i == last else i, None if want[i] == last else want[i]) for i, _ in all_rows)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((None if i == last else i, len(shingles(t))) for i, t in all_rows)
    assert jaccard.jaccard_report(empty(spark)).count() == 0


def test_distinct_stage_judges_rows_without_an_id_each_on_its_own(spark):
    rng = random.Random(12)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    data = [(1, a), (2, b), (None, a), (None, edited(rng, b, 0.01)), (None, c), (None, edited(rng, c, 0.01)), (None, c), (None, d)]
    data += [(7, prose(rng, 50)), (7, a), (7, prose(rng, 50)), (8, prose(rng, 50)), (None, None), (None, None), (None, ""), (3, " "), (3, " ")]
    data += [(9, t) for t in [prose(rng, 40)] * 3] + [(None, t) for t in [prose(rng, 40)] * 3]
    df = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, more string").repartition(3)
    got = corpus_pipeline.distinct_documents(spark, df, SF)
    assert got.columns == df.columns
    stay = Counter((r.doc_id, r.text) for r in got.collect())
    last = 1 << 62
    group = brute_components([(k, t) for k, (_, t) in enumerate(data)])
    want = defaultdict(list)
    for k, (i, t) in enumerate(data):
        if shingles(t):
            want[group[k]].append((last if i is None else i, t))
    for rows in want.values():
        least = min(i for i, _ in rows)
        assert sum(stay[x] for x in {(None if i == last else i, t) for i, t in rows}) == 1
        assert sum(stay[x] for x in {(None if i == last else i, t) for i, t in rows if i == least}) == 1
    blank = Counter(x for x in data if not shingles(x[1]))
    assert sum(stay.values()) == len(want) + sum(blank.values()) and all(stay[x] == n for x, n in blank.items())
    assert corpus_pipeline.distinct_documents(spark, empty(spark), SF).count() == 0


def test_jaccard_chain_of_near_copies(spark):
    """Links that only neighbours have, in blocks whose members are not all alike."""
    rng = random.Random(3)
    text, out = prose(rng, 120), []
    for k in range(60):
        out.append((k, text))
        text = edited(rng, text, 0.01)
    rng.shuffle(out)
    df = spark.createDataFrame(out, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_report(df).collect()} == brute_components(out)


def test_tree_pairs_match_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 9, (12, jaccard.GROUPS))
    v = np.maximum(base[rng.integers(0, 12, 700)] + rng.integers(-1, 2, (700, jaccard.GROUPS)), 0)
    n, comp = v.sum(1), rng.integers(0, 300, 700)
    got = {(min(a, b), max(a, b)) for p, q in jaccard.tree_pairs(n, v, comp, 80) for a, b in zip(p.tolist(), q.tolist())}
    want = {(a, b) for a in range(700) for b in range(a + 1, 700) if comp[a] != comp[b] and jaccard.bound_holds(np.minimum(v[a], v[b]).sum(), n[a] + n[b], 80)}
    assert got == want and len(want) > 1000


def test_block_pairs_of_short_and_long_vectors():
    rng = np.random.default_rng(3)
    n = rng.integers(300, 5000, 120)
    sets = [rng.choice(8000, k, replace=False) for k in n]
    for k in range(0, 100, 2):
        sets[k + 1] = np.append(sets[k][: int(n[k] * rng.uniform(0.8, 1))], 9000 + k)
    n = np.array([len(x) for x in sets])
    v = [np.bincount(x % g, minlength=g).astype("<u4") for x, g in zip(sets, jaccard.groups_of(n))]
    got = {(min(a, b), max(a, b)) for p, q in jaccard.block_pairs(n, v, np.arange(120), 80) for a, b in zip(p.tolist(), q.tolist())}
    link = {(a, b) for a in range(120) for b in range(a + 1, 120) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert len(link) > 20 and link <= got and len(got) < 4 * len(link)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (5, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}}


def brute_repeats(pairs):
    first = {}
    data = [(i, (t or "").encode()) for i, t in pairs]
    for i, b in data:
        for p in range(len(b) - 49):
            w = b[p:p + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < i:
                gone[p:p + 50] = b"\x01" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_repeats(spark, docs):
    last = 1 << 62
    want = brute_repeats([(last if r.doc_id is None else r.doc_id, r.text) for r in docs.collect()])
    got = Counter((last if r[0] is None else r[0], *r[1:]) for r in suffixes.repeat_report(docs).collect())
    assert got == want
    assert suffixes.repeat_report(empty(spark)).count() == 0


def test_repeats_in_pieces_of_long_texts(spark, monkeypatch):
    rng = random.Random(9)
    shared = prose(rng, 300)
    data = [(0, prose(rng, 200) + shared), (1, shared[40:] + prose(rng, 200)), (2, shared + shared)]
    monkeypatch.setattr(suffixes, "PIECE", 700)
    texts = [t for _, t in data]
    cut = list(suffixes._pieces(texts, 1500))
    assert len(cut) > 3
    starts = {(int(p.row[p.piece[k]]), int(s + j - p.start[p.piece[k]] + p.offset[p.piece[k]])) for p in cut for k, s in enumerate(p.s) for j in range(p.n[k] + 1)}
    assert starts == {(k, j) for k, t in enumerate(texts) for j in range(len(t.encode()) - 49)}
    assert Counter(tuple(r) for r in suffixes.repeat_report(spark.createDataFrame(data, "doc_id long, text string")).collect()) == brute_repeats(data)


def test_lines(spark, docs):
    con = duckdb.connect()
    documents = docs.where("doc_id is not null and doc_id != 4").select("doc_id", "text").dropDuplicates().toPandas()  # noqa: F841
    want = con.execute(queries.ORACLE["op7_line_dedup"]).df()
    got = lines.line_report(docs.where("doc_id is not null and doc_id != 4").dropDuplicates(["doc_id", "text"])).toPandas()
    key = lambda d: sorted(d[["doc_id", "n_lines", "n_dropped", "kept_sha256"]].itertuples(index=False, name=None))
    assert key(got) == key(want)
    assert lines.line_report(docs).count() == docs.count() and lines.line_report(empty(spark)).count() == 0
    out = lines.drop_lines(docs.withColumn("n_lines", F.lit("clash")))
    assert {"score", "kept", "kept_text"} <= set(out.columns) and out.schema["n_lines"].dataType.simpleString() == "bigint"


def test_hot_lines_take_the_aggregated_way(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT_LINES", 3)
    rng = random.Random(2)
    documents = pd.DataFrame([(k, "the line that all have\n" + prose(rng, 6) + "\n" + rng.choice(["second shared line", "third shared line"])) for k in range(50)], columns=["doc_id", "text"])
    want = duckdb.execute(queries.ORACLE["op7_line_dedup"]).df()
    got = lines.line_report(spark.createDataFrame(documents)).toPandas()
    key = lambda d: sorted(d[["doc_id", "n_lines", "n_dropped", "kept_sha256"]].itertuples(index=False, name=None))
    assert key(got) == key(want)


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    extra = spark.createDataFrame([(900, "tab\there"), (901, "two  spaces \n x"), (902, "<|endoftext|> it's 12.5"), (903, "日本 語\n\nx")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionAll(extra)
    ids = lambda t: tok.encode(t or "", add_special_tokens=False).ids + [0]
    crc = lambda t: (len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes()))
    got = tokens.token_report(every, queries.tokenizer_path()).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((r.doc_id, *crc(r.text)) for r in every.collect())
    placed = sorted(got, key=lambda r: r.start)
    assert [r.start for r in placed] == np.cumsum([0] + [r.n_tokens for r in placed])[:-1].tolist()
    known = [r.doc_id for r in placed if r.doc_id is not None]
    assert known == sorted(known) and all(r.doc_id is None for r in placed[len(known):])
    assert tokens.token_report(empty(spark), queries.tokenizer_path()).count() == 0


def test_single_documents_can_be_read(spark):
    from tokenizers import Tokenizer

    data = [(k, prose(random.Random(k), 20 + k)) for k in range(200)]
    folder = new_folder(spark, "tokens")
    files = tokens.write_tokens(spark.createDataFrame(data, "doc_id long, text string"), folder, queries.tokenizer_path()).collect()
    fs, root = tokens.filesystem(folder)
    tok, seen = Tokenizer.from_file(queries.tokenizer_path()), 0
    for row in files:
        grow = tokens._codec(fs.open_input_file(f"{root}/{row.dictionary}.dict").read())[1]
        with fs.open_input_file(row.path) as f:
            for e in tokens.read_index(f)[::7]:
                f.seek(int(e["offset"]))
                got = np.frombuffer(grow.decompress(f.read(int(e["length"])), max_output_size=int(e["n"]) * 2), "<u2")
                assert got.tolist() == tok.encode(data[int(e["doc_id"])][1], add_special_tokens=False).ids + [0]
                seen += 1
    assert seen > 20


def test_warc_round_trip(spark):
    html = ["<p>a</p>" * 50, None, "", "<p>é</p>", "<p>a</p>" * 50, "<p>a</p>" * 50, "x\r\n\r\nWARC/1.1\r\n" * 3] + [f"<html>{prose(random.Random(k), 60)}</html>" for k in range(60)]
    data = [(k, f"http://h/{k}" if k % 9 else None, h, "x") for k, h in enumerate(html)] + [(None, "u\r\nX: y", "<p>é</p>", "y"), (5, "again", "<p>a</p>" * 50, "z")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, record_type string").repartition(4)
    back = warc.read_archives(warc.write_archives(pages, new_folder(spark, "warc"))).collect()
    assert len(back) == len(data)
    best = defaultdict(lambda: -1)
    for i, _, h, _ in data:
        best[h or ""] = max(best[h or ""], -1 if i is None else i)
    want = Counter()
    for i, u, h, _ in data:
        raw = (h or "").encode()
        top = best[h or ""]
        want[(i, len(raw), warc.digest(raw), "response" if i == top else "revisit", None if i == top else top, raw if i == top else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in back) == want
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_report(none).count() == 0


def test_quality_scores_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op4_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    pos, neg = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    assert (pos[:, None] > neg[None]).mean() > 0.95
    assert got.predicted[got.quality == 1].mean() > 0.98 and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_quality_of_awkward_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = boosted.quality_report(docs, none).collect()
    assert len(got) == docs.count() and {r.score for r in got} == {0.5} and not any(r.held_out for r in got if r.doc_id is None)
    one = spark.createDataFrame([(k, 1, 0) for k in range(20)] + [(None, 0, 0), (3, None, 0), (10**9, 0, 0)], "doc_id long, quality int, toxic int")
    assert len({r.score for r in boosted.quality_report(docs, one).collect()}) == 1
    assert boosted.quality_report(empty(spark), one).count() == 0
    for r in got:
        assert r.doc_id is None or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def brute_counts(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    grams = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    inside = {j for k in range(len(w) - 4) if grams[tuple(w[k:k + 5])] > 1 for j in range(k, k + 5)}
    full = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(inside)


def test_outliers_base_statistics(spark, docs):
    extra = spark.createDataFrame([(700, "a b c d e a b c d e f\nline x\nline x\n  \n  ", "en", "s"), (701, "# $$ <x> \u00a0y\u2003z", None, None)], "doc_id long, text string, lang string, source string")
    every = docs.select("doc_id", "text", "lang", "source").unionAll(extra)
    got = outliers.outlier_report(every).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((r.doc_id, *brute_counts(r.text)) for r in every.collect())
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert outliers.outlier_report(empty(spark)).count() == 0


def test_outliers_reject_junk_and_keep_the_rest(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op3_outliers"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert got.kept[got.quality == 1].mean() > 0.995
    assert got.kept[got.quality == 0].mean() < 0.2


def test_outliers_in_a_group_with_much_junk(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").join(labels, "doc_id").select("doc_id", "text", "quality").toPandas().sort_values("doc_id")
    n = stats.text_counts(rows.text)
    rows = rows[((n.n_words >= 10) & (100 * n.n_repeat_words <= 20 * n.n_words)).to_numpy()]
    rng = random.Random(11)
    good, bad = [rows.text[rows.quality == q].tolist() for q in (1, 0)]
    texts = rng.sample(good, 1200) + rng.choices(bad, k=800)
    df = spark.createDataFrame([(k, t, "en", "hot") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = outliers.outlier_report(df).toPandas()
    assert not got.base_failed.any()
    assert got.kept[got.doc_id < 1200].mean() > 0.995 and got.kept[got.doc_id >= 1200].mean() < 0.1


def test_scatter_matches_numpy(spark):
    """The concentration steps on one group, step by step with numpy."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal([1.5, 0, 0.3, 0, 0.2], [0.2, 0.1, 0.2, 0.05, 0.2], (900, 5)), rng.normal(3, 0.3, (100, 5))])
    z = np.round(x * outliers.SCALE).astype(int)
    df = spark.createDataFrame([("g", *map(int, r)) for r in z], "g string, " + ", ".join(f"x{k} long" for k in range(5)))
    got = outliers.scatter(df).first()
    v = z / outliers.SCALE
    q = [np.quantile(v, s, axis=0, method="inverted_cdf") for s in (0.25, 0.5, 0.75)]
    mean, inv = q[1], np.diag(1 / (((q[2] - q[0]) / 1.349) ** 2 + np.square(outliers.FLOOR)))
    met = set()
    while True:
        d2 = np.maximum(np.einsum("ij,jk,ik->i", v - mean, inv, v - mean), 1e-9)
        b = np.floor(np.log2(d2) * 16)
        inside = b <= np.sort(b)[int(np.ceil(0.5 * len(b))) - 1]
        core = v[inside]
        mean, cov = core.mean(0), np.cov(core.T, bias=True) + np.diag(np.square(outliers.FLOOR))
        inv = np.linalg.inv(cov)
        if inside.tobytes() in met:
            break
        met.add(inside.tobytes())
    assert np.allclose(got["mean"], mean) and np.allclose(np.array(got["inv"]).reshape(5, 5), inv, rtol=1e-6)
    far = np.einsum("ij,jk,ik->i", v - mean, inv, v - mean) * got["unit"]
    assert (far[:900] < outliers.CUTOFF).all() and (far[900:] > outliers.CUTOFF).all()


def trigrams(text):
    w = re.findall(r"\w+", (text or "").lower())
    return [tuple(w[k:k + 3]) for k in range(len(w) - 2)]


def test_leaks_against_trigram_overlap(spark):
    sf = "/root/testdata/sf0.01"
    items = {r.item_id: trigrams(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op2_decontaminate"](spark, sf).collect()}
    sure, none = set(), set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        own = set(trigrams(r.text))
        for i, g in items.items():
            share = sum(x in own for x in g) / len(g)
            (sure if share >= 0.8 else none if share < 0.3 else set()).add((r.doc_id, i))
    assert sure <= got and not got & none and len(sure) > 10


def test_leaks_of_paraphrases_and_awkward_rows(spark, docs):
    rng = random.Random(8)
    items = [(k, prose(rng, 40) + ".\nThe answer is " + prose(rng, 4) + ".") for k in range(12)]
    reworded = []
    for k, t in items:
        w = t.split(" ")
        for j in rng.sample(range(len(w) - 8), 12):
            w[j] = "other" + str(j)
        reworded.append((100 + k, prose(rng, 50) + " " + " ".join(w) + " " + prose(rng, 50)))
    bench = spark.createDataFrame(items + [(50, None), (51, ""), (52, "...")], "item_id long, text string")
    df = docs.select("doc_id", "text").unionAll(spark.createDataFrame(reworded, "doc_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in decontaminate.leak_report(df, bench).collect()}
    assert found == {(100 + k, k) for k in range(12)}
    assert decontaminate.clean(df, bench).count() == docs.count()
    assert decontaminate.leak_report(df, bench.where("item_id > 49")).count() == 0
    assert decontaminate.leak_report(empty(spark), bench).count() == 0


def test_leaks_of_items_of_any_length(spark):
    """Copies among words of the benchmark, which weigh in their passages, and a long one with every eighth word changed."""
    rng = random.Random(21)
    items = [(k, prose(rng, n)) for k, n in enumerate([5, 5, 64, 65, 150, 800, 1000, 1000])]
    pool = prose(rng, 1500).split(" ")
    items.append((99, " ".join(pool)))
    other = lambda n: " ".join(rng.sample(pool, n))
    rows = [(k, other(120) + " " + t + " " + other(120)) for k, t in items[:-1]]
    w = items[6][1].split(" ")
    rows += [(20, other(90) + " " + " ".join("new" + x if j % 8 == 3 else x for j, x in enumerate(w))), (30, other(500)), (31, " ".join(w[:300]))]
    got = decontaminate.leak_report(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k, _ in items[:-1]} | {(20, 6)} and len(got) == 9


def test_many_items_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 5)
    rng = random.Random(1)
    items = [(k, prose(rng, 30)) for k in range(12)]
    df = spark.createDataFrame([(k, prose(rng, 40) + " " + t + " " + prose(rng, 40)) for k, t in items], "doc_id long, text string")
    got = decontaminate.leak_report(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in range(12)}


def test_subsequence():
    rng = random.Random(0)
    for _ in range(200):
        a, b = [[rng.randrange(5) for _ in range(rng.randrange(1, 12))] for _ in "ab"]
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == d[-1][-1]


def test_candidates_match_all_passages_with_all_pieces():
    """The index against the cosine and the cover of every passage with every piece, worked out densely."""
    rng = random.Random(31)
    some = [prose(rng, n) for n in (5, 12, 30, 64, 65, 150, 20, 40)] + ["of the of the and", "!!! 7"]
    items = decontaminate.Items.of(list(enumerate(some)))
    texts = [prose(rng, rng.randrange(1, 300)) + " " + edited(rng, rng.choice(some), rng.choice([0.01, 0.3, 0.6])) + " " + prose(rng, rng.randrange(80)) for _ in range(120)] + ["", "x"]
    term, n = items.codes(pa.array(texts))
    size = len(items.terms)
    row, t, count, owner, first = decontaminate.passages(term, n, size, overlap=False)
    idf = np.log((1 + len(owner)) / (1 + np.bincount(t, minlength=size))) + 0.1
    search = decontaminate.Search(items, idf)
    got = {(d, w, k): c for d, w, k, c in search.candidates(term, n)}
    row, t, count, owner, first = decontaminate.passages(term, n, size, overlap=True)
    x = np.zeros((len(owner), size))
    x[row, t] = decontaminate.weights(count, t, idf)
    v = np.zeros((len(items.pieces), size))
    for k, (_, w) in enumerate(items.pieces):
        a, c = np.unique(w, return_counts=True)
        v[k, a] = decontaminate.weights(c, a, idf)
    length = np.linalg.norm(v, axis=1)
    unit = v / length[:, None]
    cosine = x @ unit.T / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
    want = {}
    for p, k in zip(*np.nonzero(cosine >= decontaminate.COSINE)):
        key = (owner[p], first[p], items.pieces[k][0])
        want[key] = max(want.get(key, 0), cosine[p, k])
    assert set(want) <= set(got) and all(abs(got[k] - c) < 1e-9 for k, c in want.items()) and len(want) > 50
    cover = np.stack([(np.minimum(x / length[k], unit[k]) * unit[k]).sum(1) for k in range(len(unit))], 1)
    full = {(owner[p], first[p], items.pieces[k][0]) for p, k in zip(*np.nonzero(cover >= decontaminate.COVER))}
    assert {k for k in full if any(t >= 0 for t in term)} <= set(got) | {k for k in full if not np.any(~search.common)}


def test_blocks_of_items_give_the_same_leaks(spark, monkeypatch):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = lambda: Counter((r.doc_id, r.item_id, round(r.lcs, 9), round(r.answer, 9)) for r in decontaminate.leak_report(docs, bench).collect())
    want = found()
    monkeypatch.setattr(decontaminate, "BLOCK", 40)
    assert found() == want and len(want) >= 3


def test_mix(spark):
    rng = random.Random(6)
    weights = {"a": 5, "b": 3, "c": 2}
    data = [(k, "t" + str(k), s, "clash") for k, s in enumerate(rng.choices(["a", "b", "c", "z", None], [60, 30, 25, 8, 4], k=1500))]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, mix_slot string")
    got = mixing.mix(df, weights, other=1, block=4).toPandas()
    assert sorted(got.doc_id) == list(range(1500)) and not got.duplicated(["mix_slot", "mix_rank"]).any()
    slots = got[["mix_slot", "mix_source", "mix_phase", "mix_block"]].drop_duplicates().sort_values("mix_slot")
    assert slots.mix_slot.tolist() == list(range(len(slots)))
    q = {**weights, mixing.OTHER: 1}
    left = Counter(slots.mix_source)
    for _, part in slots.groupby("mix_phase"):
        active = {s for s in q if left[s]}
        assert set(part.mix_source) <= active
        total = sum(q[s] for s in active)
        took = Counter()
        for t, s in enumerate(part.mix_source, 1):
            took[s] += 1
            assert all(abs(took[x] - t * q[x] / total) < 1 for x in active)
        left -= Counter(part.mix_source)
    assert not +left
    for s, part in slots.groupby("mix_source"):
        assert part.mix_block.tolist() == list(range(len(part)))
    assert mixing.mix(empty(spark), weights).count() == 0


def test_period_meets_releases_and_deadlines():
    rng = random.Random(4)
    for _ in range(30):
        q = {str(k): rng.randrange(1, 40) for k in range(rng.randrange(1, 12))}
        total = sum(q.values())
        for slot, (s, k) in enumerate(mixing.period(q)):
            assert k * total // q[s] <= slot < -(-(k + 1) * total // q[s])


def test_url_parts_and_rules(spark):
    data = [
        (1, "http://WWW.Example.COM/en/x?q=1"), (2, "https://a.example.com/en/1#t"), (3, "https://example.com/de/"), (4, "http://x.net/es/1"), (5, "http://x.net"),
        (6, None), (7, "no scheme"), (8, "a://b://c/d"), (9, "http://notexample.com/en/"), (10, "http://net/fr/?x"), (11, "http:///path"), (12, "http://x.com\n/en"), (12, "http://x.com\n/en")]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in data], "page_id long, url string, rule string")
    labels = spark.createDataFrame([], "page_id long, block boolean")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, labels).collect())
    assert got == Counter([
        (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "a.example.com", "/en/1", "example.com/en/", "block"), (3, "example.com", "/de/", "com/", "allow"),
        (4, "x.net", "/es/1", "net/es/", "block"), (5, "x.net", "", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "b:", "//c/d", None, "allow"),
        (9, "notexample.com", "/en/", "com/", "allow"), (10, "net", "/fr/", "net/fr/", "block"), (11, "", "/path", None, "allow"), (12, "x.com\n", "/en", None, "allow"), (12, "x.com\n", "/en", None, "allow")])


def test_mined_rules_match_brute_force(spark):
    from itertools import combinations

    rng = random.Random(7)
    data = []
    for k in range(600):
        host, path = rng.choice(["bets.org", "news.org", "shop.info"]), rng.choice(["win", "sport", "item"])
        bad = host == "bets.org" and path == "win" or rng.random() < 0.03
        data.append((k, f"https://{host}/{path}/{k}", bad if k % 3 else None))
    pages = spark.createDataFrame([(k, u) for k, u, _ in data], "page_id long, url string")
    labels = spark.createDataFrame([(k, b) for k, _, b in data], "page_id long, block boolean")
    got = {r.page_id: r.verdict for r in urls.judge(pages, labels, min_support=0.02, min_confidence=0.8).collect()}
    token = {r.page_id: set(r.t) for r in pages.select("page_id", urls.url_tokens(F.col("url")).alias("t")).collect()}
    known = [(token[k], b) for k, _, b in data if b is not None]
    n, rules = len(known), []
    for size in (1, 2, 3):
        for c in {c for t, b in known if b for c in combinations(sorted(t), size)}:
            hits, all_ = sum(b and set(c) <= t for t, b in known), sum(set(c) <= t for t, _ in known)
            if hits >= 0.02 * n and hits >= 0.8 * all_:
                rules.append(set(c))
    assert rules and got == {k: "block" if any(r <= token[k] for r in rules) else "allow" for k, _, _ in data}
    assert got[data[0][0]] in ("allow", "block") and 60 < sum(v == "block" for v in got.values()) < 90 + 60


def test_counts_of_texts():
    texts = pd.Series(["A b!\nA b!", None, "", "x | y | 12", "a b c d e a b c d e"])
    got = stats.text_counts(texts)
    assert got.n_words.tolist() == [4, 0, 0, 5, 10] and got.n_dup_lines.tolist() == [1, 0, 0, 0, 0]
    assert got.n_upper.tolist() == [2, 0, 0, 0, 0] and got.n_digits.tolist() == [0, 0, 0, 2, 0] and got.n_bars.tolist() == [0, 0, 0, 2, 0]
    assert got.n_repeat_words.tolist() == [0, 0, 0, 0, 10]
