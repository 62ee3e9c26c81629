"""Ends of the id range, clashing columns, skew, and both sides of every size-dependent step."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import brute_components, edited, empty, prose

import corpus_pipeline as cp
from tidemark.llm import boosted, common, decontaminate, jaccard, lines, mixing, outliers, queries, suffixes, tokens, urls, warc
from tidemark.llm.common import new_folder

TOP = 2**63 - 1
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ends(spark):
    """Rows without an id beside one with the largest id; other columns are called like working names."""
    rng = random.Random(21)
    line, passage = "a line that many documents share", prose(rng, 30)
    a, b = prose(rng, 60), prose(rng, 60)
    data = [(TOP, line + "\n" + a), (None, line + "\n" + b), (None, passage + " " + a), (TOP - 1, passage + " " + prose(rng, 20)), (5, line + "\n" + prose(rng, 30)), (-7, b + " more"), (None, None), (8, "")]
    extra = "x string, key int, row string, i int, t string, k string, h long, n string, __k string, __t int, mix_n string, lang string, source string, n_chars long"
    names = [c.split()[0] for c in extra.split(", ")]
    rows = [(i, t, "x", 1, "r", 2, "t", "k", 3, "n", "kk", 4, "m", "en", "src0", len(t or "")) for i, t in data]
    return spark.createDataFrame(rows, "doc_id long, text string, " + extra).repartition(3).cache(), names


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())


def test_the_largest_id_is_not_a_missing_one(spark, ends):
    df, _ = ends
    want = ids(df.select("doc_id"))
    for report in (lines.line_report, suffixes.repeat_report, jaccard.jaccard_report, lambda d: tokens.token_report(d, queries.tokenizer_path())):
        assert ids(report(df).select("doc_id")) == want
    # The line's first document is the one with id 5; the largest id comes before rows without one.
    gone = {(r.doc_id, r.n_lines): r.n_dropped for r in lines.line_report(df).collect()}
    assert gone[(5, 2)] == 0 and gone[(TOP, 2)] == 1 and gone[(None, 2)] == 1
    some = df.where("doc_id IS NULL OR doc_id = 9223372036854775807")
    kept = {(r.doc_id, r.n_lines): r.n_dropped for r in lines.line_report(some).collect()}
    assert kept[(TOP, 2)] == 0 and kept[(None, 2)] == 1
    cut = {r.doc_id: r.n_removed for r in suffixes.repeat_report(some.where("text IS NOT NULL AND text LIKE 'a line%' OR doc_id = 9223372036854775807")).collect()}
    assert cut[TOP] == 0
    comp = {r.doc_id: r.component_id for r in jaccard.jaccard_report(df).collect()}
    assert comp[TOP] == TOP and comp[-7] == -7
    starts = {r.doc_id: r.start for r in tokens.token_report(df.where("doc_id IS NULL OR doc_id > 8"), queries.tokenizer_path()).collect() if r.doc_id is not None}
    assert starts[TOP - 1] == 0 < starts[TOP]


def test_both_ends_of_the_ids_are_refused(spark):
    both = spark.createDataFrame([(TOP, "a"), (-TOP - 1, "b"), (None, "c")], "doc_id long, text string")
    with pytest.raises(ValueError, match="smallest and the largest"):
        common.Ids(both, "doc_id")
    assert common.Ids(both.where("doc_id < 0 OR doc_id IS NULL"), "doc_id").shift == 0


def test_clashing_columns_pass_through(spark, ends):
    df, names = ends
    bench = spark.createDataFrame([(1, prose(random.Random(1), 30))], "item_id long, text string")
    for out in (decontaminate.clean(df, bench), lines.drop_lines(df), mixing.mix(df, {"src0": 1}), jaccard.one_per_text(df), cp.mixed(spark, df, SF)):
        assert set(df.columns) <= set(out.columns)
        assert all(tuple(r[c] for c in names if c != "n_chars") == ("x", 1, "r", 2, "t", "k", 3, "n", "kk", 4, "m", "en", "src0") for r in out.collect())
    labels = spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")
    for report, n in ((outliers.outlier_report, 8), (suffixes.repeat_report, 8), (jaccard.jaccard_report, 8), (lambda d: boosted.quality_report(d, labels), 8), (lambda d: decontaminate.leak_report(d, bench), 0)):
        assert report(df).count() == n


def test_a_component_of_rows_with_maps(spark):
    rng = random.Random(2)
    t = prose(rng, 120)
    df = spark.createDataFrame([(1, t, {"a": 1}), (1, t, {"a": 2}), (2, edited(rng, t, 0.01), {}), (3, prose(rng, 40), None)], "doc_id long, text string, m map<string,int>")
    assert sorted(r.doc_id for r in jaccard.one_per_text(df).collect()) == [1, 3]


# Jaccard join


def near_group(rng, size, words=120, share=0.02):
    base = prose(rng, words)
    return [base] + [edited(rng, base, share) for _ in range(size)]


def test_large_near_group_sends_rows_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 64)
    sent = []
    real = jaccard._candidates

    def counted(blocks, percent):
        out = real(blocks, percent).cache()
        sent.append((blocks.count(), out.count()))
        return out

    monkeypatch.setattr(jaccard, "_candidates", counted)
    rng = random.Random(8)
    texts = near_group(rng, 300) + [prose(rng, 60) for _ in range(40)]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_report(df).collect()}
    assert got == brute_components(list(enumerate(texts)))
    rows, out = sent[0]
    assert out <= 8 * max(rows, 1)  # members, each once per pair of parts, never pairs


def test_links_that_no_hub_sees(spark, monkeypatch):
    """Two families that share passages: many members link with each other and not with the hub of their block."""
    for chunk in (2048, 8):
        monkeypatch.setattr(jaccard, "CHUNK", chunk)
        rng = random.Random(chunk)
        shared = prose(rng, 70)
        texts = [shared + " " + own for own in (prose(rng, 30) for _ in range(12)) for own in near_own(rng, own)]
        rng.shuffle(texts)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        got = {r.doc_id: r.component_id for r in jaccard.jaccard_report(df).collect()}
        assert got == brute_components(list(enumerate(texts)))


def near_own(rng, text):
    return [text, edited(rng, text, 0.05), edited(rng, text, 0.1)]


def test_rows_without_an_id_are_one_document(spark):
    rng = random.Random(5)
    a, b, c = (prose(rng, 50) for _ in range(3))
    rows = [(None, a), (None, b), (None, None), (4, edited(rng, a, 0.01)), (9, edited(rng, b, 0.01)), (11, c), (11, prose(rng, 50)), (12, "")]
    got = Counter((r.doc_id, r.component_id) for r in jaccard.jaccard_report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(None, 4)] * 3 + [(4, 4), (9, 4), (11, 11), (11, 11), (12, 12)])


# Repeated bytes


def test_spelled_out_windows_give_the_same(spark, monkeypatch):
    rng = random.Random(9)
    passage = "".join(rng.choice("abc") for _ in range(400))
    data = [(k, prose(rng, 20) + passage[rng.randrange(200):][: rng.randrange(60, 200)] + prose(rng, 10)) for k in range(60)] + [(k, None) for k in (99, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    want = sorted(map(str, suffixes.repeat_report(df).collect()))
    monkeypatch.setattr(suffixes, "LARGE", 0)
    assert sorted(map(str, suffixes.repeat_report(df).collect())) == want
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 200)  # many buckets
    assert sorted(map(str, suffixes.repeat_report(df).collect())) == want


def test_buckets_follow_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 1000)
    df = spark.createDataFrame([("x" * 600,)] * 100, "t string")
    assert suffixes.buckets_for(df) == 60 and suffixes.buckets_for(df.where("false")) == 8


# Token files


def test_wide_vocabularies(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer(models.WordLevel({f"w{k}": k for k in range(70_000)}, unk_token="w0"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    path = str(tmp_path / "wide.json")
    tok.save(path)
    data = [(k, " ".join(f"w{(k * 997 + j) % 70_000}" for j in range(k % 7))) for k in range(0, 2000, 13)]
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in tokens.token_report(spark.createDataFrame(data, "doc_id long, text string"), path, end_id=69_999).collect()}
    for i, t in data:
        want = np.array(tok.encode(t).ids + [69_999], "<u4")
        assert got[i] == (len(want), zlib.crc32(want.tobytes()))


# Mixing


def check_schedule(got, weights, block):
    """Slots against the definition: every block within its release and deadline of its phase, deviation under one block."""
    slots = got[["mix_slot", "mix_source", "mix_phase", "mix_block"]].drop_duplicates().sort_values("mix_slot")
    assert slots.mix_slot.tolist() == list(range(len(slots))) and not got.duplicated(["mix_slot", "mix_rank"]).any()
    left, seen, at = Counter(slots.mix_source), Counter(), 0
    for _, part in slots.groupby("mix_phase"):
        active = {s for s in weights if left[s]}
        total, base = sum(weights[s] for s in active), dict(seen)
        for s, b, slot in zip(part.mix_source, part.mix_block, part.mix_slot):
            k = b - base.get(s, 0)
            assert b == seen[s] and k * total // weights[s] <= slot - at < -(-(k + 1) * total // weights[s])
            seen[s] += 1
        at += len(part)
        left -= Counter(part.mix_source)
    assert not +left


def test_mix_of_any_weights(spark, monkeypatch):
    rng = random.Random(3)
    data = [(None if k % 11 == 0 else k // 2, "t" + str(k // 3), rng.choice("aab"), 1, "s") for k in range(900)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, n int, slot string").repartition(3)
    for weights, small in (({"a": 1_000_003, "b": 99_991}, 100_000), ({"a": 30, "b": 20}, 0), ({"a": 2, "b": 7}, 100_000)):
        monkeypatch.setattr(mixing, "SMALL", small)
        out = mixing.mix(df, weights, other=10, block=3)
        assert set(out.columns) == {*df.columns, *mixing.ADDED}
        got = out.toPandas()
        assert Counter(zip(got.text, got.source, got.n, got.slot)) == Counter((t, s, n, x) for _, t, s, n, x in data)
        check_schedule(got, {**weights, mixing.OTHER: 10}, 3)
    with pytest.raises(ValueError):
        mixing.mix(df, {"a": 0})
    assert mixing.mix(empty(spark), {"a": 1}).count() == 0


def test_phases_list_no_more_than_there_are_blocks():
    plan = mixing.phases({"a": 7, "b": 3, "c": 0}, {"a": 10**9 + 7, "b": 10**8, "c": 5})
    assert sum(len(x[3]) for f in plan for x in f["span"].values()) <= 2 * 10


# URL rules


def test_rules_of_four_tokens(spark):
    rng = random.Random(4)
    data = []
    for k in range(1600):
        bad = k % 40 == 0
        host, parts = "a.org", ["p", "q", "r", "s"]
        if not bad:
            parts[rng.randrange(4)] = "other"  # any three of the four are common among allowed pages
        data.append((k, f"http://{host}/{'/'.join(parts)}/{k}", bad))
    for _ in range(40):
        data.append((len(data), "http://a.org/p/q/r/s/" + str(len(data)), None))
    pages = spark.createDataFrame([(k, u) for k, u, _ in data], "page_id long, url string")
    labels = spark.createDataFrame([(k, b) for k, _, b in data], "page_id long, block boolean")
    got = {r.page_id: r.verdict for r in urls.judge(pages, labels).collect()}
    assert all(got[k] == ("block" if "/p/q/r/s/" in u else "allow") for k, u, _ in data)
    toks = pages.join(labels, "page_id").select(urls.url_tokens(F.col("url")).alias("t"), "block")
    rules = [set(r["items"]) for r in urls.mine_rules(toks, "t", "block").collect()]
    assert {"p:p", "p:q", "p:r", "p:s"} in rules and not any(a < b for a in rules for b in rules)


# WARC


def test_wrong_bodies_are_found_and_archives_roll(spark, monkeypatch):
    good = warc.record(3, "http://h", b"<p>body</p>", None, "2024-01-01T00:00:00Z")
    assert warc.parse(good)["payload_bytes"] == 11
    with pytest.raises(ValueError, match="the body is"):
        warc.parse(good.replace(b"body", b"bodx"))
    monkeypatch.setattr(warc, "ROLL_BYTES", 200)
    pages = spark.createDataFrame([(k, None, f"<p>{prose(random.Random(k), 20)}</p>") for k in range(40)], "page_id long, url string, html string").coalesce(2)
    files = warc.write_archives(pages, new_folder(spark, "warc"))
    names = [r.path for r in files.collect()]
    assert len(names) > 8 and all(n.startswith("file:") for n in names)
    assert sorted(r.page_id for r in warc.read_archives(files).collect()) == list(range(40))


# Outliers


def test_small_groups_are_pooled_by_rows_that_count(spark):
    rng = random.Random(6)
    rows = [(k, prose(rng, 40), "en", "big") for k in range(60)]
    rows += [(100 + k, prose(rng, 40), "en", f"small{k % 3}") for k in range(60)]  # pooled by language
    rows += [(200 + k, "too short", "en", "failing") for k in range(80)] + [(300 + k, prose(rng, 40), "en", "failing") for k in range(3)]
    rows += [(400 + k, prose(rng, 40), "xx", "rare") for k in range(5)]  # too few everywhere
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in outliers.outlier_report(df, least=50).collect()}
    assert all(got[k].distance is not None for k in [*range(60), *range(100, 160), *range(300, 303)])
    assert all(got[400 + k].distance is None and got[400 + k].kept for k in range(5))
    stats = spark.createDataFrame([("en", "failing", True)] * 80 + [("en", "failing", False)] * 3 + [("en", "big", False)] * 60, "lang string, source string, base_failed boolean")
    names = {r.source: r.g for r in outliers.grouped(stats, least=50).collect()}
    assert names["failing"] == "rest" and names["big"] != "rest"


# Pipeline


def awkward(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    some = docs.limit(5)
    more = [docs, some, some.withColumn("doc_id", F.lit(None).cast("long")), some.withColumn("text", F.lit(None).cast("string")), some.withColumn("text", F.lit("")),
            some.withColumns({"source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")}), docs.limit(1).withColumn("text", F.repeat("text", 300))]
    out = more[0]
    for m in more[1:]:
        out = out.unionByName(m)
    return out.withColumns({"key": F.lit("c"), "mix_slot": F.lit(1), "predicted": F.lit("p"), "component": F.lit(2)})


@pytest.mark.parametrize("k", range(5))
def test_stages_take_awkward_rows_and_empty_tables(spark, k):
    docs = common.materialize(awkward(spark))
    name, stage = cp.STAGES[k]
    out = common.materialize(stage(spark, docs, SF))
    if k < 4:
        assert out.columns == docs.columns
        assert all((r.key, r.mix_slot, r.predicted, r.component) == ("c", 1, "p", 2) for r in out.collect())
        kept, had = (Counter((r.doc_id, r.text, r.source) for r in d.collect()) for d in (out, docs))
        assert not kept - had
        if name == "mixed":
            assert kept == had
    else:
        assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in docs.collect())
    assert stage(spark, common.materialize(docs.where("false")), SF).count() == 0


def test_run_on_empty_documents(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        (df.where("false") if t == "documents" else df).coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
