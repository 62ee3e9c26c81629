"""The pipeline's stages, one after the other, against brute force on the smallest tables."""

import re
import zlib

import numpy as np
import pytest
from test_text_operators import brute_components, trigrams

import corpus_pipeline as cp
from tidemark.llm import boosted, mixing, queries
from tidemark.llm.common import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """The input of the first stage and the output of each."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(cp.STAGES):
        df = stage(spark, out[-1], SF)
        if k < len(cp.STAGES) - 1:
            assert df.columns == out[0].columns
        out.append(materialize(df))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_classifier_stage(spark, tables):
    scored = boosted.classify(tables[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(tables[1]) == ids(scored.where("score >= 0.3"))


def test_near_duplicate_stage(tables):
    rows = [(r.doc_id, r.text) for r in tables[1].collect()]
    assert ids(tables[2]) == sorted(set(brute_components(rows).values()))


def test_decontamination_stage(spark, tables):
    items = [trigrams(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    share = {}
    for r in tables[2].collect():
        own = set(trigrams(r.text))
        share[r.doc_id] = max(sum(x in own for x in g) / len(g) for g in items)
    stay = set(ids(tables[3]))
    assert all((i in stay) or s > 0.3 for i, s in share.items()) and all(s < 0.8 for i, s in share.items() if i in stay)


def test_mixing_stage_keeps_rows_in_the_order_of_the_schedule(tables):
    assert ids(tables[4]) == ids(tables[3])
    placed = mixing.mix(tables[3], queries.WEIGHTS).orderBy("mix_slot", "mix_rank")
    assert [r.doc_id for r in tables[4].orderBy(*cp.stored_order(tables[4])).collect()] == [r.doc_id for r in placed.collect()]


def test_token_stage_follows_the_stored_order(spark, tables):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    rows = sorted(tables[5].collect(), key=lambda r: r.start)
    text = {r.doc_id: r.text for r in tables[4].collect()}
    assert [r.doc_id for r in rows] == [r.doc_id for r in tables[4].orderBy(*cp.stored_order(tables[4])).collect()]
    at = 0
    for r in rows:
        want = tok.encode(text[r.doc_id], add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)


def test_run_gives_the_same(spark, tables):
    got = sorted(tuple(r) for r in cp.run(spark, SF).collect())
    assert got == sorted(tuple(r) for r in tables[5].collect()) and re.fullmatch("[a-z ]+", cp.STAGES[0][0])
