"""Registered queries of the text operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from tidemark.llm import boosted, decontaminate, jaccard, lines, middle, mixing, outliers, packing, pivots, suffixes, tokens, urls, warc
from tidemark.llm.common import table
from tidemark.plans.registry import Query

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
WEIGHTS = {"src0": 20, **{f"src{k}": 6 for k in range(1, 10)}, **{f"src{k}": 2 for k in range(10, 20)}}
SPACE_SQL = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '"


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_pfair_mix")
def op1_pfair_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, WEIGHTS).select("doc_id", "source", "mix_source", "mix_phase", "mix_block", "mix_slot", "mix_rank")


@query("op2_decontaminate")
def op2_decontaminate(spark, sf_dir):
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_outliers")
def op3_outliers(spark, sf_dir):
    return outliers.outlier_report(table(spark, sf_dir, "documents"))


@query("op4_quality")
def op4_quality(spark, sf_dir):
    return boosted.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# Base32 of a hex SHA-1: 8 groups of 5 hex digits give 4 letters each.
_HEX = "+".join(f"((strpos('0123456789abcdef', substr(s, (j//4)*5+{t + 1}, 1))-1) << {16 - 4 * t})" for t in range(5))


@query("op5_warc", f"""
WITH p AS (SELECT page_id, encode(coalesce(html,'')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS s, sha256(b) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS best FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((({_HEX}) >> (15 - 5*(j%4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM m""")
def op5_warc(spark, sf_dir):
    return warc.archive_report(table(spark, sf_dir, "pages"))


@query("op6_repeats", """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text,'')))) AS x FROM documents),
w AS (SELECT doc_id, p, substr(x, 2*p+1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, greatest(length(x)//2-49, 0))) AS p FROM d)),
f AS (SELECT s, min(doc_id) AS a FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT w.doc_id, p FROM w JOIN f ON w.s = f.s WHERE w.doc_id > f.a),
g AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 OR lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL THEN 1 ELSE 0 END AS new FROM r),
n AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g),
c AS (SELECT doc_id, k, min(p) AS lo, max(p)+50 AS hi FROM n GROUP BY doc_id, k),
e AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM c),
k AS (SELECT e.doc_id, count(*) AS n_spans, sum(hi-lo) AS n_removed, string_agg(substr(x, 2*before+1, 2*(lo-before)), '' ORDER BY lo) || substr(any_value(x), 2*max(hi)+1) AS kept
      FROM e JOIN d USING (doc_id) GROUP BY e.doc_id)
SELECT d.doc_id, CAST(length(x)//2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""")
def op6_repeats(spark, sf_dir):
    return suffixes.repeat_report(table(spark, sf_dir, "documents"))


@query("op7_line_dedup", f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text,''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text,''), chr(10)), 1) AS p FROM documents),
k AS (SELECT *, translate(trim(line, {SPACE_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
f AS (SELECT k, min(doc_id) AS first FROM k WHERE length(k) >= 10 GROUP BY k),
m AS (SELECT k.doc_id, p, line, coalesce(k.doc_id > f.first, false) AS gone FROM k LEFT JOIN f ON k.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""")
def op7_line_dedup(spark, sf_dir):
    return lines.line_report(table(spark, sf_dir, "documents"))


@query("op8_token_files")
def op8_token_files(spark, sf_dir):
    return tokens.token_report(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op9_jaccard", f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w)-3, CASE WHEN len(w)>0 THEN 2 ELSE 1 END))) AS k FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100*k >= 80*(x.n+y.n-k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v WHERE r.c < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) c ON c.v = d.doc_id""")
def op9_jaccard(spark, sf_dir):
    return jaccard.jaccard_report(table(spark, sf_dir, "documents"))


@query("op10_url_rules")
def op10_url_rules(spark, sf_dir):
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), urls.label_blocks(table(spark, sf_dir, "labels"))
    return urls.judge(pages, labels).select("page_id", "host", "path", "rule", "verdict")


@query("op11_best_fit")
def op11_best_fit(spark, sf_dir):
    return packing.packing_report(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def _vector_code_sql() -> str:
    """Six rounds written out, eight parts of sixteen entries; distances by integers."""
    d = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1]-z[2])*(z[1]-z[2])))"
    steps = []
    for k in range(7):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT vec_id, label, part, min(d * 16 + e) % 16 AS e, min(d) AS d FROM (SELECT p.r, vec_id, label, p.part, c.e, {d} AS d FROM p JOIN c{k} c USING (part)) GROUP BY r, vec_id, label, part)""")
        if k < 6:
            steps.append(f"""m{k} AS (
  SELECT part, e, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS v FROM (
    SELECT part, e, j, sum(v)::HUGEINT AS s, count(*) AS n FROM (SELECT a.part, a.e, unnest(p.x) AS v, unnest(range(len(p.x))) AS j FROM a{k} a JOIN p ON a.vec_id = p.vec_id AND a.part = p.part) GROUP BY part, e, j)),
c{k + 1} AS MATERIALIZED (
  SELECT c.part, c.e, coalesce(n.x, c.x) AS x FROM c{k} c LEFT JOIN (SELECT part, e, list(v ORDER BY j) AS x FROM m{k} GROUP BY part, e) n ON n.part = c.part AND n.e = c.e)""")
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * x) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, vec_id, label, part, q[part*len(q)//8 + 1:(part+1)*len(q)//8] AS x FROM k, (SELECT unnest(range(8)) AS part)),
c0 AS MATERIALIZED (SELECT part, r AS e, x FROM p WHERE r < 16),
{", ".join(steps)},
s AS (SELECT vec_id, any_value(label) AS label, string_agg('0' || substr('0123456789abcdef', CAST(e + 1 AS BIGINT), 1), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, e, j)) AS h FROM (SELECT part, e, unnest(x) AS v, unnest(range(len(x))) AS j FROM c6))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM s, h"""


@query("op12_laesa_codes", _vector_code_sql())
def op12_laesa_codes(spark, sf_dir):
    return pivots.code_report(table(spark, sf_dir, "embeddings"))


@query("op13_middle")
def op13_middle(spark, sf_dir):
    return middle.middle_report(table(spark, sf_dir, "documents"))
