"""URL filter: a list of host and path rules, then association rules mined from labelled URLs.

Stated rules go first; the longest that fits wins. For the other URLs, FP-growth finds combinations of URL tokens that
come with the label "block" often enough (support) and almost only with it (confidence), of any number of tokens. A rule
that contains a more general rule of no smaller confidence is pruned. Rules are matched by an inverted index: each rule is filed under its
rarest token, URLs meet the rules filed under any of their tokens, and the rest of the rule is then checked.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no tokens, and is allowed. Without
labelled rows, or without rules that pass, everything that no stated rule blocks is allowed. Rows that repeat are judged
alike, each on its own; null labels do not take part in mining. Columns of the input called like the added ones are
replaced; all others pass through, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ascii_lower, fixed, free_names

BLOCK = "=block"
MIN_SUPPORT = 0.001  # share of the labelled URLs
MIN_CONFIDENCE = 0.8
#: (verdict, host, path): fits the host and its subdomains where the path starts alike.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def url_host(url: Column) -> Column:
    """Lower-cased text after the first ``://`` up to the path, query or fragment; empty if there is none."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_hit(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host and its labels, path segments (digits masked), query keys; empty without a host."""
    host, path = url_host(url), url_path(url)
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    named = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.regexp_replace(x, "[0-9]+", "0"))
    keys = F.transform(F.split(query, "&"), lambda x: F.regexp_replace(x, "(?s)=.*", ""))
    tokens = F.array_distinct(F.concat(F.array(F.concat(F.lit("s:"), scheme), F.concat(F.lit("d:"), host)), named("h:", F.split(host, r"\.")), named("p:", segments), named("q:", keys)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(tokens)


def mine_rules(labelled: DataFrame, tokens: str, block: str, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules ``items`` (sorted tokens), ``confidence``, ``support`` that predict the label, without redundant ones.

    The cost of mining follows the distinct token combinations above the support, which is a share of the rows, so that
    the number of rules does not grow with them.
    """
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "items array<string>, confidence double, support double")
    rows = labelled.where(F.col(block).isNotNull() & (F.size(tokens) > 0)).select(F.when(F.col(block), F.array_append(tokens, F.lit(BLOCK))).otherwise(F.col(tokens)).alias("items"))
    rows = fixed(rows)
    if rows.isEmpty():
        return empty
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows)
    n = rows.count()
    sets = fixed(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"))
    with_block = sets.where(F.array_contains("items", BLOCK) & (F.size("items") > 1)).select(F.array_remove("items", BLOCK).alias("items"), F.col("freq").alias("hits"))
    rules = with_block.join(sets, "items").select("items", (F.col("hits") / F.col("freq")).alias("confidence"), (F.col("hits") / n).alias("support")).where(F.col("confidence") >= min_confidence)
    rules = fixed(rules)
    # Redundant: some rule of fewer tokens, all of them among these, has no smaller confidence. Filed under its first token, as
    # rules are matched to URLs, each rule meets only those that share a token with it.
    filed = rules.select(F.element_at("items", 1).alias("token"), F.col("items").alias("sub"), F.col("confidence").alias("c"))
    each = rules.select("items", "confidence", F.explode("items").alias("token")).join(filed, "token")
    inside = (F.size("sub") < F.size("items")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("sub", "items")) == 0)
    return rules.join(each.where(inside).select("items").distinct(), "items", "left_anti")


def index_rules(rules: DataFrame, labelled: DataFrame, tokens: str) -> DataFrame:
    """Inverted index: each rule under its rarest token among the labelled URLs."""
    freq = labelled.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    each = rules.select("items", F.explode("items").alias("token")).join(freq, "token", "left")
    return each.groupBy("items").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))


def judge(pages: DataFrame, labels: DataFrame, url: str = "url", page_id: str = "page_id", rules: Sequence[tuple[str, str, str]] = RULES, **mining) -> DataFrame:
    """The pages with ``host``, ``path``, ``rule`` and ``verdict``; ``labels``: (page_id, block boolean)."""
    own = pages.drop("host", "path", "rule", "verdict")
    key, mark, toks, u, bad_, hit_ = free_names(own, "key", "mark", "tokens", "distinct_url", "bad", "hit")
    marks = labels.select(F.col(page_id).alias(key), F.col("block").alias(mark))
    learn = own.select(F.col(page_id).alias(key), url_tokens(F.col(url)).alias(toks)).join(marks, key)
    learn = fixed(learn.select(toks, mark))
    found = fixed(index_rules(mine_rules(learn, toks, mark, **mining), learn, toks))
    # URLs meet the rules filed under their tokens; distinct URLs only, so that repeated ones are judged once.
    urls = own.select(F.col(url).alias(u)).where(F.col(u).isNotNull()).distinct().withColumn(toks, url_tokens(F.col(u)))
    bad = urls.select(u, toks, F.explode(toks).alias("token")).join(found, "token").where(F.size(F.array_except("items", toks)) == 0).select(u).distinct()
    out = own.join(bad.withColumn(bad_, F.lit(True)), F.col(url) == F.col(u), "left")
    host, path = url_host(F.col(url)), url_path(F.col(url))
    out = out.withColumns({"host": host, "path": path}).withColumn(hit_, rule_hit(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col(f"{hit_}.verdict"), F.when(F.col(bad_), "block").otherwise("allow"))
    return out.withColumns({"rule": F.col(f"{hit_}.rule"), "verdict": verdict}).drop(u, bad_, hit_)


def label_blocks(labels: DataFrame) -> DataFrame:
    """(page_id, block): a page is labelled by the row of its id; low quality or toxic means block, both null: no label."""
    bad = F.greatest(1 - F.col("quality"), F.col("toxic"))
    return labels.select(F.col("doc_id").cast(T.LongType()).alias("page_id"), (bad == 1).alias("block"))
