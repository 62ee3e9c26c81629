"""Which items were in which sprint at an instant, and what that sprint had committed to.

Sprint membership of an item is a step function of id sets. Each interval of that function is
exploded to (item, id) rows and meets the sprint table through one equi join on (project, id kind,
id); the instant is then a residual filter. No sprint is compared with items that never named it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import (
    NULL_SET_WORDS, days_between, field_kind, id_text, id_tokens, number_or_text,
)
from tidemark.operators.asof import value_asof, value_intervals, value_spans
from tidemark.operators.ordered import order_rows
from tidemark.operators.skew import lookup_join
from tidemark.session import materialize
from tidemark.sources.tables import require_columns

AGGREGATES = [
    "committed_issue_count", "committed_story_points", "completed_issue_count", "not_completed_count",
    "delivered_story_points",
]


def sprint_ids(sprints: DataFrame) -> DataFrame:
    """(project, kind, token) -> sprint with its dates; kinds db id, external id and name.

    Of sprints that share an id the one that starts later wins.
    """
    name = F.lower(F.trim("sprint_name")) if "sprint_name" in sprints.columns else F.lit(None).cast("string")
    kinds = {"raw": id_text(F.col("raw_sprint_id")), "jira": id_text(F.col("jira_sprint_id")), "name": name}
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("token")) for k, t in kinds.items()])
    rows = sprints.select("project", "sprint_id", "start_date", "end_date", F.explode(entries).alias("e"))
    return (
        rows.where(F.col("e.token").isNotNull()).groupBy("project", "e.kind", "e.token")
        .agg(F.max(F.struct("start_date", "sprint_id", "end_date")).alias("s"))
        .select("project", "kind", "token", "s.sprint_id", "s.start_date", "s.end_date")
    )


HEAD = 4  # characters of a name by which the places of a text are sifted


def _places(texts: DataFrame, pieces: DataFrame) -> DataFrame:
    """(project, text, at, head): where a text holds one of the short ``pieces`` (project, head) of its project."""
    sizes = pieces.groupBy("project").agg(F.collect_set(F.length("head")).alias("sizes"))
    at = lookup_join(texts, sizes, ["project"], "inner").withColumn("n", F.explode("sizes")).where(F.length("text") >= F.col("n"))
    at = at.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("text") - F.col("n") + 1)))
    return at.select("project", "text", "at", F.substr("text", F.col("at"), F.col("n")).alias("head"))


def names_in_text(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(project, text) -> sprints named by it: the exact name alone, else every name it contains.

    Texts that are a name meet it in one equi join. In the others the first ``HEAD`` characters of the names, a small
    table, are looked up at every place; only where one stands are the substrings of the lengths that names with this
    beginning have joined with the names: exact, and linear in the text length.
    """
    names = materialize(ids.where((F.col("kind") == "name") & (F.col("token") != "")).select("project", "token", "sprint_id", "start_date", "end_date"))
    told = ["sprint_id", "start_date", "end_date"]
    marked = materialize(texts.distinct().join(names.withColumnRenamed("token", "text"), ["project", "text"], "left"))
    rest = marked.where(F.col("sprint_id").isNull()).select("project", "text")
    head = F.substr("token", F.lit(1), F.lit(HEAD))
    heads = materialize(names.groupBy("project", head.alias("head")).agg(F.collect_set(F.length("token")).alias("lengths")))
    found = lookup_join(_places(rest, heads), heads, ["project", "head"], "inner").withColumn("n", F.explode("lengths"))
    found = found.where(F.col("at") + F.col("n") - 1 <= F.length("text"))
    pieces = found.select("project", "text", F.substr("text", F.col("at"), F.col("n")).alias("token"))
    inside = pieces.join(names, ["project", "token"]).select("project", "text", *told).distinct()
    both = marked.where(F.col("sprint_id").isNotNull()).select("project", "text", *told).unionByName(inside)
    return both.select("project", F.lit("text").alias("kind"), F.col("text").alias("token"), *told)


def membership_events(change_log: DataFrame) -> DataFrame:
    """Sprint-field changes as events whose values are (ids, text) cells."""
    cell = lambda v, s: F.struct(F.col(v).alias("ids"), F.col(s).alias("text"), F.lit(None).cast("string").alias("raw"))
    return _relevant(change_log).where(F.col("kind") == "sprint").select(
        "raw_issue_id", F.col("change_date").alias("ts"), F.col("change_id").alias("tie"),
        cell("from_value", "from_string").alias("before"), cell("to_value", "to_string").alias("after"),
    )


def _relevant(change_log: DataFrame) -> DataFrame:
    log = change_log if "change_id" in change_log.columns else change_log.withColumn("change_id", F.lit(0).cast("long"))
    return log.withColumn("kind", field_kind(F.col("field"))).where(
        F.col("kind").isNotNull() & F.col("raw_issue_id").isNotNull() & F.col("change_date").isNotNull()
    )


def explode_tokens(spans: DataFrame) -> DataFrame:
    """One row per distinct id of a membership cell: kind, token, and how often the cell repeats it.

    The text counts only without an id list.
    """
    cell = F.col("value")
    text = F.lower(F.trim(cell["text"]))
    readable = text.isNotNull() & ~text.isin(NULL_SET_WORDS)
    d = spans.withColumns({"ids_": id_tokens(cell["ids"]), "text_": F.when(readable, text)})
    kind = F.when(cell["raw"].isNotNull(), "raw").when(F.col("ids_").isNotNull(), "jira").otherwise("text")
    tokens = (
        F.when(cell["raw"].isNotNull(), F.array(cell["raw"])).when(F.col("ids_").isNotNull(), F.array_distinct("ids_"))
        .when(F.col("text_").isNotNull(), F.array("text_"))
    )
    d = d.withColumn("kind", kind).withColumn("token", F.explode(tokens))
    times = F.when(F.col("kind") == "jira", F.size("ids_") - F.size(F.array_remove("ids_", F.col("token")))).otherwise(1)
    return d.withColumn("times", times).drop("ids_", "text_", "value")


def membership_rows(sprints: DataFrame, issues: DataFrame, change_log: DataFrame, slices: int | None = None) -> DataFrame:
    """One row per (item, membership interval, named id), with the sprint where the id is known."""
    require_columns(sprints=sprints, issues=issues, change_log=change_log)
    ids = sprint_ids(sprints)
    projects = sprints.select("project").distinct()
    known = lookup_join(issues, projects.withColumn("has_", F.lit(True)), ["project"], "inner").drop("has_")
    events = materialize(membership_events(change_log))  # parsed once, read for the order and for the keys
    null = F.lit(None).cast("string")
    static = known.select(
        "raw_issue_id",
        F.struct(null.alias("ids"), null.alias("text"), id_text(F.col("raw_sprint_id")).alias("raw")).alias("value"),
    )
    spans = value_intervals(events, static, "raw_issue_id", slices)
    spans = explode_tokens(spans)
    attributes = ["story_point", *[c for c in ("issue_key", "issue_type") if c in known.columns]]
    spans = materialize(spans.join(known.select(
        "raw_issue_id", "project", "creation_date", "resolution_date", *attributes
    ), "raw_issue_id"))  # read twice: for the texts and for the ids
    texts = spans.where(F.col("kind") == "text").select("project", F.col("token").alias("text"))
    ids = ids.where(F.col("kind") != "name").unionByName(names_in_text(texts, ids))
    return spans.join(ids, ["project", "kind", "token"], "left")


def holds_at(t: Column) -> Column:
    """Does the interval contain the instant?"""
    from_ok = F.col("valid_from").isNull() | (F.col("valid_from") <= t)
    return from_ok & (F.col("valid_to").isNull() | (t < F.col("valid_to")))


def created_by(t: Column) -> Column:
    return F.col("creation_date").isNull() | (F.col("creation_date") <= t)


def open_until(t: Column) -> Column:
    """Not resolved strictly before t."""
    return F.col("resolution_date").isNull() | (F.col("resolution_date") >= t)


def start_memberships(rows: DataFrame) -> DataFrame:
    """Members of each sprint at its start, before the creation and resolution rules."""
    t = F.col("start_date")
    return rows.where(F.col("sprint_id").isNotNull() & holds_at(t)).select(
        "project", "raw_issue_id", "sprint_id", "start_date", "end_date", "creation_date", "resolution_date",
        F.col("story_point").cast("double").alias("static_value"), *[c for c in ("issue_key", "issue_type") if c in rows.columns],
        F.when(F.col("from_history"), "observed_sprint_history").otherwise("static_sprint_fallback").alias("sprint_source"),
    )


def parsed_events(change_log: DataFrame) -> DataFrame:
    """Events of both fields: sprint cells as the kind and tokens that count (``s_before``, ``s_after``), points as numbers (``p_before``, ``p_after``)."""

    def cell(v: str, s: str) -> Column:
        ids, text = id_tokens(F.col(v)), F.lower(F.trim(F.col(s)))
        readable = text.isNotNull() & ~text.isin(NULL_SET_WORDS)
        names = F.when(readable, F.array(text)).otherwise(F.array().cast("array<string>"))
        return F.struct(F.when(ids.isNotNull(), "jira").otherwise("text").alias("kind"), F.coalesce(F.array_distinct(ids), names).alias("tokens"))

    def points(v: str, s: str) -> Column:
        return F.struct(number_or_text(F.col(v), F.col(s)).alias("v"))

    sprint = F.col("kind") == "sprint"
    return _relevant(change_log).select(
        "raw_issue_id", F.col("change_date").alias("ts"), F.col("change_id").alias("tie"),
        *[F.when(sprint, cell(f"{x}_value", f"{x}_string")).alias(f"s_{y}") for x, y in (("from", "before"), ("to", "after"))],
        *[F.when(~sprint, points(f"{x}_value", f"{x}_string")).alias(f"p_{y}") for x, y in (("from", "before"), ("to", "after"))])


def item_states(
    sprints: DataFrame, issues: DataFrame, change_log: DataFrame, times: Sequence[tuple[str, Column]], keep: Sequence[str] = (), slices: int | None = None
) -> DataFrame:
    """One row per item and sprint that it was in at one of ``times`` at least: membership ``in_<name>`` and points ``sp_<name>`` at each.

    Membership is read off intervals: every id of an interval meets its sprint once, and the sprint's instants fall into the
    interval or not. Items, their flags and their intervals meet on the item id, dealt once. Points are probed, in one scan
    by item, only for members whose item has changes of points; the others have their present-day value. The first probe
    of a member carries its other columns, so that they are not joined again. ``times``: (name, instant drawn from the
    sprint's dates); ``keep``: item columns that the result carries too.
    """
    require_columns(sprints=sprints, issues=issues, change_log=change_log)
    key, span = ["raw_issue_id"], ["start_date", "end_date"]
    ids = materialize(sprint_ids(sprints))
    facts = ["project", "creation_date", "resolution_date", *keep]
    events = materialize(parsed_events(change_log))  # parsed once; both fields are read from it
    moves = events.where("s_before IS NOT NULL").select(*key, "ts", "tie", F.col("s_before").alias("before"), F.col("s_after").alias("after"))
    points = events.where("p_before IS NOT NULL").select(*key, "ts", "tie", F.col("p_before").alias("before"), F.col("p_after").alias("after"))
    probed = points.select(*key).distinct().withColumn("probed_", F.lit(True))
    of_item = lookup_join(issues.where("raw_issue_id IS NOT NULL"), sprints.select("project").distinct().withColumn("has_", F.lit(True)), ["project"], "inner").select(
        *key, *facts, id_text(F.col("raw_sprint_id")).alias("static_id"), F.col("story_point").cast("double").alias("static_value"))
    # rows of one item share their present-day ids; items without sprint changes have one open interval with them
    item = of_item.withColumn("static_id", F.collect_set("static_id").over(Window.partitionBy(*key))).join(probed, "raw_issue_id", "left")
    rows = item.join(value_spans(moves, "raw_issue_id", slices).drop("last"), "raw_issue_id", "left")
    moved = F.col("from_history").isNotNull()
    rows = rows.select(
        *key, *facts, "static_value", "probed_", "valid_from", "valid_to", moved.alias("from_history"),
        F.when(moved, F.col("value.kind")).otherwise("raw").alias("kind"), F.explode(F.when(moved, F.col("value.tokens")).otherwise(F.col("static_id"))).alias("token"))
    named = materialize(rows)  # read twice: for the texts and for the ids
    texts = named.where("kind = 'text'").select("project", F.col("token").alias("text"))
    ids = ids.where("kind <> 'name'").unionByName(names_in_text(texts, ids))
    inside = {f"in_{n}": F.when(t.isNotNull(), holds_at(t)) for n, t in times}
    there = reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(False)) for c in inside])
    pairs = named.join(ids, ["project", "kind", "token"]).withColumns(inside).where(there)
    pairs = pairs.groupBy(*key, "sprint_id").agg(
        F.first(F.struct(*span, *facts)).alias("of_"), F.max("static_value").alias("static_value"), F.max("from_history").alias("from_history"),
        F.max(F.coalesce("probed_", F.lit(False))).alias("points_from_history"), *[F.max(c).alias(c) for c in inside])
    rest = [*span, *facts, "static_value", "from_history", "points_from_history", *inside]
    pairs = materialize(pairs.select(*key, "sprint_id", "of_.*", *rest[len(span) + len(facts):]))
    instants = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), t.alias("at")) for k, (_, t) in enumerate(times)]), lambda x: x["at"].isNotNull())
    probes = pairs.where("points_from_history").select("*", F.posexplode(instants).alias("n_", "p_"))
    probes = probes.select(*key, "sprint_id", "p_.*", F.when(F.col("n_") == 0, F.struct(*rest)).alias("rest_"))
    seen = value_asof(points, probes, "raw_issue_id", "at", slices=slices)
    at = [F.max(F.when(F.col("k") == k, F.col("value.v"))).alias(f"at_{k}") for k in range(len(times))]
    probed = seen.groupBy(*key, "sprint_id").agg(F.first("rest_", ignorenulls=True).alias("rest_"), *at)
    probed = probed.select(*key, "sprint_id", "rest_.*", *[f"at_{k}" for k in range(len(times))])
    out = probed.unionByName(pairs.where("NOT points_from_history"), allowMissingColumns=True)  # the others meet no probe and stay where they are
    value = lambda k, t: F.when(F.col("points_from_history"), F.col(f"at_{k}")).when(t.isNotNull(), F.col("static_value"))
    return out.select(
        *key, "sprint_id", *span, *facts, *inside, *[value(k, t).alias(f"sp_{n}") for k, (n, t) in enumerate(times)],
        "from_history", "points_from_history")


def commitments(sprints: DataFrame, issues: DataFrame, change_log: DataFrame, slices: int | None = None) -> DataFrame:
    """One row per committed (item, sprint) with its points at the start and where both facts come from."""
    t = F.col("start_date")
    keep = [c for c in ("issue_key", "issue_type") if c in issues.columns]
    pairs = item_states(sprints, issues, change_log, [("start", t)], keep, slices)
    members = pairs.where(F.col("in_start") & created_by(t) & open_until(t))
    return members.select(
        "project", "raw_issue_id", "sprint_id", "start_date", "end_date", "creation_date", "resolution_date", *keep,
        F.when(F.col("from_history"), "observed_sprint_history").otherwise("static_sprint_fallback").alias("sprint_source"),
        F.col("sp_start").alias("story_point_at_start"),
        F.when(F.col("points_from_history"), "observed_story_history").otherwise("static_story_fallback").alias("story_point_source"),
        F.coalesce(F.col("resolution_date") <= F.col("end_date"), F.lit(False)).alias("completed_by_end"))


def planning_scope(sprints: DataFrame, issues: DataFrame, change_log: DataFrame, slices: int | None = None) -> DataFrame:
    """Sprints with the five aggregates of the scope committed at their start."""
    c = commitments(sprints, issues, change_log, slices)
    return with_scope(sprints, c)


def with_scope(sprints: DataFrame, committed: DataFrame) -> DataFrame:
    points = F.coalesce(F.col("story_point_at_start"), F.lit(0.0))
    agg = committed.groupBy("sprint_id").agg(
        F.count(F.lit(1)).alias("committed_issue_count"),
        F.sum(points).alias("committed_story_points"),
        F.count_if("completed_by_end").alias("completed_issue_count"),
        F.count_if(~F.col("completed_by_end")).alias("not_completed_count"),
        F.sum(F.when(F.col("completed_by_end"), points).otherwise(F.lit(0.0))).alias("delivered_story_points"),
    )
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in AGGREGATES}
    return (
        sprints.join(agg, "sprint_id", "left").withColumns(zero)
        .withColumn("sprint_length_days", days_between(F.col("end_date"), F.col("start_date")))
    )


def static_scope(sprints: DataFrame, issues: DataFrame) -> DataFrame:
    """Scope by the present-day sprint id of the items, with the number of assignees."""
    dates = sprints.select("project", "raw_sprint_id", "sprint_id", "end_date")
    m = issues.where(F.col("raw_sprint_id").isNotNull()).join(dates, ["project", "raw_sprint_id"])
    done = F.coalesce(F.col("resolution_date") <= F.col("end_date"), F.lit(False))
    points = F.coalesce(F.col("story_point"), F.lit(0.0))
    agg = m.groupBy("sprint_id").agg(
        F.count(F.lit(1)).alias("committed_issue_count"), F.sum(points).alias("committed_story_points"),
        F.count_if(done).alias("completed_issue_count"), F.count_if(~done).alias("not_completed_count"),
        F.sum(F.when(done, points).otherwise(0.0)).alias("delivered_story_points"),
        F.countDistinct("assignee").alias("num_developers"),
    )
    names = [*AGGREGATES, "num_developers"]
    return sprints.join(agg, "sprint_id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in names})


def scope_audit(sprints: DataFrame, issues: DataFrame, change_log: DataFrame, slices: int | None = None) -> DataFrame:
    """One row of counters that say how much of the reconstruction rests on history."""
    n = lambda c: F.count_if(c)
    rel = _relevant(change_log)
    rows = materialize(membership_rows(sprints, issues, change_log, slices))
    t = F.col("start_date")
    members = start_memberships(rows)
    committed = members.where(created_by(t) & open_until(t))
    known = lookup_join(issues, sprints.groupBy("project").agg(F.min("start_date").alias("first_start")), ["project"], "inner")

    a = issues.agg(F.count(F.lit(1)).alias("issues_seen"))
    b = rel.agg(
        F.count(F.lit(1)).alias("relevant_change_events"),
        n(F.col("kind") == "sprint").alias("sprint_change_events"),
        n(F.col("kind") == "story_point").alias("story_point_change_events"),
    )
    # items with history, and items whose latest history contradicts the static value
    raw_ids = sprint_ids(sprints).where(F.col("kind") == "raw").select(
        "project", F.col("token").cast("long").alias("raw_sprint_id"), F.col("sprint_id").alias("static_id"))
    last = rows.where(F.col("last") & F.col("from_history")).select(
        "raw_issue_id", F.col("sprint_id").alias("static_id"), F.lit(True).alias("in_last")
    ).where(F.col("static_id").isNotNull()).distinct()
    flags = rel.groupBy("raw_issue_id").agg(
        F.max(F.col("kind") == "sprint").alias("has_sprint"), F.max(F.col("kind") == "story_point").alias("has_points"),
        F.max_by(
            F.struct(number_or_text(F.col("to_value"), F.col("to_string")).alias("v")),
            F.when(F.col("kind") == "story_point", F.struct("change_date", "change_id")),
        ).alias("latest"),
    )
    per_item = (
        known.join(flags, "raw_issue_id").join(raw_ids, ["project", "raw_sprint_id"], "left")
        .join(last, ["raw_issue_id", "static_id"], "left")
    )
    c = per_item.agg(
        n("has_sprint").alias("issues_with_sprint_history"),
        n("has_points").alias("issues_with_story_point_history"),
        n(F.col("has_sprint") & F.col("static_id").isNotNull() & F.col("in_last").isNull())
        .alias("latest_sprint_history_vs_static_disagreements"),
        n(F.col("has_points") & (F.abs(F.col("latest.v") - F.col("story_point")) > 1e-6))
        .alias("latest_story_history_vs_static_disagreements"),
    )
    first = sprints.groupBy("project").agg(F.min("start_date").alias("first_start"))
    used = F.col("last") | (F.col("valid_to") > F.col("first_start"))
    d = lookup_join(rows.where(F.col("from_history") & F.col("sprint_id").isNull()), first, ["project"], "inner").agg(
        F.coalesce(F.sum(F.when(used, F.col("times"))), F.lit(0)).alias("unknown_sprint_id_tokens_ignored")
    )
    e = members.agg(
        n(created_by(t) & open_until(t)).alias("issue_sprint_memberships_at_start"),
        n(~created_by(t)).alias("memberships_excluded_issue_created_after_start"),
        n(created_by(t) & ~open_until(t)).alias("memberships_excluded_resolved_before_start"),
    )
    filled = sprints.select("sprint_id").join(committed.select("sprint_id").distinct().withColumn("has_", F.lit(True)), "sprint_id", "left")
    f = filled.agg(
        F.count(F.lit(1)).alias("sprints_reconstructed"), n(F.col("has_").isNull()).alias("zero_scope_sprints"), n("has_").alias("nonzero_scope_sprints"))
    one = [x.withColumn("one_", F.lit(1)) for x in (a, b, c, d, e, f)]
    return reduce(lambda x, y: x.join(F.broadcast(y), "one_"), one).drop("one_")


def provenance_by_project(committed: DataFrame) -> DataFrame:
    """Commitments per project and how many of them rest on history or on a fallback."""
    counts = {
        "commitments_with_observed_sprint_history": F.col("sprint_source") == "observed_sprint_history",
        "commitments_with_static_sprint_fallback": F.col("sprint_source") == "static_sprint_fallback",
        "commitments_with_observed_story_history": F.col("story_point_source") == "observed_story_history",
        "commitments_with_static_story_fallback": F.col("story_point_source") == "static_story_fallback",
    }
    out = committed.groupBy("project").agg(
        F.count(F.lit(1)).alias("commitments"), *[F.count_if(c).alias(n) for n, c in counts.items()]
    )
    return out.withColumns({f"{n}_rate": F.col(n) / F.col("commitments") for n in counts})


def high_confidence_sprints(committed: DataFrame) -> DataFrame:
    """Sprints whose every committed item comes from observed sprint history."""
    return (
        committed.groupBy("project", "sprint_id")
        .agg(F.count(F.lit(1)).alias("commitments"),
             F.count_if(F.col("sprint_source") == "static_sprint_fallback").alias("fallbacks"))
        .where(F.col("fallbacks") == 0).drop("fallbacks")
    )


def history_rate_sensitivity(committed: DataFrame, cutoffs: Sequence[float]) -> DataFrame:
    """Per cutoff: projects whose observed-history rate reaches it, and their commitments."""
    rates = provenance_by_project(committed).select(
        "commitments", F.col("commitments_with_observed_sprint_history_rate").alias("rate"),
        F.explode(F.array(*[F.lit(float(c)) for c in cutoffs])).alias("cutoff"),
    )
    kept = F.col("rate") >= F.col("cutoff")
    return rates.groupBy("cutoff").agg(
        F.count_if(kept).alias("projects"), F.coalesce(F.sum(F.when(kept, F.col("commitments"))), F.lit(0)).alias("commitments")
    )


def excluded_status_counts(issues: DataFrame, statuses: Sequence[str]) -> DataFrame:
    bad = F.col("status").isin(list(statuses))
    return issues.groupBy("project").agg(F.count(F.lit(1)).alias("items"), F.count_if(bad).alias("excluded_items"))
