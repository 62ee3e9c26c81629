"""Issue-tracker tables derived from the driver's order tables.

Orders become time boxes ("sprints"), their lines become items, and a change log with sprint
membership and point changes is derived from the lines, so that every operator runs over whole
tables. The same rules are written once more in SQL in ``tidemark.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import days_between, plus_days
from tidemark.operators.history import add_concurrency, add_strict_history, add_trailing_history
from tidemark.operators.labels import add_labels, add_targets
from tidemark.session import utc

JIRA_OFFSET = 500_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; zone-less timestamps become UTC instants."""
    utc(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz})


def hours(ts, n):
    return F.timestamp_micros(F.unix_micros(ts) + (n * F.lit(3_600_000_000)).cast("long"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a time box."""
    o = load(spark, sf_dir, "orders")
    key, start = F.col("o_orderkey"), F.col("o_orderdate")
    end = plus_days(start, 7 + key % 8)
    project = F.concat(F.lit("P"), (F.col("o_custkey") % 8).cast("string"))
    state = (
        F.when(F.col("o_orderstatus") != "P", "CLOSED").when(key % 2 == 0, "FUTURE").otherwise("ACTIVE")
    )
    return o.select(
        F.concat_ws("__", project, key.cast("string")).alias("sprint_id"),
        key.alias("raw_sprint_id"),
        (key + JIRA_OFFSET).alias("jira_sprint_id"),
        F.concat(F.lit("Box "), key.cast("string")).alias("sprint_name"),
        state.alias("sprint_state"),
        project.alias("project"),
        start.alias("start_date"),
        end.alias("end_date"),
        plus_days(end, key * 13 % 17 - 6).alias("complete_date"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
    )


def closed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.sources.tables import eligible

    return eligible(boxes(spark, sf_dir))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as a work item of its order's project."""
    li = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_linestatus", "l_returnflag", "l_extendedprice",
    )
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, "o_orderkey")
    start, line = F.col("o_orderdate"), F.col("l_linenumber")
    return j.select(
        F.concat_ws("-", "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"))
        .alias("raw_issue_id"),
        F.concat(F.lit("K"), (F.col("o_custkey") % 8).cast("string"), F.lit("-"),
                 (F.col("o_orderkey") * 7 + line).cast("string")).alias("issue_key"),
        F.concat(F.lit("P"), (F.col("o_custkey") % 8).cast("string")).alias("project"),
        F.when(line != 6, F.col("o_orderkey")).alias("raw_sprint_id"),
        plus_days(start, F.col("l_partkey") % 12 - 9).alias("creation_date"),
        F.when(F.col("l_linestatus") == "F", plus_days(start, F.col("l_suppkey") % 23 - 2)).alias("resolution_date"),
        F.when(line != 7, F.col("l_quantity")).alias("story_point"),
        F.when(F.col("l_returnflag") == "A", "Bug").when(F.col("l_returnflag") == "N", "Story")
        .otherwise("Task").alias("issue_type"),
        F.concat_ws("/", "l_linestatus", "l_returnflag").alias("status"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("assignee"),
        start.alias("box_start"), F.col("o_orderkey").alias("box"), line.alias("line"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("qty"),
    )


def changes(item_rows: DataFrame) -> DataFrame:
    """Change log of the items."""
    return (
        item_rows.select("raw_issue_id", "project", F.explode(changes_array()).alias("c"))
        .where(F.col("c").isNotNull()).select("raw_issue_id", "project", "c.*")
    )


def changes_array():
    """Changes of an item: sprint moves with id lists and names, point changes, noise, and nulls between."""
    start, box, line = F.col("box_start"), F.col("box"), F.col("line")
    here = (box + JIRA_OFFSET).cast("string")
    both = F.concat_ws(", ", here, (box + JIRA_OFFSET + 8).cast("string"))
    none = F.lit(None).cast("string")
    moved = plus_days(start, F.col("supp") % 10)

    def row(change_id, cond, field, fv, tv, fs, ts_, when):
        return F.when(cond, F.struct(
            F.lit(change_id).cast("long").alias("change_id"), F.lit(field).alias("field"),
            fv.alias("from_value"), tv.alias("to_value"), fs.alias("from_string"), ts_.alias("to_string"),
            when.alias("change_date"),
        ))

    points = F.col("qty").cast("long")
    name = F.concat(F.lit("Box "), (box + 8).cast("string"))
    moved_to = F.concat(F.lit("moved to Box "), box.cast("string"))
    return F.array(
        row(1, line.isin(1, 4), "Sprint", none, here, none, none,
            hours(plus_days(start, F.col("part") % 7 - 4), line.cast("long"))),
        row(2, line.isin(4, 5), "Sprint", here, both, none, none, hours(moved, F.lit(2))),
        row(3, line == 2, "Story Points", (points - 1).cast("string"), (points + F.col("part") % 2).cast("string"), none, none,
            plus_days(start, F.col("part") % 11 - 3)),
        row(4, line == 3, "Story point estimate", none, none,
            F.concat(F.lit("about "), (points + 2).cast("string"), F.lit(" points")), F.lit("unknown"),
            plus_days(start, F.col("part") % 5)),
        row(5, line == 5, "sprint", both, none, none, F.when(F.col("part") % 2 == 0, name).otherwise(moved_to),
            hours(moved, F.lit(30))),
        row(6, line == 1, "status", F.lit("open"), F.lit("done"), none, none, start),
    )


def nested_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as a nested pull: embedded sprint texts and change tuples per item."""
    i = items(spark, sf_dir)
    day = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'")
    sprint = F.concat(
        F.lit("com.example.Sprint@1[id="), F.col("raw_sprint_id").cast("string"), F.lit(",rapidViewId=9,state=closed,name=Box, "),
        F.col("raw_sprint_id").cast("string"), F.lit(",startDate="), day(F.col("box_start")), F.lit(",completeDate=<null>]"))
    log = F.array_compact(changes_array())
    tuples = F.transform(log, lambda c: F.array(
        c["change_id"].cast("string"), c["field"], c["from_value"], c["to_value"], c["from_string"], c["to_string"], day(c["change_date"])))
    return i.select(
        F.col("project").alias("p"), F.abs(F.xxhash64("raw_issue_id")).cast("string").alias("id"), F.col("issue_key").alias("k"),
        F.col("issue_type").alias("t"), F.col("status").alias("s"), F.col("story_point").alias("sp"), F.lit(None).cast("string").alias("pr"),
        day(F.col("creation_date")).alias("c"), day(F.col("resolution_date")).alias("r"), F.col("assignee").alias("a"),
        F.lit(None).cast("double").alias("oe"), F.when(F.col("raw_sprint_id").isNotNull(), F.array(sprint)).otherwise(F.array().cast("array<string>")).alias("spr"),
        tuples.alias("ch"))


def line_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with the static scope of their lines; a box without lines has scope 0."""
    agg = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("raw_sprint_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("sp"),
        F.count_if(F.col("l_linestatus") == "F").alias("done"),
        F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("done_sp"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return boxes(spark, sf_dir).join(agg, "raw_sprint_id", "left").select(
        "sprint_id", "raw_sprint_id", "project", "sprint_state", "start_date", "end_date", "complete_date", "cents",
        zero("n").alias("committed_issue_count"), zero("sp").cast("double").alias("committed_story_points"),
        zero("done").alias("completed_issue_count"), (zero("n") - zero("done")).alias("not_completed_count"),
        zero("done_sp").cast("double").alias("delivered_story_points"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with static scope, labels and targets."""
    d = add_targets(add_labels(line_scope(spark, sf_dir)))
    return d.withColumn("sprint_length_days", days_between(F.col("end_date"), F.col("start_date")))


def modelling_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled boxes with trailing and strict history and concurrency."""
    return add_strict_history(add_concurrency(add_trailing_history(labelled(spark, sf_dir))))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled boxes with two scores with ties and a 0/1 call drawn from price and key."""
    k = F.col("raw_sprint_id")
    d = labelled(spark, sf_dir).withColumns({"score": F.col("cents") % 1000 / F.lit(1000.0), "score_b": k * 7919 % 997 / F.lit(997.0)})
    return d.withColumns({"pred": (F.col("score") >= 0.5).cast("int"), "pred_b": (F.col("score_b") >= 0.5).cast("int")})


RUNS = (1, 2, 3)


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay points: each nonempty box at the start and at half time, with the calls of a model, a
    rule and two kinds of callers in three runs, drawn from key and price."""
    d = labelled(spark, sf_dir).where("nonempty").withColumn("c_", F.explode(F.array(F.lit(0), F.lit(5))))
    k, cents, c = F.col("raw_sprint_id"), F.col("cents"), F.col("c_")
    cols = {
        "checkpoint": c / F.lit(10.0), "late": F.col("label_delay"), "unfinished": F.col("carry_ratio"),
        "weight": 1 + F.substring("project", 2, 1).cast("int") / F.lit(8.0),
        "m_score": ((cents + c * 137) % 700 + 300 * F.col("label_delay")) / F.lit(1000.0), "m_threshold": F.lit(0.55), "m_unf": (k * 7 + c) % 11 / F.lit(10.0),
        "rule_warn": ((k + c) % 3 == 0).cast("int"),
    }
    for r in RUNS:
        cols |= {
            f"L{r}_p": (k * 31 + r * 17 + c * 7) % 100 / F.lit(100.0), f"L{r}_unf": (k * 3 + r + c) % 11 / F.lit(10.0),
            f"G{r}_p": (cents + k * r * 13 + c * 11) % 100 / F.lit(100.0), f"G{r}_unf": (k * 5 + 2 * r + c) % 11 / F.lit(10.0),
        }
    d = d.withColumns(cols)
    calls = {"m_warn": F.col("m_score") >= F.col("m_threshold")} | {f"{a}{r}_warn": F.col(f"{a}{r}_p") >= 0.5 for a in "LG" for r in RUNS}
    d = d.withColumns({n: x.cast("int") for n, x in calls.items()})
    return d.select("sprint_id", "project", "raw_sprint_id", "start_date", *cols, *calls)
