"""Nested inputs: issue pulls with embedded sprints and changes, agent answers, and transcripts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import struct_text_map, utc_timestamp
from tidemark.operators.summaries import majority_owner

# The short field names of a pull.
PULL_SCHEMA = (
    "p string, id string, k string, t string, s string, sp double, pr string, c string, r string, a string, "
    "oe double, spr array<string>, ch array<array<string>>"
)
_ANSWER_SCHEMA = "id string, warn boolean, p_late double, unfinished double, message string"
_MANIFEST_SCHEMA = "prompt string, run int, arm string, checkpoint double, boards array<string>"


def read_pull(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """One row per issue, from JSON lines or from one document with an ``issues`` array."""
    if lines:
        return spark.read.schema(PULL_SCHEMA).json(path)
    whole = spark.read.schema(f"issues array<struct<{PULL_SCHEMA.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path)
    return whole.select(F.explode("issues").alias("i")).select("i.*")


def sprint_fields(raw):
    """Fields of an embedded sprint, written as JSON or as '...[id=1,state=..,name=..]'."""
    as_json = F.from_json(raw, "map<string,string>")
    return F.when(F.ltrim(raw).startswith("{"), as_json).otherwise(struct_text_map(raw))


def _embedded(pull: DataFrame) -> DataFrame:
    s = pull.select("p", F.col("id").alias("issue"), F.posexplode("spr").alias("at", "raw")).withColumn("m", sprint_fields(F.col("raw")))
    sid = F.trim(F.col("m")["id"])
    return s.withColumn("sid", sid).where(F.col("sid").rlike(r"^\d+$"))


def flatten_sprints(pull: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """One row per sprint: its owner is the project of most of its issues; other boards' strays are dropped."""
    emb = _embedded(pull)
    get = lambda k: F.col("m")[k]
    facts = emb.groupBy("sid").agg(
        F.min_by(F.struct(
            get("name").alias("sprint_name"), F.upper(get("state")).alias("sprint_state"),
            utc_timestamp(get("startDate")).alias("start_date"), utc_timestamp(get("activatedDate")).alias("activated_date"),
            utc_timestamp(get("endDate")).alias("end_date"), utc_timestamp(get("completeDate")).alias("complete_date"),
            F.coalesce(get("rapidViewId"), get("boardId")).alias("board_id"),
        ), F.struct("issue", "at")).alias("f"))
    owner = majority_owner(emb, "sid", "p").select("sid", "p")
    s = facts.join(owner, "sid").select(
        F.col("sid").cast("long").alias("raw_sprint_id"), F.col("sid").cast("long").alias("jira_sprint_id"), "f.*", _project(names))
    home = majority_owner(s.where(F.col("board_id").isNotNull()), "project", "board_id").select("project", "board_id")
    s = s.join(home, ["project", "board_id"], "left_semi")
    return s.withColumn("sprint_id", F.concat_ws("__", "project", F.col("raw_sprint_id").cast("string")))


def _project(names):
    out = F.col("p")
    for short, name in (names or {}).items():
        out = F.when(F.col("p") == short, F.lit(name)).otherwise(out)
    return out.alias("project")


def flatten_issues(pull: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """One row per issue; its present-day sprint is the last embedded one."""
    ids = F.filter(F.transform("spr", lambda r: F.trim(sprint_fields(r)["id"])), lambda x: x.rlike(r"^\d+$"))
    return pull.select(
        F.col("id").cast("long").alias("raw_issue_id"), F.col("k").alias("issue_key"), F.col("t").alias("issue_type"),
        F.col("s").alias("status"), F.col("sp").alias("story_point"), F.col("pr").alias("priority"),
        utc_timestamp(F.col("c")).alias("creation_date"), utc_timestamp(F.col("r")).alias("resolution_date"),
        F.try_element_at(ids, F.lit(-1)).cast("long").alias("raw_sprint_id"), F.col("a").alias("assignee"), _project(names),
        F.when(F.col("oe") > 0, F.col("oe") / 3600.0).alias("original_estimate_hours"))


def flatten_changes(pull: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """One row per change tuple (id, field, from, to, from text, to text, created)."""
    d = pull.select("id", "p", F.explode("ch").alias("c"))
    at = lambda i: F.get("c", F.lit(i))
    return d.select(
        at(0).cast("long").alias("change_id"), F.col("id").cast("long").alias("raw_issue_id"), at(1).alias("field"),
        at(2).alias("from_value"), at(3).alias("to_value"), at(4).alias("from_string"), at(5).alias("to_string"),
        F.when(F.lower(at(1)) == "sprint", "OTHER").otherwise("STORY_POINT").alias("change_type"),
        utc_timestamp(at(6)).alias("change_date"), _project(names))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines answers; the file path gives run and prompt (…/run1/G_c00_b1.jsonl)."""
    d = spark.read.schema(_ANSWER_SCHEMA).json(path).where(F.col("id").isNotNull())
    name = F.input_file_name()
    return d.select(
        F.regexp_extract(name, r"run(\d+)/", 1).try_cast("int").alias("run"), F.regexp_extract(name, r"([^/]+)\.jsonl$", 1).alias("prompt"),
        F.col("id").alias("board_id"), F.col("warn").cast("int").alias("warn"), F.col("p_late").alias("p"),
        F.col("unfinished").alias("unf"), F.coalesce("message", F.lit("")).alias("message"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MANIFEST_SCHEMA).option("multiLine", True).json(path)


def join_answers(answers: DataFrame, manifest: DataFrame) -> DataFrame:
    """Answers of the boards that the manifest asked for, with arm and checkpoint; unanswered boards have null."""
    asked = manifest.select("run", "prompt", "arm", "checkpoint", F.explode("boards").alias("board_id"))
    return asked.join(answers, ["run", "prompt", "board_id"], "left")


def completeness(answers: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per prompt: boards asked, answered once, missing, and answers nobody asked for."""
    asked = manifest.select("run", "prompt", F.explode("boards").alias("board_id"), F.lit(1).alias("asked"), F.lit(0).alias("got"))
    got = answers.select("run", "prompt", "board_id", F.lit(0).alias("asked"), F.lit(1).alias("got"))
    per = asked.unionByName(got).groupBy("run", "prompt", "board_id").agg(F.sum("asked").alias("asked"), F.sum("got").alias("got"))
    return per.groupBy("run", "prompt").agg(
        F.count_if(F.col("asked") > 0).alias("asked"), F.count_if((F.col("asked") > 0) & (F.col("got") == 1)).alias("answered"),
        F.count_if((F.col("asked") > 0) & (F.col("got") == 0)).alias("missing"),
        F.count_if((F.col("asked") == 0) & (F.col("got") > 0)).alias("unasked"),
    ).withColumn("complete", (F.col("answered") == F.col("asked")) & (F.col("unasked") == 0))


_TRANSCRIPT = T.StructType([T.StructField("message", T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("content", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("input", T.MapType(T.StringType(), T.StringType())),
    ]))),
]))])


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcript records with the file they came from."""
    d = spark.read.schema(_TRANSCRIPT).json(path)
    return d.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl$", 1).alias("transcript"), "message.model", "message.content")


def audit_answers(records: DataFrame, expected: DataFrame, answer_tool: str) -> DataFrame:
    """Per transcript: models, tool calls, whether it only read its own prompt, and whether all boards are answered.

    ``expected``: transcript, file_path, boards.
    """
    calls = records.select("transcript", F.explode("content").alias("c")).where(F.col("c.type") == "tool_use")
    other = calls.where(F.col("c.name") != answer_tool)
    reads = other.groupBy("transcript").agg(
        F.count(F.lit(1)).alias("tool_calls"), F.max("c.name").alias("tool"), F.max(F.col("c.input")["file_path"]).alias("read_path"))
    ids = calls.where(F.col("c.name") == answer_tool).select(
        "transcript", F.explode(F.split(F.col("c.input")["message"], "\n")).alias("line")).where(F.trim("line") != "")
    ids = ids.select("transcript", F.get_json_object("line", "$.id").alias("board_id"))
    asked = expected.select("transcript", F.explode("boards").alias("board_id"), F.lit(1).alias("asked"))
    per = ids.groupBy("transcript", "board_id").agg(F.count(F.lit(1)).alias("got")).join(asked, ["transcript", "board_id"], "full")
    done = per.groupBy("transcript").agg(F.min(((F.coalesce("asked", F.lit(0)) == 1) & (F.coalesce("got", F.lit(0)) == 1)).cast("int")).alias("all_"))
    models = records.groupBy("transcript").agg(F.array_sort(F.collect_set("model")).alias("models"))
    out = expected.join(reads, "transcript", "left").join(done, "transcript", "left").join(models, "transcript", "left")
    clean = (F.col("tool_calls") == 1) & (F.col("tool") == "Read") & (F.col("read_path") == F.col("file_path"))
    return out.select(
        "transcript", F.coalesce("tool_calls", F.lit(0)).alias("tool_calls"),
        F.coalesce(clean, F.lit(False)).alias("only_read_own_prompt"), (F.coalesce("all_", F.lit(0)) == 1).alias("answers_complete"),
        F.coalesce("models", F.array().cast("array<string>")).alias("models"))


def latest_attempts(audit: DataFrame, attempts: DataFrame, prompt: Sequence[str] = ("run", "prompt")) -> DataFrame:
    """Per prompt: attempts, the newest of them with its audit, and whether it is clean and complete.

    ``attempts``: transcript, the prompt's columns, and ``finished``, the time it ended.
    """
    parts = ["transcript", "models", "tool_calls", "only_read_own_prompt", "answers_complete"]
    per = attempts.join(audit, "transcript").groupBy(*prompt).agg(
        F.count(F.lit(1)).alias("attempts"), F.max_by(F.struct(*parts), F.struct("finished", "transcript")).alias("last_"))
    out = per.select(*prompt, "attempts", "last_.*")
    return out.withColumn("usable", F.col("only_read_own_prompt") & F.col("answers_complete"))
