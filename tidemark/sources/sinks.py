"""Result sinks, the run log, input fingerprints and split manifests."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ship

BLOCK = 4 << 20  # bytes read at a time


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Float columns rounded; NaN becomes null."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.round(F.nanvl(F.col(c), F.lit(None).cast("double")), digits) for c in cols})


def write_rows(df: DataFrame, path: str, fmt: str = "csv", digits: int | None = 4, order: Sequence[str] = ()) -> None:
    """Write as CSV with header, JSON lines or Parquet, overwriting; sorted over all files when asked."""
    out = df if digits is None else rounded(df, digits)
    out = out.orderBy(*order) if order else out
    w = out.write.mode("overwrite")
    (w.option("header", True) if fmt == "csv" else w).format(fmt).save(path)


def append_run_log(metrics: DataFrame, path: str, run_date: str, dataset: str, notes: str = "", run_id: str | None = None) -> None:
    """Append one row per label, scheme and model; folds of a scheme are logged as their mean.

    A batch is a partition of its own (``run_date``, ``run_id``) that a repeated append replaces, so that a retry leaves one
    copy. ``run_id`` defaults to a digest of date, dataset and notes.
    """
    run_id = run_id or hashlib.md5(f"{run_date}|{dataset}|{notes}".encode()).hexdigest()[:12]
    names = ["precision", "recall", "f1", "roc_auc", "pr_auc"]
    rows = metrics.groupBy("label", "validation_scheme", "model").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("folds"), *[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in names])
    stamped = rounded(rows).withColumns({"dataset": F.lit(dataset), "notes": F.lit(notes), "run_date": F.lit(run_date), "run_id": F.lit(run_id)})
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date", "run_id").parquet(path)


def read_rows(spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "csv") -> DataFrame:
    """What :func:`write_rows` wrote, with the types of ``schema``; empty cells of a CSV are null."""
    r = spark.read.schema(schema)
    return (r.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]") if fmt == "csv" else r).format(fmt).load(path)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of a file, of all files below a folder, or of what a pattern names; empty files too, but no names that start with a dot or underscore."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for hit in fs.globStatus(top) or []:
        found = fs.listFiles(hit.getPath(), True)
        while found.hasNext():
            f = found.next()
            if not f.getPath().getName().startswith((".", "_")):
                rows.append((re.sub("^file:/+", "/", f.getPath().toString()), f.getLen()))
    return spark.createDataFrame(rows, "file string, bytes long")


def _open(name: str):
    fs, at = (pafs.LocalFileSystem(), name) if name.startswith("/") else pafs.FileSystem.from_uri(name)
    return fs.open_input_file(at)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Per file: SHA-256, bytes and lines. Files are dealt over tasks and read as streams; see ``block_fingerprints`` for very large ones."""
    ship(spark)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                sha, size, lines, last = hashlib.sha256(), 0, 0, b"\n"
                with _open(name) as f:
                    while part := f.read(BLOCK):
                        sha.update(part)
                        size, lines, last = size + len(part), lines + part.count(b"\n"), part[-1:]
                yield pa.RecordBatch.from_pydict({"file": [name], "sha256": [sha.hexdigest()], "bytes": [size], "lines": [lines + (last != b"\n")]})

    names = listed(spark, path).select("file")
    return names.repartition(max(names.count(), 1), "file").mapInArrow(digest, "file string, sha256 string, bytes long, lines long")


def block_fingerprints(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Per file: ``root``, bytes and lines, with blocks of ``block`` bytes digested by as many tasks as there are.

    The root is the SHA-256 of the hex SHA-256 digests of the blocks, one after the other: it depends on content and block
    size alone. An empty file has no blocks and zero lines.
    """
    ship(spark)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, k in zip(*[b.column(c).to_pylist() for c in ("file", "k")]):
                with _open(name) as f:
                    f.seek(k * block)
                    part = f.read(block)
                yield pa.RecordBatch.from_pydict({"file": [name], "k": [k], "sha": [hashlib.sha256(part).hexdigest()], "breaks": [part.count(b"\n")], "closed": [part[-1:] == b"\n"]})

    files = listed(spark, path)
    last = F.ceil(F.col("bytes") / block).cast("long") - 1
    blocks = files.where("bytes > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    done = blocks.repartition("file", "k").mapInArrow(digest, "file string, k long, sha string, breaks long, closed boolean")
    per = done.groupBy("file").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "sha"))), lambda x: x["sha"]), "").alias("shas"),
        (F.sum("breaks") + F.when(F.max_by("closed", "k"), 0).otherwise(1)).alias("lines"))
    return files.join(per, "file", "left").select("file", F.sha2(F.coalesce("shas", F.lit("")), 256).alias("root"), "bytes", F.coalesce("lines", F.lit(0).cast("long")).alias("lines"))


def write_split_manifest(split: DataFrame, path: str, key: str = "sprint_id") -> None:
    """Sorted (side, id) rows, so that two manifests can be compared line by line."""
    split.select("side", key).orderBy("side", key).write.mode("overwrite").option("header", True).csv(path)
