"""Helpers shared by the text operators: tables in the shared folder, files, and code for the workers."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tidemark
from tidemark.session import materialize, shared_dir

SPACE = " \t\n\x0b\x0c\r"  # what separates words and is stripped from lines
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST_ID = (1 << 63) - 1  # stands for a null id: after every other

_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

_shipped: set[str] = set()

__all__ = ["SPACE", "UPPER", "LOWER", "LAST_ID", "known_id", "Ids", "free_names", "ascii_lower", "same", "ship", "new_folder", "filesystem", "fixed", "by_bytes", "forget", "hash_sample", "release", "materialize", "shared_dir", "table"]


def known_id(col: str) -> Column:
    """The id as a long; null becomes the largest, so that rows without one come last. See ``Ids`` for tables that hold that id."""
    return F.coalesce(F.col(col).cast("long"), F.lit(LAST_ID))


class Ids:
    """Ids as longs in which null is the largest and no other row's: a table that holds LAST_ID has all its ids moved down by one.

    A table that holds both ends of the 64 bits cannot be moved, and raises.
    """

    def __init__(self, df: DataFrame, col: str):
        ends = df.agg(F.min(F.col(col).cast("long")).alias("lo"), F.max(F.col(col).cast("long")).alias("hi")).first()
        self.shift = int(ends.hi == LAST_ID)
        if self.shift and ends.lo == -LAST_ID - 1:
            raise ValueError(f"{col} holds both the smallest and the largest 64-bit number")

    def inner(self, col: str) -> Column:
        """The id as used inside, never null."""
        return F.coalesce(F.col(col).cast("long") - self.shift, F.lit(LAST_ID))

    def outer(self, col: str) -> Column:
        """The id of the table again."""
        return F.when(F.col(col) != LAST_ID, F.col(col) + self.shift)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Working names like the given ones that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        k = n
        while k.lower() in taken:
            k += "_"
        taken.add(k.lower())
        out.append(k)
    return out


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def same(a: DataFrame, b: DataFrame, cols: list[tuple[str, str]]) -> Column:
    """Join condition in which null equals null."""
    return reduce(lambda x, y: x & y, [a[l].eqNullSafe(b[r]) for l, r in cols])


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not share the driver's path, and bound the batches they get.

    Texts are long, and a batch of 10,000 of them would be most of a worker's memory, on both sides of its socket. So the
    bytes of a batch are bounded unless the session says otherwise.
    """
    sc = spark.sparkContext
    if spark.conf.get(_BATCH, None) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, "8m")
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(tidemark.__file__))
    made = tempfile.mkdtemp(prefix="tidemark-code-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    with zipfile.ZipFile(f"{made}/tidemark_code.zip", "w") as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), os.path.dirname(root)))
    sc.addPyFile(f"{made}/tidemark_code.zip")
    _shipped.add(sc.applicationId)


def hash_sample(df: DataFrame, cols: list[str], rows: int) -> list:
    """At most ``rows`` rows, those of smallest hash, one per hash, collected: the same ones however the table is cut.

    The hashes are picked first, so that a task sends the driver ``rows`` numbers and not as many texts.
    """
    hashed = df.select(*cols).withColumn("__h", F.xxhash64(*cols))
    low = hashed.select("__h").distinct().orderBy("__h").limit(rows).agg(F.max("__h")).first()[0]
    if low is None:
        return []
    return hashed.where(F.col("__h") <= low).dropDuplicates(["__h"]).orderBy("__h").drop("__h").collect()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared store as a full address; it goes when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidemark-{kind}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return fs.makeQualified(path).toString()


def filesystem(uri: str):
    """(file system, path) of an address such as file:/, hdfs:// or s3://."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


fixed = materialize


def by_bytes(batches: Iterator, *cols: str, most: int = 4 << 20) -> Iterator:
    """Arrow batches cut so that the named columns take some ``most`` bytes together, whatever the number of rows; a longer row comes alone."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        size = np.zeros(b.num_rows, np.int64)
        for c in cols:
            size += pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size + 16) // most
        cuts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], b.num_rows]):
            yield b.slice(lo, hi - lo)
    if not isinstance(batches, list):
        trim()


def trim() -> None:
    """Give what a task has freed back to the system: workers are used again, and several of an executor wait beside each other."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def release(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of finished plans now, so that steps that follow one another do not add up on disk.

    Spark's cleaner removes them once the plans that made them are garbage; nothing that is still used goes.
    """
    for _ in range(2):  # what the first round frees may hold the last reference to more
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``fixed`` that no later step reads."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/tidemark-" in path:
                where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
