"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words everywhere in this package.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"

#: Frees the shuffle files of a query at its end, which Spark else does when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: str | None = None
#: Of every ``settled`` that is under way, what was written within it.
_under_way = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a single-JVM ``local`` session without that setting gets a temporary folder;
    elsewhere a missing setting is an error, as a machine's own folder would lose data.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        import atexit

        _own_dir = tempfile.mkdtemp(prefix="foliospark-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return _own_dir


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and returns the written table.

    Cuts the lineage: a lost executor costs a re-read and not a recomputation, and values
    that a plan gives differently each time (row numbers, partition ids) become fixed. What was
    shuffled on the way is deleted.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["written_to"] = path
    for tables in getattr(_under_way, "tables", [])[-1:]:
        tables.append(out)
    return out


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """The written table of ``make()``, without the tables that were written to get it."""
    scopes = _under_way.__dict__.setdefault("tables", [])
    scopes.append([])
    try:
        out = materialise(make(), label)
    finally:
        tables = scopes.pop()
    discard(*(t for t in tables if t is not out))
    for outer in scopes[-1:]:
        outer.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what ``materialise`` wrote for these tables, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.__dict__["written_to"])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def partition_bits(rows: int, per_bucket: int = 1 << 16) -> int:
    """Bits so that 2**bits equal buckets of ``rows`` rows hold ``per_bucket`` each at most."""
    return max(0, (max(rows, 1) - 1) // per_bucket).bit_length()


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
