"""What the operators share: scratch tables in the cluster's shared folder, and small column helpers."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as the contracts for whole texts define them.
SPACED_WORD = r"[^\x20\x09-\x0D]+"

#: The list that takes the scratch paths made in this thread, where one does.
_taken: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset: one of our own on a single machine, else one in the warehouse."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            own = tempfile.mkdtemp(prefix="pagemill-scratch-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            path = f"file://{own}"
        else:  # a folder of one machine would be lost on the others
            path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_pagemill"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/pagemill-{name}-{uuid.uuid4().hex}"
    if (taken := _taken.get()) is not None:
        taken.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, and lost executors recompute nothing before it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def per_process(key: tuple, make: Callable):
    """What make() gave first in this process: Python workers serve many tasks, and functions shipped by value share no globals."""
    kept = sys.modules.setdefault("_pagemill_kept", types.ModuleType("_pagemill_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def trim() -> None:
    """At the end of a task: give memory that Arrow and the C library hold back to the system, for the worker lives on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def tracked(paths: list[str]) -> Iterator[None]:
    """Adds to paths the scratch paths that are made inside."""
    token = _taken.set(paths)
    try:
        yield
    finally:
        _taken.reset(token)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete these scratch paths and forget them; no result may still need them."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256_of(text: Column) -> Column:
    """Lower-case hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)
