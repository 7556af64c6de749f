"""Shared scratch folder and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dirs: dict[str, str] = {}
_lock = threading.Lock()
_writers: dict[str, list] = {}  # per application: writes under way, and the setting before the first


def scratch_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder.
    """
    app = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/tabulon-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    with _lock:
        if app not in _local_dirs:
            _local_dirs[app] = tempfile.mkdtemp(prefix="tabulon-")
            atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
        return _local_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Queries begun meanwhile delete their shuffle files when they end, not when the driver happens to collect garbage."""
    app = spark.sparkContext.applicationId
    with _lock:
        state = _writers.setdefault(app, [0, None])
        if not state[0]:
            state[1] = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        state[0] += 1
    try:
        yield
    finally:
        with _lock:
            state[0] -= 1
            if not state[0]:
                spark.conf.unset(_CLEANUP) if state[1] is None else spark.conf.set(_CLEANUP, state[1])


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, computes the plan a
    single time, and leaves a columnar table that later steps can prune.  The
    shuffle files of the write go when it ends.
    """
    path = scratch_path(df.sparkSession, name)
    with _shuffles_end(df.sparkSession):
        df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.scratch = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "scratch", None)
        if path is not None:
            spark = df.sparkSession
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end: Spark marks that by a file of its own."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def side_by_side(tasks: Sequence[Callable[[], T]], workers: int = 4) -> list[T]:
    """Run independent chains of Spark jobs at the same time, results in order.

    One model fit leaves much of a cluster idle between its passes; the
    scheduler fills the gaps with the jobs of the other chains.
    """
    if len(tasks) < 2 or workers < 2:
        return [t() for t in tasks]
    with ThreadPoolExecutor(min(workers, len(tasks))) as pool:
        return [f.result() for f in [pool.submit(t) for t in tasks]]
