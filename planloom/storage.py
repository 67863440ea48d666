"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Share of the most the driver's JVM may take for its heap, above which a grown heap is made smaller.
HEAP_SHARE = 0.6
_HEAP_LEFT: dict[str, int] = {}


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder, from spark.checkpoint.dir. Where none is named, a temporary one serves a local master; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="planloom-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder name below the shared root that nothing else uses."""
    return f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"


def give_back() -> None:
    """Memory that this Python process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def shrink(spark: SparkSession) -> bool:
    """Whether the driver's heap had grown so far that it was collected, which makes it smaller.

    It grows with the number of tasks that end in a second, whatever is held, and only a full collection gives memory back
    soon. Where most of it is held, a collection saves little: the next one waits until the heap has grown by a tenth of its most.
    """
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    most, app = runtime.maxMemory(), spark.sparkContext.applicationId
    if runtime.totalMemory() <= max(HEAP_SHARE * most, _HEAP_LEFT.get(app, 0) + most // 10):
        return False
    spark.sparkContext._jvm.System.gc()
    _HEAP_LEFT[app] = runtime.totalMemory()
    return True


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so a lost executor costs no recomputation."""
    shared_root(df.sparkSession)
    out = df.checkpoint(eager=True)
    shrink(df.sparkSession)
    return out


def sweep(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files that nothing refers to any more: it does so when the driver collects its garbage, else every 30 minutes."""
    for _ in range(2):  # some references go only between two collections
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
    give_back()


@contextlib.contextmanager
def freed_at_once(spark: SparkSession):
    """Frames made inside have their shuffle files deleted as soon as what runs on them ends; none of these frames should run twice."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, kind: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder."""
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    shrink(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.planloom_folder = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the tables of frames that `written` made, once nothing that is still to run reads them."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.planloom_folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
