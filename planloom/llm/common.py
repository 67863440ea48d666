"""Small helpers shared by the text operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.storage import give_back

_SHIPPED: dict[str, bool] = {}
_KEPT: dict[str, dict] = {}
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so that workers need no shared code folder."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    # Whole documents can be long: fewer rows at once bound what a Python worker holds.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="planloom-ship-"), "planloom_shipped.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "planloom")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED[app] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def bodies(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null becomes empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A text column as strings; null becomes empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def kept(owner: str) -> dict:
    """What a worker process keeps for the module `owner` from task to task, until a task of another module begins."""
    return _KEPT.setdefault(owner, {})


def drop_kept(owner: str) -> None:
    """Empty what is kept for all modules but `owner`."""
    for name, held in _KEPT.items():
        if name != owner:
            held.clear()


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)

    owner = fn.__module__

    def run(batches):
        drop_kept(owner)
        yield from fn(batches)
        give_back()  # a worker process outlives its tasks, and idle ones count beside those that work

    return df.mapInArrow(run, schema)


def words_of(body: bytes) -> list[bytes]:
    """Words after lower-casing A-Z; bytes.split parts at the six ASCII white-space characters."""
    return body.lower().split()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... for each run, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    at = np.cumsum(n)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)
