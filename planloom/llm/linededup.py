"""Line dedup over levelled sorted runs of line hashes.

Lines are keyed by the XXH3-128 hash of the stripped, A-Z lower-cased line. The corpus arrives in batches. A
batch's keys, counted once per document, are merge-anti-joined with the full runs (keys already found in enough
documents) and what remains becomes a new sorted run at level 0. When a level holds `fan` runs they are merged
into one run of the next level; keys that reach `min_docs` in a merge leave for a full run. A last merge over
all levels completes the counts, so the result does not depend on how rows are batched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.llm.common import arrow_map, bodies
from planloom.storage import new_folder, written

KEY = ["hi", "lo"]


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)


def line_hashes(body: bytes) -> list[bytes]:
    """16-byte hash of each line's key, b'' for lines whose key is empty."""
    digest = xxhash.xxh3_128_digest
    return [digest(k) if (k := line_key(x)) else b"" for x in body.split(b"\n")]


class LineRuns:
    """Levels of sorted runs (hi, lo, n) in the shared folder, and full runs (hi, lo) of keys with n >= min_docs."""

    def __init__(self, spark: SparkSession, min_docs: int, fan: int = 2):
        self.spark, self.min_docs, self.fan = spark, min_docs, fan
        self.levels: list[list[DataFrame]] = [[]]
        self.full: list[DataFrame] = []

    def _sorted(self, df: DataFrame) -> DataFrame:
        path = new_folder(self.spark, "run")
        df.sortWithinPartitions(*KEY).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        both = runs[0]
        for r in runs[1:]:
            both = both.unionByName(r)
        return both.groupBy(*KEY).agg(F.sum("n").alias("n"))

    def add(self, batch: DataFrame) -> None:
        """batch: (hi, lo, n) with any number of rows a key."""
        fresh = batch.groupBy(*KEY).agg(F.sum("n").alias("n"))
        for run in self.full:
            fresh = fresh.join(run.hint("merge"), KEY, "left_anti")
        self.levels[0].append(self._sorted(fresh))
        level = 0
        while len(self.levels[level]) >= self.fan:
            merged = self._sorted(self._merge(self.levels[level]))
            self.levels[level] = []
            self.full.append(merged.where(F.col("n") >= self.min_docs).select(*KEY))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged.where(F.col("n") < self.min_docs))
            level += 1

    def frequent(self) -> DataFrame:
        """All keys found in at least min_docs documents."""
        out = self._merge([r for level in self.levels for r in level]).where(F.col("n") >= self.min_docs).select(*KEY)
        for run in self.full:
            out = out.unionByName(run)
        return out


def _hash_table(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(kh, kl, hi array, lo array): the distinct line hashes of each row; kh, kl identify the row's id and text."""

    def run(batches):
        for b in batches:
            rows, ids = bodies(b, text_col), b.column(id_col).to_pylist()
            keys, his, los = [], [], []
            for i, body in zip(ids, rows):
                keys.append(xxhash.xxh3_128_digest(f"{i}:".encode() + body))
                both = _halves(sorted(set(line_hashes(body)) - {b""}))
                his.append(both[:, 0])
                los.append(both[:, 1])
            k = _halves(keys)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(his, longs), pa.array(los, longs)], ["kh", "kl", "hi", "lo"])

    return arrow_map(docs.select(id_col, text_col), run, "kh long, kl long, hi array<long>, lo array<long>")


def frequent_line_keys(docs: DataFrame, min_docs: int, batches: int = 4, fan: int = 2, id_col: str = "doc_id", text_col: str = "text"):
    """(keys, hashes): line keys of at least `min_docs` rows, and the table of row hashes they came from."""
    hashes = written(_hash_table(docs, text_col, id_col), "lines")
    runs = LineRuns(docs.sparkSession, min_docs, fan)
    for i in range(batches):
        part = hashes.where(F.pmod("kl", F.lit(batches)) == i)
        runs.add(part.select(F.explode(F.arrays_zip("hi", "lo")).alias("k")).select("k.hi", "k.lo", F.lit(1).cast("long").alias("n")))
    return written(runs.frequent(), "frequent"), hashes


def _cleaned(body: bytes, drop: set[bytes]) -> tuple[bytes, int, int]:
    lines = body.split(b"\n")
    kept = [x for x, h in zip(lines, line_hashes(body)) if h not in drop]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def dedup_lines(docs: DataFrame, min_docs: int = 10, batches: int = 4, fan: int = 2, broadcast_keys: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with their frequent lines removed, plus n_lines and n_dropped.

    Null text counts as one empty line and comes back empty. Lines whose key is empty always stay. Each row is a
    document, also when ids repeat or are null. A column of `docs` named n_lines or n_dropped is replaced. An
    empty table gives an empty result. Up to `broadcast_keys` keys (16 bytes each) are sent to the workers;
    beyond that the keys are joined to the rows that hold them, with the same result.
    """
    docs = docs.drop("n_lines", "n_dropped")
    keys, hashes = frequent_line_keys(docs, min_docs, batches, fan, id_col, text_col)
    few = keys.limit(broadcast_keys + 1).count() <= broadcast_keys
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_lines long, n_dropped long"

    def emit(b, results):
        cols = [pa.array([r[0].decode() for r in results], pa.string()) if c == text_col else b.column(c) for c in names]
        return pa.RecordBatch.from_arrays([*cols, pa.array([r[1] for r in results], pa.int64()), pa.array([r[2] for r in results], pa.int64())], [*names, "n_lines", "n_dropped"])

    if few:
        found = keys.toArrow()
        sent = docs.sparkSession.sparkContext.broadcast(np.stack([found[k].to_numpy() for k in KEY], 1).astype(">i8").tobytes())

        def run(batches):
            raw = sent.value
            drop = {raw[i : i + 16] for i in range(0, len(raw), 16)}
            for b in batches:
                yield emit(b, [_cleaned(x, drop) for x in bodies(b, text_col)])

        return arrow_map(docs, run, schema)

    each = hashes.select("kh", "kl", F.explode(F.arrays_zip("hi", "lo")).alias("k")).select("kh", "kl", "k.hi", "k.lo")
    hits = each.join(keys, KEY, "left_semi").groupBy("kh", "kl").agg(F.collect_set(F.struct("hi", "lo")).alias("hits"))

    def tag(batches):
        for b in batches:
            k = _halves([xxhash.xxh3_128_digest(f"{i}:".encode() + x) for i, x in zip(b.column(id_col).to_pylist(), bodies(b, text_col))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k[:, 0]), pa.array(k[:, 1])], [*names, "kh", "kl"])

    tagged = arrow_map(docs, tag, schema.replace("n_lines long, n_dropped long", "kh long, kl long"))

    def apply(batches):
        for b in batches:
            out = []
            for body, hit in zip(bodies(b, text_col), b.column("hits").to_pylist()):
                drop = {np.array([x["hi"], x["lo"]], ">i8").tobytes() for x in hit or ()}
                out.append(_cleaned(body, drop))
            yield emit(b, out)

    return arrow_map(tagged.join(hits, ["kh", "kl"], "left").select(*names, "hits"), apply, schema)
