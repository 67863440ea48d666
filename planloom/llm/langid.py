"""Language identification by error-correcting output codes.

Each language has a codeword. One logistic n-gram classifier is fitted for each bit of the codewords; a text's
language is the codeword with the least total loss over the bit margins, each bit weighted by how reliable it
was in training. A text whose two best codewords lie close together is flagged as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planloom.llm.common import arrow_map, remainder

DIMS = 4096
UNKNOWN = "und"


def codewords(k: int, seed: int = 11) -> np.ndarray:
    """k distinct rows of -1 and 1: all dichotomies for few languages, else random codes with the best least distance."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        bits = [[1 if i == 0 or not (b >> (i - 1)) & 1 else -1 for i in range(k)] for b in range(1, 1 << (k - 1))]
        return np.array(bits, float).T
    rng, length, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k))), None
    for _ in range(200):
        c = rng.choice([-1.0, 1.0], (k, length))
        usable = np.abs(c.sum(0)) < k
        apart = (length - (c @ c.T)[~np.eye(k, dtype=bool)].max()) / 2
        if usable.all() and (best is None or apart > best[0]):
            best = (apart, c)
    return best[1]


def counts(body: bytes) -> np.ndarray:
    """Counts of hashed byte bigrams and trigrams of the A-Z lower-cased text."""
    b = np.frombuffer(body.lower(), np.uint8).astype(np.uint32)
    two = b[:-1] | b[1:] << 8
    three = two[:-1] | b[2:] << 16
    hashed = np.concatenate([two + np.uint32(1 << 24), three]) * np.uint32(2654435761) >> 20
    return np.bincount(hashed, minlength=DIMS)


def features(c: np.ndarray) -> np.ndarray:
    """Square roots of counts, scaled to length one, and a constant."""
    x = np.sqrt(c)
    return np.append(x / max(np.linalg.norm(x), 1e-9), 1.0)


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    near: float

    def losses(self, x: np.ndarray) -> np.ndarray:
        margins = x @ self.weights
        return np.logaddexp(0, -self.code * margins) @ self.trust

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, ambiguous). Null text or no letter, or no learned language: und, 0."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        loss = self.losses(features(counts(text.encode("utf-8", "surrogatepass"))))
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        close = len(p) > 1 and p[order[0]] - p[order[1]] < self.near
        return self.langs[order[0]], float(p[order[0]]), bool(close)


def fit(rows: np.ndarray, langs: list[str], near: float = 0.2, steps: int = 250, l2: float = 1e-4) -> Model:
    """Full-batch logistic regression with momentum for all bits at once; rows of all languages weigh the same."""
    names = sorted(set(langs))
    code = codewords(len(names))
    if not names:
        return Model([], code, np.zeros((DIMS + 1, 1)), np.ones(1), near)
    x = np.stack([features(r) for r in rows]).astype(np.float32)
    which = np.array([names.index(v) for v in langs])
    y = code[which]
    weight = (1.0 / np.bincount(which))[which][:, None] / len(names)
    w, move = np.zeros((DIMS + 1, code.shape[1]), np.float32), 0.0
    for _ in range(steps):
        slope = -y / (1 + np.exp(np.clip(y * (x @ w), -30, 30))) * weight
        move = 0.9 * move - 20.0 * (x.T @ slope.astype(np.float32) + l2 * w)
        w = w + move
    right = ((x @ w) * y > 0).mean(0)
    trust = np.maximum(right - 0.5, 0.01)
    return Model(names, code, w.astype(float), trust * len(trust) / trust.sum(), near)


def train(docs: DataFrame, most_rows: int = 4000, per_language: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on documents with crc32(id) mod 4 not 2 and a language: per_language of each, in the order of a hash of the id.

    The total is at most most_rows, shared evenly when there are many languages. A language's rows are thinned by a
    threshold on that hash before they are ranked, so that no language gathers in one task. Rows without language
    take no part; null texts count as empty; a repeated id is picked as a whole; an empty table gives a model that
    answers `und`. Further columns are not read.
    """
    place = F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1 << 40)) / float(1 << 40)
    known = docs.where(F.col(lang_col).isNotNull() & (remainder(id_col, 4) != 2)).select(id_col, F.col(lang_col).alias("_lang"), place.alias("_place"))
    sizes = known.groupBy("_lang").agg(F.count("*").alias("_n")).orderBy("_lang").limit(most_rows)  # one row a language
    kinds = sizes.count()
    each = max(1, min(per_language, most_rows // max(kinds, 1)))
    # A place below this threshold is expected of twice as many rows as needed; only those are ranked.
    near = known.join(F.broadcast(sizes), "_lang").where(F.col("_place") * F.col("_n") < 2 * each + 50)
    order = Window.partitionBy("_lang").orderBy("_place", id_col)
    picked = near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= each).select(id_col).distinct()

    def run(batches):
        for b in batches:
            rows = [counts((t or "").encode()) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(id_col), b.column(lang_col), pa.array([np.minimum(r, 65535).astype("<u2").tobytes() for r in rows], pa.binary())], [id_col, "lang", "x"])

    found = docs.where(F.col(lang_col).isNotNull()).select(id_col, text_col, lang_col).join(F.broadcast(picked), id_col)  # at most most_rows ids
    got = arrow_map(found, run, f"{id_col} long, lang string, x binary").toArrow().to_pandas().sort_values([id_col, "lang", "x"], kind="stable")
    return fit(np.array([np.frombuffer(x, "<u2") for x in got["x"]]), got["lang"].tolist())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, ambiguous) of each row, from its text alone; an empty table gives an empty result."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMS rows of weights, whatever the corpus

    def run(batches):
        m = sent.value
        for b in batches:
            out = [m.predict(t) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())], [id_col, "lang_pred", "score", "ambiguous"])

    return arrow_map(docs.select(id_col, text_col), run, f"{id_col} long, lang_pred string, score double, ambiguous boolean")
