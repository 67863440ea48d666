"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed words and word openings. Its logit is w0 + sum w_i + sum over pairs of words <v_i, v_j>:
the pair part lets two words count together that say nothing alone, such as an insult with the mention of a group.
Every hash found often enough to be fitted has a weight, and every such word a factor; no term is chosen by its own
association with the label. What carries no signal is driven to zero by the objective itself: an L1 penalty on weights
and a group penalty on whole factors, applied to all of them at every step. The machine is fitted on a bounded,
hash-ordered sample of labelled rows; scoring reads every text whole.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import arrow_map, bodies, give_back, kept, ragged, remainder, words_of

EDGES = b".,;:!?\"'()[]{}*#$%&|<>-_~`"


PREFIXES = (4, 5, 6)
_HASHES: dict[bytes, tuple[int, ...]] = kept(__name__)


def _hashes(word: bytes) -> tuple[int, ...]:
    """Unmasked hashes of a word (even) and of its opening letters (odd), which inflected insults share."""
    found = _HASHES.get(word)
    if found is None:
        if len(_HASHES) > 200_000:
            _HASHES.clear()
        bare = word.strip(EDGES)
        found = _HASHES[word] = (zlib.crc32(bare) & ~1, *(zlib.crc32(b"^" + bare[:k]) | 1 for k in PREFIXES if len(bare) > k))
    return found


def terms(body: bytes, bits: int) -> np.ndarray:
    """Sorted distinct hashes of the words, stripped of ASCII punctuation, and of their prefixes."""
    found = [h for w in set(words_of(body)) for h in _hashes(w)]
    return np.unique(np.array(found, np.int64) & ((1 << bits) - 1))


@dataclass
class Machine:
    bits: int
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logit(self, x: np.ndarray) -> float:
        v = self.factors[x]
        s = v.sum(0)
        return self.bias + float(self.weights[x].sum()) + 0.5 * float(s @ s - (v * v).sum())

    def score(self, body: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(terms(body, self.bits)), -35, 35))))


def _packed(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All rows end to end, and where each begins."""
    return np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int32, copy=False), np.cumsum([0, *map(len, rows)])


def _batch(flat: np.ndarray, starts: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries, owner) of the picked rows."""
    sizes = starts[pick + 1] - starts[pick]
    return flat[ragged(starts[pick], sizes)], np.repeat(np.arange(len(pick)), sizes)


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = 20, factors: int = 4, epochs: int = 12, batch: int = 64, rate: float = 0.2, least_docs: int = 6, l1: float = 1.5e-3, group: float = 3e-2, boost: float = 4.0, start: float = 0.1, seed: int = 7) -> Machine:
    """Adagrad on the log loss with proximal steps on all parameters; hashes in fewer than `least_docs` rows keep weight zero.

    Rows labelled 1 count `boost` times. `l1` is the penalty of each weight and `group` that of each factor's length,
    the latter from the second pass on, so that factors that need each other can grow first.
    """
    rng = np.random.default_rng(seed)
    dims = 1 << bits
    flat, starts = _packed(rows)
    known = np.flatnonzero(np.bincount(flat, minlength=dims) >= least_docs)
    place = np.full(dims, -1, np.int32)
    place[known] = np.arange(len(known))
    words = known[known % 2 == 0]
    place_of_word = np.full(dims, -1, np.int32)
    place_of_word[words] = np.arange(len(words))
    every = _packed([r[r >= 0] for r in (place[r] for r in rows)])
    pairs = _packed([r[r >= 0] for r in (place_of_word[r] for r in rows)])
    share = min(max(labels.mean() if len(labels) else 0.5, 1e-3), 1 - 1e-3)
    bias, w, v = float(np.log(share / (1 - share))), np.zeros(len(known)), rng.normal(0, start, (len(words), factors))
    gw, gv, gb = np.full(len(known), 1e-4), np.full(len(words), 1e-4), 1e-4
    for epoch in range(epochs if len(known) else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            m = len(pick)
            x, doc = _batch(*every, pick)
            y, who = _batch(*pairs, pick)
            vy = v[y]
            s = np.stack([np.bincount(who, vy[:, f], m) for f in range(factors)], 1)
            logit = bias + np.bincount(doc, w[x], m) + 0.5 * ((s * s).sum(1) - np.bincount(who, (vy * vy).sum(1), m))
            err = (1 / (1 + np.exp(-np.clip(logit, -35, 35))) - labels[pick]) * np.where(labels[pick] > 0, boost, 1.0) / m
            dw = np.bincount(x, err[doc], len(w))
            pull = err[who][:, None] * (s[who] - vy)
            dv = np.stack([np.bincount(y, pull[:, f], len(v)) for f in range(factors)], 1)
            gw += dw * dw
            gv += (dv * dv).sum(1)
            gb += err.sum() ** 2
            step = rate / np.sqrt(gw)
            w -= step * dw
            w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
            step = 0.5 * rate / np.sqrt(gv)
            v -= step[:, None] * dv
            if epoch:
                v *= np.maximum(1 - step * group / np.maximum(np.sqrt((v * v).sum(1)), 1e-12), 0)[:, None]
            bias -= rate * err.sum() / np.sqrt(gb)
    weights, spread = np.zeros(dims, np.float32), np.zeros((dims, factors), np.float32)
    weights[known], spread[words] = w, v
    return Machine(bits, bias, weights, spread)


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = 4000, id_col: str = "doc_id", text_col: str = "text", bits: int = 20):
    """Hashed rows and labels of at most `per_class` labelled documents a class, in the order of a hash of the id."""
    ranked = labels.where("toxic in (0, 1)").where(remainder(id_col, 5) != 0).select(id_col, "toxic")
    picked = None
    for label in (0, 1):
        some = ranked.where(F.col("toxic") == label).orderBy(F.xxhash64(id_col), id_col).limit(per_class)
        picked = some if picked is None else picked.unionByName(some)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([terms(x, bits) for x in bodies(b, text_col)], pa.list_(pa.int32())), b.column(id_col)], ["toxic", "x", id_col])

    found = docs.select(id_col, text_col).join(F.broadcast(picked), id_col)  # at most two times per_class rows
    got = arrow_map(found, run, f"toxic int, x array<int>, {id_col} long").toArrow()
    xs = [x.values.to_numpy() for x in got["x"]]
    order = sorted(range(len(xs)), key=lambda k: (got[id_col][k].as_py(), len(xs[k]), xs[k].tobytes()))
    return [xs[k] for k in order], got["toxic"].to_numpy()[order].astype(float)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000, **how) -> Machine:
    """The machine fitted on training_rows. Labels other than 0 and 1 (null too) are no training rows; a label without a
    document is ignored, a repeated id counts as often as it occurs, null and empty texts are rows without terms. Without
    any labelled row all texts score 0.5. Further columns of both tables are not read."""
    made = fit(*training_rows(docs, labels, per_class), **how)
    give_back()  # the training rows
    return made


def toxicity_scores(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, *keep): null and empty texts get the machine's bias as logit; each row is scored by itself.

    A kept column named score gives way to the score. An empty table gives an empty result.
    """
    keep = tuple(k for k in keep if k not in (id_col, "score"))
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # 2^bits rows of weights, whatever the corpus
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] if keep else []

    def run(batches):
        m = sent.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array([m.score(x) for x in bodies(b, text_col)], pa.float64()), *[b.column(k) for k in keep]], [id_col, "score", *keep])

    return arrow_map(docs.select(*dict.fromkeys([id_col, text_col, *keep])), run, ", ".join([f"{id_col} long, score double", *fields]))
