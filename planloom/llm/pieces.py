"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

The distinct marked words of a block are sorted and walked as a trie, depth first: the forward states of the
prefix that a word shares with the one before it are kept, and only the new characters are computed.

The state of a prefix depends on the model's kind.
* unigram: the best score of the prefix and the last piece of its best segmentation (the classic lattice).
* bpe: the last piece of the merge result of the prefix. Merging never crosses the boundary between two pieces
  of a result, so a result is a path in which each adjacent pair of pieces is stable (merging the two texts
  together gives the same two pieces); each prefix has exactly one such path. A piece extends a prefix if it is
  stable behind that prefix's last piece, which replaces the comparison of scores. The ids equal those of the
  merge procedure, which sums of piece scores would not.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from planloom.llm.bitpack import chunks
from planloom.llm.common import arrow_map, kept, ragged, texts

SPACE = "▁"
NO_RANK = float("inf")


class Vocabulary:
    """Pieces, scores and byte pieces of a model."""

    def __init__(self, pieces: list[str], scores: list[float], special: set[int], byte_ids: dict[int, int], unknown: int):
        self.pieces, self.scores, self.special, self.byte_ids, self.unknown = pieces, scores, special, byte_ids, unknown
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special}
        self.longest = max(map(len, self.ids), default=1)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        byte = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        special = {i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        return cls(pieces, [sp.get_score(i) for i in range(n)], special, byte, sp.unk_id())

    def fallback(self, char: str) -> list[int]:
        """Ids of a character that no piece covers: its bytes, or the unknown piece."""
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]


class _Walk:
    """Depth-first walk over sorted words; subclasses give the forward step."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        ends: dict[str, set[int]] = {}
        for p in vocabulary.ids:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        self.ends = {k: tuple(sorted(x, reverse=True)) for k, x in ends.items()}

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; `words` must be sorted."""
        state = [self.root]
        before, out = "", []
        for word in words:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del state[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                state.append(self.step(word, i, state))
            before = word
            ids, at = [], len(word)
            while at:
                size, piece = state[at][0], state[at][1]
                if piece >= 0:
                    ids.append(piece)
                else:
                    ids += reversed(self.v.fallback(word[at - 1]))
                at -= size
            out.append(ids[::-1])
        return out


class UnigramWalk(_Walk):
    root = (0, -1, 0.0)

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary)
        known = [vocabulary.scores[i] for i in vocabulary.ids.values()]
        self.penalty = min(known, default=0.0) - 10.0

    def step(self, word: str, i: int, state: list) -> tuple[int, int, float]:
        best = None
        for size in range(min(i, self.v.longest), 0, -1):
            piece = self.v.ids.get(word[i - size : i])
            if piece is not None:
                score = state[i - size][2] + self.v.scores[piece]
                if best is None or score > best[2]:
                    best = (size, piece, score)
        if word[i - 1] not in self.v.ids:
            score = state[i - 1][2] + self.penalty
            if best is None or score > best[2]:
                best = (1, -1, score)
        return best


class BpeWalk(_Walk):
    root = (0, -1)

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary)
        self.rank = {p: -vocabulary.scores[i] for p, i in vocabulary.ids.items()}
        self.spines: dict[int, tuple | None] = {}
        self.memo: dict[int, bool] = {}

    def merged(self, text: str) -> tuple[list[str], list[tuple[float, int, int]]]:
        """Merge procedure on a short text: final symbols, and (rank, start, end) of each merge in order."""
        symbols, log = list(text), []
        while True:
            best, at = NO_RANK, -1
            for k in range(len(symbols) - 1):
                r = self.rank.get(symbols[k] + symbols[k + 1], NO_RANK)
                if r < best:
                    best, at = r, k
            if at < 0:
                return symbols, log
            start = sum(map(len, symbols[:at]))
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            log.append((best, start, start + len(symbols[at])))

    def spine(self, piece: int):
        """Symbols at the piece's right and left end as it grows, with the rank at which each is absorbed; None if merging its text does not give it."""
        if piece not in self.spines:
            text = self.v.pieces[piece]
            symbols, log = self.merged(text)
            found = None
            if len(symbols) == 1:
                right, left = [text[-1]], [text[0]]
                right_at, left_at = [], []
                for r, a, b in log:
                    if b == len(text):
                        right.append(text[a:b])
                        right_at.append(r)
                    if a == 0:
                        left.append(text[a:b])
                        left_at.append(r)
                found = (right, [*right_at, NO_RANK], left, [*left_at, NO_RANK])
            self.spines[piece] = found
        return self.spines[piece]

    def stable(self, u: int, t: int) -> bool:
        """Whether merging the joined text of pieces u and t gives u and t."""
        key = u << 32 | t
        if key not in self.memo:
            self.memo[key] = self._stable(u, t)
        return self.memo[key]

    def _stable(self, u: int, t: int) -> bool:
        left, right = self.spine(u), self.spine(t)
        if left is None or right is None:
            return False
        a, a_at, b, b_at = left[0], left[1], right[2], right[3]
        i = j = 0
        while True:
            across = self.rank.get(a[i] + b[j], NO_RANK)
            if across < a_at[i] and across <= b_at[j] and across < NO_RANK:
                return False
            if a_at[i] == NO_RANK and b_at[j] == NO_RANK:
                return True
            if a_at[i] <= b_at[j]:
                i += 1
            else:
                j += 1

    def encode(self, words: list[str]) -> list[list[int]]:
        """As in the base class, with the step inlined: last[i], size[i] are the states of the current prefix."""
        ends, ids_of, memo, stable, spine, fallback = self.ends.get, self.v.ids.get, self.memo.get, self.stable, self.spine, self.v.fallback
        last, size, before, out = [-1], [0], "", []
        for word in words:
            shared, n = 0, len(word)
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], size[shared + 1 :]
            for i in range(shared + 1, n + 1):
                for k in ends(word[i - 2 : i], ()) if i > 1 else ():
                    if k <= i:
                        piece = ids_of(word[i - k : i])
                        if piece is not None:
                            u = last[i - k]
                            ok = spine(piece) is not None if u < 0 else memo(u << 32 | piece)
                            if ok is None:
                                ok = stable(u, piece)
                            if ok:
                                last.append(piece)
                                size.append(k)
                                break
                else:
                    last.append(ids_of(word[i - 1], -1))
                    size.append(1)
            before, at, ids = word, n, []
            while at:
                piece = last[at]
                if piece >= 0:
                    ids.append(piece)
                else:
                    ids += reversed(fallback(word[at - 1]))
                at -= size[at]
            ids.reverse()
            out.append(ids)
        return out


class PieceEncoder:
    """Whole texts to ids and back, with a bounded cache of word ids."""

    #: Texts with these are cut by UNIT; all others at blanks and newlines.
    ODD = re.compile(rf"  |^ | $| \n|\0|{SPACE}")
    UNIT = re.compile(rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def __init__(self, vocabulary: Vocabulary, kind: str = "bpe", limit: int = 500_000):
        self.v, self.limit = vocabulary, limit
        self.walk = {"bpe": BpeWalk, "unigram": UnigramWalk}[kind](vocabulary)
        crossing = [p for p in vocabulary.ids if re.search(rf"[^{SPACE}]{SPACE}", p) or "\n" in p]
        self.by_unit = bool(crossing)  # such a model is walked text by text
        self.raw = [bytes([int(p[3:5], 16)]) if i in set(vocabulary.byte_ids.values()) else b"" if i in vocabulary.special else p.replace(SPACE, " ").encode() for i, p in enumerate(vocabulary.pieces)]
        self._clear()

    def _clear(self) -> None:
        self.at, self.flat, self.starts, self.sizes = {}, np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _cut(self, text: str) -> list[str]:
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        if self.by_unit:
            return [marked]
        if self.ODD.search(text):
            return ["\0" + u for u in self.UNIT.findall(marked)]
        return text.replace("\n", " \n \0").split(" ")

    def _word(self, key: str) -> str:
        """The text of a unit: units cut at blanks stand without their mark, \\0 begins one that has none to add."""
        return key if self.by_unit or key == "\n" else key[1:] if key[:1] == "\0" else SPACE + key

    def encode(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each row."""
        if len(self.at) > self.limit:
            self._clear()
        cut = [self._cut(t) for t in rows]
        new = set().union(*cut) - self.at.keys()
        if new:
            words = sorted((self._word(k), k) for k in new)
            ids = self.walk.encode([w for w, _ in words])
            sizes = np.fromiter(map(len, ids), np.int32, len(ids))
            ends = len(self.flat) + np.cumsum(sizes, dtype=np.int64)
            self.at.update(zip((k for _, k in words), range(len(self.starts), len(self.starts) + len(words))))
            self.starts, self.sizes = np.concatenate([self.starts, ends - sizes]), np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))])
        out, lengths = [np.zeros(0, np.int32)], []
        for c in cut:
            k = np.fromiter(map(self.at.__getitem__, c), np.int64, len(c))
            out.append(self.flat[ragged(self.starts[k], self.sizes[k])])
            lengths.append(len(out[-1]))
        return np.concatenate(out), np.array(lengths, np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: marks become blanks, the first blank goes, runs of byte pieces are read as UTF-8."""
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_ENCODERS: dict[str, PieceEncoder] = kept(__name__)


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(Vocabulary.load(path))
    return _ENCODERS[path]


def encode_decode(docs: DataFrame, model: str, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_crc32, round_trip[, ids]): ids of each whole text, decoded again and compared.

    ids_crc32 is the unsigned crc32 of the ids as little-endian unsigned 32-bit integers. Null and empty texts
    have no ids. A text that holds the mark character itself decodes with blanks in its place, so round_trip is
    false there. Repeated rows stay repeated; other columns are not read; an empty table gives an empty result.
    """

    def run(batches):
        enc = encoder(model)
        for b in batches:
            rows, docs_ids = texts(b, text_col), b.column(id_col)
            for lo, hi in chunks(rows):
                flat, n = enc.encode(rows[lo:hi])
                ends = np.cumsum(n)
                parts = [flat[e - k : e] for e, k in zip(ends, n)]
                cols = [docs_ids.slice(lo, hi - lo), pa.array(n), pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()), pa.array([enc.decode(p) == t for p, t in zip(parts, rows[lo:hi])])]
                names = [id_col, "n_tokens", "ids_crc32", "round_trip"]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat, pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"{id_col} long, n_tokens long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * keep_ids
    return arrow_map(docs.select(id_col, text_col), run, schema)
