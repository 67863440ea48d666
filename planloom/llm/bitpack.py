"""Token-id output in fixed-width bit-packed files.

Layout of a file: 16-byte header (magic, bits an id, ids a block), the packed blocks, then a footer: document
ids with a null flag, id offset of each document, byte offset of each block, and four counts and lengths in the
last 40 bytes. Every id takes the minimum number of bits of the vocabulary, least significant bit first; a block
starts at a byte, so that block k of a file can be read and unpacked alone.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planloom.llm.common import arrow_map, kept, ragged, texts
from planloom.storage import new_folder, written

MAGIC = b"PLBITS01"
HEAD, TAIL = struct.Struct("<8sII"), struct.Struct("<QQQQ8s")


def width(vocabulary: int) -> int:
    """Least bits that hold ids below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(wide[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Streams ids into one file; only the footer tables are held in memory."""

    def __init__(self, sink, bits: int, block: int):
        self.sink, self.bits, self.block = sink, bits, block
        self.rest, self.n, self.docs, self.starts, self.offsets, self.at = np.zeros(0, np.uint32), 0, [], [0], [HEAD.size], HEAD.size
        sink.write(HEAD.pack(MAGIC, bits, block))

    def _put(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self.sink.write(raw)
        self.at += len(raw)
        self.offsets.append(self.at)

    def add(self, doc_ids: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.docs += doc_ids
        self.starts += (self.n + np.cumsum(lengths)).tolist()
        self.n += len(ids)
        rest = np.concatenate([self.rest, ids.astype(np.uint32)])
        whole = len(rest) // self.block * self.block
        for a in range(0, whole, self.block):
            self._put(rest[a : a + self.block])
        self.rest = rest[whole:]

    def close(self) -> None:
        if len(self.rest):
            self._put(self.rest)
        null = np.array([d is None for d in self.docs], np.uint8)
        self.sink.write(np.array([d or 0 for d in self.docs], "<i8").tobytes() + null.tobytes())
        self.sink.write(np.array(self.starts, "<i8").tobytes() + np.array(self.offsets, "<i8").tobytes())
        self.sink.write(TAIL.pack(len(self.docs), self.n, len(self.offsets) - 1, self.at, MAGIC))
        self.sink.close()


class Reader:
    """Random access to one file: document ids, id offsets, any range of ids."""

    def __init__(self, source):
        self.source, end = source, source.size()
        n_docs, self.n, n_blocks, footer, magic = TAIL.unpack(source.read_at(TAIL.size, end - TAIL.size))
        head, self.bits, self.block = HEAD.unpack(source.read_at(HEAD.size, 0))
        if magic != MAGIC or head != MAGIC:
            raise ValueError("not a packed token file")
        raw = source.read_at(end - TAIL.size - footer, footer)
        ids, null = np.frombuffer(raw, "<i8", n_docs), np.frombuffer(raw, np.uint8, n_docs, 8 * n_docs)
        self.docs = [None if z else int(d) for d, z in zip(ids, null)]
        self.starts = np.frombuffer(raw, "<i8", n_docs + 1, 9 * n_docs)
        self.offsets = np.frombuffer(raw, "<i8", n_blocks + 1, 9 * n_docs + 8 * (n_docs + 1))

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block + 1
        raw = self.source.read_at(int(self.offsets[last] - self.offsets[first]), int(self.offsets[first]))
        out, at = [], 0
        for k in range(first, last):
            size = int(self.offsets[k + 1] - self.offsets[k])
            out.append(unpack(raw[at : at + size], self.bits, min(self.block, self.n - k * self.block)))
            at += size
        return np.concatenate(out)[start - first * self.block : stop - first * self.block]


class CachedEncoder:
    """The tokenizers library over distinct word units, with a bounded cache of their ids.

    A byte-level BPE pre-tokenizer starts a new pre-token at each blank that a non-blank follows and around a lone
    newline, so a text can be cut there and equal units encoded once. Texts with other white space at those
    places, or with a special token's string, go to the library whole.

    The pre-tokenizer also parts letters from the ASCII punctuation behind them, the apostrophe aside. New units of that
    form go to the library's BPE model in these two parts, each distinct one once; all others go through the whole library.
    """

    MARK, BREAK = "\0", re.compile(r" (?:\s|$)|\n\n|\0")
    LATIN, BEHIND = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+"), "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
    #: The characters by which a byte-level model knows the bytes of such words, where they are not those of Latin-1.
    BYTES = {**{0x80 + i: 290 + i for i in range(33)}, 0xAD: 323}

    def __init__(self, path: str, limit: int = 700_000):
        from tokenizers import Tokenizer

        self.tok, self.limit = Tokenizer.from_file(path), limit
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.model = self.tok.model if self._byte_level() else None
        self.newline = self._ids(["\n"])[0]
        self.at: dict[str, int] = {}
        self.flat, self.starts, self.sizes, self.hits = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _byte_level(self) -> bool:
        """Whether the library does nothing but the usual byte-level BPE."""
        how = json.loads(self.tok.to_str())
        pre, model = how["pre_tokenizer"] or {}, how["model"]
        usual = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix")
        return usual and model.get("type") == "BPE" and not any(model.get(x) for x in odd) and not any(how[x] for x in ("normalizer", "truncation", "padding"))

    def _forget(self) -> None:
        """Drop the units that were used only once or twice."""
        keep = np.flatnonzero(self.hits > 2)
        place = np.full(len(self.hits), -1)
        place[keep] = np.arange(len(keep))
        self.at = {k: n for k, i in self.at.items() if (n := int(place[i])) >= 0}
        self.flat = self.flat[ragged(self.starts[keep], self.sizes[keep])]
        self.sizes, self.hits = self.sizes[keep], self.hits[keep] // 2
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _ids(self, strings: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(strings, add_special_tokens=False)]

    def _store(self, keys: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        self.at.update(zip(keys, range(len(self.at), len(self.at) + len(keys))))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes, self.hits = np.concatenate([self.sizes, sizes]), np.concatenate([self.hits, np.zeros(len(keys), np.int64)])
        self.flat = np.concatenate([self.flat, flat])

    def _learn(self, keys: list[str]) -> None:
        """Encode new units, many to a call, told apart by the newline's own id."""
        names, flats, sizes = [], [], []
        if self.model:
            keys = self._learn_letters(keys, names, flats, sizes)
        for bare in (False, True):
            mine = [k for k in keys if (k[:1] == self.MARK) == bare and k != "\n" and k != self.MARK]
            spoken = [k[1:] for k in mine] if bare else [f" {k}" for k in mine]
            odd: list[int] = []
            if len(self.newline) != 1:
                odd = list(range(len(mine)))
            elif re.search(r"[^\S\n]", "".join(mine)):
                odd = [i for i, k in enumerate(mine) if re.search(r"\s", k)]
            if odd:
                ids = self._ids([spoken[i] for i in odd])
                names += [mine[i] for i in odd]
                flats += [np.array(x, np.uint32) for x in ids]
                sizes.append(np.array(list(map(len, ids)), np.int64))
                skip = set(odd)
                mine, spoken = ([x for i, x in enumerate(y) if i not in skip] for y in (mine, spoken))
            for a in range(0, len(mine), 4000):
                ids = np.array(self._ids(["\n".join(spoken[a : a + 4000])])[0], np.uint32)
                mark = np.flatnonzero(ids == self.newline[0])
                sizes.append(np.diff(np.concatenate([[-1], mark, [len(ids)]])) - 1)
                flats.append(np.delete(ids, mark))
                names += mine[a : a + 4000]
        for k, ids in (("\n", self.newline), (self.MARK, [])):
            if k in keys:
                names.append(k)
                flats.append(np.array(ids, np.uint32))
                sizes.append(np.array([len(ids)], np.int64))
        self._store(names, np.concatenate(flats), np.concatenate(sizes))

    def _learn_letters(self, keys: list[str], names: list[str], flats: list[np.ndarray], sizes: list[np.ndarray]) -> list[str]:
        """Encode the new units of letters and punctuation by the model alone; returns the others."""
        tokenize, latin, found, rest, flat, n = self.model.tokenize, self.LATIN.fullmatch, {}, [], [], []
        for k in keys:
            body = k[1:] if k[:1] == self.MARK else k
            word = body.rstrip(self.BEHIND)
            if word.isascii():
                if not word.isalpha():
                    rest.append(k)
                    continue
                spoken = word if body is not k else "Ġ" + word
            elif latin(word):
                spoken = word.encode().decode("latin-1").translate(self.BYTES)
                spoken = spoken if body is not k else "Ġ" + spoken
            else:
                rest.append(k)
                continue
            ids = found.get(spoken)
            if ids is None:
                ids = found[spoken] = [t.id for t in tokenize(spoken)]
            if len(word) < len(body):
                tail = body[len(word) :]
                more = found.get(tail)
                if more is None:
                    more = found[tail] = [t.id for t in tokenize(tail)]
                ids = ids + more
            names.append(k)
            flat += ids
            n.append(len(ids))
        flats.append(np.array(flat, np.uint32))
        sizes.append(np.array(n, np.int64))
        return rest

    def encode(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, one after another, and the number of ids of each row."""
        if len(self.at) > self.limit:
            self._forget()
        whole = [bool(self.BREAK.search(t)) or any(s in t for s in self.special) for t in rows]
        cut = pc.split_pattern(pa.array([self.MARK if w else self.MARK + t.replace("\n", " \n \0") for t, w in zip(rows, whole)], pa.string()), " ")
        coded, units = cut.flatten().dictionary_encode(), cut.value_lengths().to_numpy().astype(np.int64)
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = np.fromiter(map(self.at.get, keys, repeat(-1)), np.int64, len(keys))
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            new = [keys[i] for i in unknown]
            self._learn(new)
            place[unknown] = np.fromiter(map(self.at.__getitem__, new), np.int64, len(new))
        k = place[coded.indices.to_numpy()]
        self.hits += np.bincount(k, minlength=len(self.hits))
        flat, ends = self.flat[ragged(self.starts[k], self.sizes[k])], np.concatenate([[0], np.cumsum(self.sizes[k])])
        at = np.concatenate([[0], np.cumsum(units)])
        lengths = ends[at[1:]] - ends[at[:-1]]
        if not any(whole):
            return flat, lengths
        parts, own = np.split(flat, np.cumsum(lengths)[:-1]), []
        for t, w, part in zip(rows, whole, parts):
            own.append(np.array(self._ids([t])[0], np.uint32) if w else part)
        return np.concatenate(own), np.array([len(o) for o in own], np.int64)


_ENCODERS: dict[str, CachedEncoder] = kept(__name__)


def encoder(path: str) -> CachedEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]


def chunks(rows: list[str], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges of rows with about `most` characters each."""
    a, size = 0, 0
    for i, t in enumerate(rows):
        size += len(t)
        if size >= most:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(rows):
        yield a, len(rows)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, block: int = 8192, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write `docs` in ascending id order below `folder`; returns the manifest (file_no, path, n_docs, n_ids, start).

    One file for each range of ids. A task writes under a name of its own, and only files named in the manifest
    count, so repeated or lost tasks leave nothing wrong behind.
    """
    from tokenizers import Tokenizer

    bits = width(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True))
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(id_col, text_col).repartitionByRange(files, F.col(id_col).asc_nulls_first()).sortWithinPartitions(F.col(id_col).asc_nulls_first(), text_col)

    def run(batches):
        part, enc, writer, name = TaskContext.get().partitionId(), encoder(tokenizer), None, ""
        for b in batches:
            ids, rows = b.column(id_col).to_pylist(), texts(b, text_col)
            for lo, hi in chunks(rows, 4_000_000):
                if writer is None:
                    fs, base = pafs.FileSystem.from_uri(folder)
                    fs.create_dir(base, recursive=True)
                    name = f"{folder}/tokens-{part:06d}-{uuid.uuid4().hex}.bits"
                    writer = Writer(fs.open_output_stream(pafs.FileSystem.from_uri(name)[1]), bits, block)
                flat, n = enc.encode(rows[lo:hi])
                ends = np.cumsum(n)
                writer.add(ids[lo:hi], np.insert(flat, ends, end_id), n + 1)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(writer.docs)], pa.int64()), pa.array([writer.n], pa.int64())], ["file_no", "path", "n_docs", "n_ids"])

    manifest = written(arrow_map(ordered, run, "file_no int, path string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of each document, from the files that the manifest names."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(at) as source:
                    r = Reader(source)
                    for lo in range(0, len(r.docs), 512):
                        hi = min(lo + 512, len(r.docs))
                        s = r.starts[lo : hi + 1]
                        ids = r.ids(int(s[0]), int(s[-1])).astype("<u4")
                        crc = [zlib.crc32(ids[a - s[0] : z - s[0]].tobytes()) for a, z in zip(s[:-1], s[1:])]
                        yield pa.RecordBatch.from_arrays([pa.array(r.docs[lo:hi], pa.int64()), pa.array(start + s[:-1]), pa.array(np.diff(s)), pa.array(crc, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    return arrow_map(manifest.select("path", "start").repartition(n, "path"), run, f"{id_col} long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int = 0, block: int = 8192) -> DataFrame:
    """Write the token files to the shared folder and return what is read back from them.

    Null and empty texts hold the end id alone. Repeated ids stay separate documents, ordered by text; a null id
    comes first. An empty table writes no file and gives an empty result. Other columns are not read.
    """
    return read_token_files(write_token_files(docs, new_folder(docs.sparkSession, "tokens"), tokenizer, end_id, block))
