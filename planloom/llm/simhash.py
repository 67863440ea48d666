"""SimHash near-duplicate groups by the generalised pigeonhole principle.

Fingerprints are 64-bit majority votes over the XXH64 values of word shingles. Two fingerprints link when at
most `tau` bits differ. The 64 bits are cut into m partitions of mutually correlated bits; partition i gets a
threshold t_i, the t_i add up to tau - m + 1, and any linked pair must differ in at most t_i bits of some
partition i. The allocation is found by dynamic programming over estimated candidate counts, from bit
statistics of all fingerprints. A threshold t on a partition of w bits is probed through C(w, t) bit masks: two
values within t bits agree on at least one of the masks that leave t bits out. Rows that share a masked value
are candidates and are verified on all 64 bits.

Large buckets never expand into pairs. For tau = 2 a bucket above `bucket_limit` is re-keyed by the balls of
radius one around its members over the bits outside the mask: two fingerprints within two bits share a ball
centre, and any two members of one ball are within two bits, so a star in each ball is exact and linear.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.llm.common import arrow_map, bodies, words_of
from planloom.operators.graph import connected_components, joined
from planloom.storage import cut, discard, freed_at_once, sweep, written

BITS = 64
SKETCH = 128
#: So many links (8 MB) are united on the driver; more in the cluster.
DRIVER_LINKS = 500_000


def shingle_hashes(body: bytes, k: int, seed: int = 42) -> list[int]:
    """XXH64 of each k-word shingle, repeats included; fewer than k words give one shingle, none gives none."""
    words = words_of(body)
    n = len(words)
    if not n:
        return []
    line = b" ".join(words)
    if n <= k:
        return [xxhash.xxh64_intdigest(line, seed)]
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: n - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip(first, last)]


def fingerprint(hashes: list[int]) -> int:
    """Signed 64-bit majority vote: a bit is 1 if set in over half of the hashes; no hash gives 0."""
    if not hashes:
        return 0
    h = np.array(hashes, np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint16)
    return int(np.packbits(ones * 2 > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id_col, fp long). Null and empty texts have fingerprint 0."""

    def run(batches):
        for b in batches:
            fp = [fingerprint(shingle_hashes(x, shingle_words)) for x in bodies(b, text_col)]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(fp, pa.int64())], [id_col, "fp"])

    return arrow_map(docs.select(id_col, text_col), run, f"{id_col} long, fp long")


def bit_statistics(fps: DataFrame, column: str = "fp") -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together, over all rows."""

    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            v = b.column(column).to_numpy(zero_copy_only=False).astype(">i8")
            bits = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            total += bits.T @ bits
            n += len(v)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.ravel().astype(np.int64)])], ["n", "counts"])

    parts = arrow_map(fps.select(column), run, "n long, counts array<long>")
    rows = parts.select("n", F.posexplode("counts")).groupBy("pos").agg(F.sum("col").alias("c"), F.sum("n").alias("n")).collect()
    counts = np.zeros(BITS * BITS)
    for r in rows:
        counts[r["pos"]] = r["c"]
    return (rows[0]["n"] if rows else 0), counts.reshape(BITS, BITS)


def _partitions(corr: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near-equal size, each grown around a bit by its strongest correlations."""
    left, groups = set(range(BITS)), []
    for g in range(m):
        size = (BITS - sum(map(len, groups))) // (m - g)
        group = [max(left, key=lambda b: (corr[b, list(left)].sum(), -b))]
        left.discard(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        groups.append(group)
    return groups


def _close(p: np.ndarray, cov: float, t: int) -> float:
    """Estimated chance that two fingerprints differ in at most t bits of a partition (beta-binomial fit)."""
    w, mean = len(p), float(p.sum())
    if mean <= 0:
        return 1.0
    q = min(mean / w, 1 - 1e-9)
    var = max(float((p * (1 - p)).sum() + cov), 1e-9)
    rho = min(max((var / (w * q * (1 - q)) - 1) / max(w - 1, 1), 1e-6), 0.999)
    a, b = q * (1 - rho) / rho, (1 - q) * (1 - rho) / rho
    lbeta = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
    return min(1.0, sum(math.comb(w, d) * math.exp(lbeta(d + a, w - d + b) - lbeta(a, b)) for d in range(t + 1)))


def plan(n: int, counts: np.ndarray, tau: int, pair_cost: float = 1.0, row_cost: float = 2.0, largest_t: int = 2) -> list[int]:
    """Bit masks (unsigned) to probe: the cheapest partition count and threshold allocation by estimated cost."""
    n = max(n, 1)
    f = np.diag(counts) / n
    cov = counts / n - np.outer(f, f)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    differ = 2 * f * (1 - f)
    best: tuple[float, list] = (math.inf, [])
    for m in range(2, tau + 2):
        groups = _partitions(corr, m)
        need = tau - m + 1
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}  # sum of t + 1 -> cost, allocation
        for g in groups:
            within = 2 * float((cov[np.ix_(g, g)] ** 2).sum() - (np.diag(cov)[g] ** 2).sum())
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for have, (cost, chosen) in table.items():
                for t in range(-1, largest_t + 1):
                    more = 0.0 if t < 0 else row_cost * math.comb(len(g), t) * n + pair_cost * n * n / 2 * _close(differ[g], within, t)
                    at = have + t + 1
                    if at <= need + m and cost + more < step.get(at, (math.inf, ()))[0]:
                        step[at] = (cost + more, (*chosen, t))
            table = step
        if need + m in table and table[need + m][0] < best[0]:
            best = (table[need + m][0], list(zip(groups, table[need + m][1])))
    masks = []
    for group, t in best[1]:
        if t >= 0:
            for out in itertools.combinations(group, t):
                masks.append(sum(1 << (63 - b) for b in group if b not in out))
    return masks


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(fps: DataFrame, masks: list[int], column: str = "fp") -> DataFrame:
    probes = F.array(*[F.struct(F.lit(i).alias("f"), F.col(column).bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)])
    return fps.select("*", F.explode(probes).alias("probe")).select(*fps.columns, "probe.f", "probe.key")


def hamming_links(fps: DataFrame, tau: int = 2, bucket_limit: int = 8) -> DataFrame:
    """Distinct (u, v), u > v: edges among distinct fingerprints `fp` whose closure is that of all links within tau.

    Buckets of at most `bucket_limit` give every verified pair. Larger ones give stars in balls of radius one,
    which connect exactly what links of up to two bits connect; so tau may be at most 2.
    """
    if tau > 2:
        raise ValueError("large buckets are exact up to two differing bits")
    masks = plan(*bit_statistics(fps), tau)
    rows = _keyed(fps, masks)
    sizes = rows.groupBy("f", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = cut(joined(rows, sizes, ["f", "key"]))
    lists = rows.where(F.col("n") <= bucket_limit).groupBy("f", "key").agg(F.collect_list("fp").alias("fps"))
    pairs = F.flatten(F.transform("fps", lambda a: F.transform(F.filter("fps", lambda b: (b < a) & (F.bit_count(a.bitwiseXOR(b)) <= tau)), lambda b: F.struct(a.alias("u"), b.alias("v")))))
    small = lists.select(F.explode(pairs).alias("e")).select("e.u", "e.v")
    outside = [F.array(*[F.lit(signed(1 << b)) for b in range(BITS) if not m >> b & 1], F.lit(0).cast("long")) for m in masks]
    flips = F.element_at(F.array(*outside), F.col("f") + 1)
    # Balls are taken over all hot rows at once: a ball is the same set of fingerprints whatever bucket it comes from.
    hot = rows.where(F.col("n") > bucket_limit).select("fp", F.explode(flips).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("ball")).distinct()
    centres = hot.groupBy("ball").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("ball", "v")
    large = hot.join(centres, "ball").where("fp > v").select(F.col("fp").alias("u"), "v")
    return small.unionByName(large).distinct()


def simhash_components(docs: DataFrame, shingle_words: int = 3, tau: int = 2, bucket_limit: int = 8) -> DataFrame:
    """(doc_id, fingerprint, component_id): groups of documents connected by fingerprints within tau bits.

    Equal fingerprints (exact copies, texts without words) are collapsed before any candidate search. A
    null or empty text has fingerprint zero and is linked like any other; repeated ids stay repeated rows; an
    empty table gives an empty result.
    """
    fps = written(fingerprints(docs, shingle_words), "simhash")
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    # A component's root is a fingerprint; its id is the smallest document id below it.
    roots = connected_components(hamming_links(distinct.select("fp"), tau, bucket_limit))
    classes = distinct.join(roots, distinct.fp == roots.u, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    members = classes.join(lowest, "root").select("fp", "component_id")
    return fps.join(members, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def node_of(body: bytes) -> int:
    """64-bit hash of the word sequence: among 10^10 different texts about three pairs share one. Wider keys cost sorts and twice the shuffle."""
    return signed(xxhash.xxh3_64_intdigest(b" ".join(words_of(body))))


def shingle_keys(body: bytes, shingle_words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(body, shingle_words), np.uint64).view(np.int64))


def prefix(keys: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[int, np.ndarray]:
    """(number of sorted distinct shingles, keys): the first n - ceil(similarity n) + 1 shingles in a fixed order of all shingles.

    Sets with that Jaccard similarity share at least ceil(similarity n) shingles, so one of them is in both prefixes,
    whatever the order is. It is by hash; the hashes `common` (sorted hashes, their counts) follow all others, by rising count.
    """
    n = len(keys)
    if common is not None and len(common[0]):
        at = np.minimum(np.searchsorted(common[0], keys), len(common[0]) - 1)
        keys = keys[np.argsort(np.where(common[0][at] == keys, common[1][at], 0), kind="stable")]
    return n, keys[: n - math.ceil(similarity * n - 1e-9) + 1] if n else keys


def _prefixed(docs: DataFrame, shingle_words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(id_col, node, fp, n, prefix); fp is the fingerprint of all shingles, repeats included."""

    def of(body):
        hashes = shingle_hashes(body, shingle_words)
        return node_of(body), fingerprint(hashes), *prefix(np.unique(np.array(hashes, np.uint64).view(np.int64)), similarity)

    def run(batches):
        for b in batches:
            made = [of(x) for x in bodies(b, text_col)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(id_col), *[pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]], [id_col, "node", "fp", "n", "prefix"])

    return arrow_map(docs.select(id_col, text_col), run, f"{id_col} long, node long, fp long, n int, prefix array<long>")


def _rows_of(frame: DataFrame, wanted: DataFrame, id_col: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of a frame with the id `rep` of a wanted node (node, rep, c), with _node and c; rows alike in id can bring other texts along."""
    reps = wanted.select(F.col("rep").alias("_rep"), F.col("node").alias("_node"), "c")
    if wanted.count() <= broadcast_rows:  # 24 bytes a row; larger sets are joined by shuffle
        reps = F.broadcast(reps)
    return frame.withColumnRenamed(id_col, "_id").join(reps, F.col("_id").eqNullSafe(F.col("_rep"))).drop("_id", "_rep")


def _once(frame: DataFrame) -> DataFrame:
    """One row a node: only nodes whose id and words are in several rows (c > 1) go through a shuffle."""
    return frame.where("c = 1").unionByName(frame.where("c > 1").dropDuplicates(["node"])).drop("c")


def _from_texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, of, columns: list[str], kinds: list[pa.DataType], schema: str, then=None) -> DataFrame:
    """(node, c, *columns): what `of` makes of the words of the wanted nodes (node, rep, c), read from the texts of their documents.

    With `then`, what that makes of these rows, batch by batch in the same worker: a step of its own would be a second worker a core.
    """

    def run(batches):
        for b in batches:
            found = [(node, c, *of(body)) for body, node, c in zip(bodies(b, text_col), b.column("_node").to_pylist(), b.column("c").to_pylist()) if node == node_of(body)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), *kinds))], ["node", "c", *columns])

    if then is None:
        return arrow_map(_rows_of(docs.select(id_col, text_col), wanted, id_col), run, f"node long, c long, {schema}")

    def both(batches):
        yield from then(run(batches))

    return arrow_map(_rows_of(docs.select(id_col, text_col), wanted, id_col), both, schema)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """How many shingles of a set fall into each of SKETCH classes. The lesser of two counts, added up, bounds what two sets share."""
    return np.bincount(shingles & (SKETCH - 1), minlength=SKETCH).astype(np.int32)


def _shingle_sets(docs: DataFrame, wanted: DataFrame, shingle_words: int, id_col: str, text_col: str) -> DataFrame:
    """(node, c, shingles, sketch): distinct 32-bit shingle hashes of the wanted nodes (node, rep, c)."""

    def of(body):
        shingles = np.unique(np.array(shingle_hashes(body, shingle_words), np.uint64).astype(np.uint32).view(np.int32))
        return shingles, sketch(shingles)

    return _from_texts(docs, wanted, id_col, text_col, of, ["shingles", "sketch"], [pa.list_(pa.int32())] * 2, "shingles array<int>, sketch array<int>")


def _counted(column: str, held_keys: int = 1_000_000):
    """A step over batches: (key, c) of the keys in an array column; keys found once among the held keys are not sent on."""

    def counted(held):
        found, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found[c > 1], pa.int64()), pa.array(c[c > 1], pa.int64())], ["key", "c"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b.column(column).flatten().to_numpy())
            size += len(held[-1])
            if size > held_keys:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    return run


def _frequent(counts: DataFrame, often: int, most_common: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, counts) of the keys found more than `often` times, at most `most_common`, from counts by task (key, c).

    Keys found once among the held keys of a task are not sent on, so counts can be too low where a key is spread thinly.
    """
    top = counts.groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") > often).orderBy(F.desc("c"), "key").limit(most_common).toArrow()
    found = top["key"].to_numpy().astype(np.int64)
    return found[by_key := np.argsort(found)], top["c"].to_numpy()[by_key]


def _held_in(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys are among sorted keys."""
    if not len(some):
        return np.zeros(len(keys), bool)
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys


def prefix_keys(docs: DataFrame, own: DataFrame, shingle_words: int, similarity: float, id_col: str, text_col: str, often: int = 64, most_common: int = 1_000_000) -> DataFrame:
    """(key, node, n, pos, size): prefix shingles found in more than one node. `own` has (node, rep, c, n, prefix).

    Shingles found in over `often` prefixes go to the end of the order, the most common last, so that texts which only
    share a common passage do not meet. Any order is exact; at most `most_common` such shingles are set back.
    """
    spark = docs.sparkSession.sparkContext

    def split(common):
        """(wanted (node, rep, c) whose prefix has a common shingle, rows (node, c, n, prefix) of all others)."""
        sent = spark.broadcast(common[0])

        def parted(touched):
            def run(batches):
                for b in batches:
                    flat, ends = b.column("prefix").flatten().to_numpy(), b.column("prefix").value_lengths().to_numpy(zero_copy_only=False)
                    has = np.zeros(len(ends), bool)
                    has[np.repeat(np.arange(len(ends)), ends)[_held_in(flat, sent.value)]] = True
                    yield b.select(["node", "rep", "c"] if touched else ["node", "c", "n", "prefix"]).filter(pa.array(has if touched else ~has))

            return run

        rep = own.schema["rep"].dataType.simpleString()
        some = arrow_map(own.select("node", "rep", "c", "prefix"), parted(True), f"node long, rep {rep}, c long").dropDuplicates(["node"])
        return cut(some), arrow_map(own.select("node", "rep", "c", "n", "prefix"), parted(False), "node long, c long, n int, prefix array<long>")

    each, ordered = own.select("node", "c", "n", "prefix"), []
    first = _frequent(arrow_map(own.select("prefix"), _counted("prefix"), "key long, c long"), often, most_common)
    if len(first[0]):
        # What follows the first prefixes is as common as they are: all shingles of these texts are counted.
        whole = _from_texts(docs, split(first)[0], id_col, text_col, lambda body: (shingle_keys(body, shingle_words),), ["keys"], [pa.list_(pa.int64())], "key long, c long", _counted("keys"))
        common = _frequent(whole, often, most_common)
        ranked = spark.broadcast(common)
        touched, same = split(common)
        # A prefix without a common shingle is the same in the new order.
        again = _from_texts(docs, touched, id_col, text_col, lambda body: prefix(shingle_keys(body, shingle_words), similarity, ranked.value), ["n", "prefix"], [pa.int32(), pa.list_(pa.int64())], "n int, prefix array<long>")
        ordered = [written(again, "ordered")]
        each = same.unionByName(ordered[0])
    each = _once(each).select("node", "n", F.posexplode("prefix").alias("pos", "key"))
    sizes = cut(each.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    sweep(docs.sparkSession)  # the counts' shuffle is as large as that of the join
    keys = cut(joined(each, sizes, ["key"], "size"))
    discard(*ordered)
    sweep(docs.sparkSession)
    return keys


def fingerprint_pairs(nodes: DataFrame, tau: int = 2) -> DataFrame:
    """(u, v) of nodes (node, fp), to be verified: one node of each fingerprint stands for it, with the others of the same
    fingerprint and with those that hamming_links links to it."""
    heads = cut(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    same = nodes.join(heads, "fp").where("node > head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    links = hamming_links(heads.select("fp"), tau)
    at = lambda fp, name: heads.select(F.col("fp").alias(fp), F.col("head").alias(name))
    near = links.join(at("u", "a"), "u").join(at("v", "b"), "v").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return cut(same.unionByName(near))


def _may_link(a: str, b: str, similarity: float) -> Column:
    """No bound on the overlap by sizes and places of the first common shingle rules the pair out."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))
    return rest >= similarity / (1 + similarity) * (n + m) - 1e-6


def _rooted(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    """rows with the root of each node under the links."""
    if links is None:
        return rows.withColumn("root", F.col("node"))
    roots = connected_components(links, driver_edges=DRIVER_LINKS).select(F.col("u").alias("node"), F.col("root").alias("_root"))
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("_root", "node")).drop("_root")


def near_copy_links(keys: DataFrame, sets_of, similarity: float, first: DataFrame, bucket_limit: int = 8, star_rounds: int = 6, salts: int = 16, pairs_a_row: int = 64) -> DataFrame:
    """(u, v): verified links whose closure is that of all pairs of nodes that share a key and have the given similarity.

    The pairs `first` (u, v) are verified before all others: what they unite is not compared again. Buckets of at most bucket_limit give all pairs. In a larger one a centre is first compared with all others, and the
    texts around it are linked by what sets them apart from it (around_centres). These leave the bucket, and a further
    centre is taken for what is left. In the end every member outside the bucket's largest united part is compared
    with every member of another part; pairs within one part are connected already. Nothing is lost. Centres only save
    comparisons: once what is left is at most `pairs_a_row` pairs a row, or a round has saved less than half of the pairs,
    all of it is compared at once.
    """
    lists = keys.where(F.col("size") <= bucket_limit).groupBy("key").agg(F.collect_list(F.struct("node", "n", "pos")).alias("in"))
    pairs = lists.select(F.explode("in").alias("a"), "in").select("a", F.explode("in").alias("b")).where("b.node < a.node").where(_may_link("a", "b", similarity))
    pairs = cut(pairs.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct())
    hot = cut(keys.where(F.col("size") > bucket_limit).select("key", "node", "n", "pos"))
    ends = pairs.unionByName(first).select(F.explode(F.array("u", "v")).alias("node")).unionByName(hot.select("node")).distinct()
    sets = sets_of(cut(ends))
    links = cut(verified(first, sets, similarity))
    roots = connected_components(links, driver_edges=DRIVER_LINKS)
    for end in "uv":
        pairs = pairs.join(roots.select(F.col("u").alias(end), F.col("root").alias(f"r{end}")), end, "left")
    apart = F.coalesce("ru", "u") != F.coalesce("rv", "v")
    links = cut(links.unionByName(verified(pairs.where(apart).select("u", "v"), sets, similarity)))
    sweep(keys.sparkSession)
    # A text with much of its prefix in large buckets stands at the middle of a group of copies.
    weight = F.count("*").over(Window.partitionBy("node")) / F.col("n")
    left, before = hot, math.inf
    for k in range(star_rounds + 1):
        left = _rooted(left.withColumn("w", weight), links)
        parts = left.groupBy("key", "root").agg(F.count("*").alias("c"), F.max(F.struct("w", "node", "n", "pos")).alias("best"))
        buckets = parts.groupBy("key").agg(F.max(F.struct("c", "root")).alias("main"), F.sum("c").alias("all"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("main.root").alias("main"), (F.col("all") - F.col("main.c")).alias("out"))
        left = cut(left.join(buckets, "key"))
        n, work = left.agg(F.count("*"), F.sum(F.col("out").cast("double"))).first()
        if not n:
            break
        outside = left.where("root <> main")
        last = k == star_rounds or work <= pairs_a_row * n or work > 0.8 * before
        before = work
        if last:
            salt = F.pmod(F.xxhash64("node"), F.lit(salts))
            small = outside.select("key", F.struct("node", "n", "pos", "root").alias("b"), F.explode(F.array(*[F.lit(k).cast("long") for k in range(salts)])).alias("salt"))
            both = left.select("key", F.struct("node", "n", "pos", "root").alias("a"), salt.alias("salt")).join(small, ["key", "salt"])
            more = both.where("a.root <> b.root").where(_may_link("a", "b", similarity)).select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v")).distinct()
            links = cut(links.unionByName(verified(more, sets, similarity)).distinct())
            break
        centre = left.groupBy("key").agg(F.max(F.struct("w", "node", "n")).alias("b")).select("key", F.col("b.node").alias("c"), F.col("b.n").alias("nc"))
        left = cut(left.join(centre, "key").select("key", "node", "n", "pos", "root", "c", "nc"))
        found, done = around_centres(left, sets, similarity)
        links = cut(links.unionByName(found).distinct())
        sweep(keys.sparkSession)
        left = left.where("node <> c").join(done, ["c", "node"], "left_anti").select("key", "node", "n", "pos")
    return links


def around_centres(rows: DataFrame, sets: DataFrame, similarity: float, broadcast_shingles: int = 4_000_000) -> tuple[DataFrame, DataFrame]:
    """(links, done) of rows (node, n, root, c, nc), c being a centre: verified links, and the (c, node) that need no more comparison with any row of c.

    D(u) is the symmetric difference of the sets of u and c; that of two texts is that of their D. With
    k = (1 - s) / (1 + s), similarity s or more means |D(u)| + |D(v)| - 2 |D(u) & D(v)| <= k (|u| + |v|). As |D(u)| is at least
    |u| - |c|, two such texts with nothing in common in D are both alike to the centre, hence connected. All others share an element
    of their D, and the overlap needed bounds its place, rare elements first. Distances obey the triangle
    inequality: of a pair at most 1 - s apart both lie within 3 (1 - s) of the centre, or both beyond 2 (1 - s).
    """
    apart, k = 1 - similarity, (1 - similarity) / (1 + similarity)
    near = rows.where("node <> c").where(F.least("n", "nc") >= (1 - 3 * apart) * F.greatest("n", "nc") - 2).select("c", "node", "root").distinct()
    of = lambda node, shingles: sets.select(F.col("node").alias(node), F.col("shingles").alias(shingles))
    centres, chosen = of("c", "sc"), rows.select("c", "nc").distinct()
    if (chosen.agg(F.sum("nc")).first()[0] or 0) <= broadcast_shingles:  # 4 bytes each; else the sets of all others are shuffled by centre
        centres = F.broadcast(centres.join(F.broadcast(chosen.select("c")), "c", "left_semi"))
    both = near.join(of("node", "su"), "node").join(centres, "c")
    both = both.select("c", "node", "root", F.size("su").alias("n"), F.size("sc").alias("nc"), F.array_union(F.array_except("su", "sc"), F.array_except("sc", "su")).alias("d")).withColumn("size", F.size("d"))
    # |union| = (n + nc + |D|) / 2
    distance = 2 * F.col("size") / (F.col("n") + F.col("nc") + F.col("size"))
    both = cut(both.withColumn("far", distance).where(F.col("far") <= 3 * apart + 1e-9).withColumn("star", F.col("size") <= k * (F.col("n") + F.col("nc")) + 1e-9))
    stars = both.where("star").select(F.greatest("c", "node").alias("u"), F.least("c", "node").alias("v"))
    each = both.select("c", "node", "root", "n", "size", "star", F.explode("d").alias("x"))
    counts = each.groupBy("c", "x").agg(F.count("*").alias("f"))
    order = Window.partitionBy("c", "node").orderBy("f", "x")  # as many rows as one text differs in
    each = joined(each, counts, ["c", "x"], "f").withColumn("pos", F.row_number().over(order) - 1).where("f > 1")
    side = F.struct("node", "root", "n", "size", "star", "pos")
    a, b = (each.select("c", "x", side.alias(name)) for name in "ab")
    most = F.least(F.col("a.size") - F.col("a.pos"), F.col("b.size") - F.col("b.pos"))
    needed = F.col("a.size") + F.col("b.size") - k * (F.col("a.n") + F.col("b.n"))
    met = a.join(b, (a.c == b.c) & (a.x == b.x) & F.expr("a.node > b.node and a.root <> b.root and not (a.star and b.star)") & (2 * most >= needed - 1e-6))
    more = met.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
    return stars.unionByName(verified(more, sets, similarity)), both.where(F.col("far") <= 2 * apart - 1e-9).select("c", "node")


def _sketched(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sketches do not rule the similarity out. A sketch is a small part of a set, and only sets of pairs left are shuffled."""

    def run(batches):
        for b in batches:
            left, right = (b.column(c).flatten().to_numpy().reshape(-1, SKETCH) for c in ("ku", "kv"))
            both = np.minimum(left, right).sum(1, dtype=np.int64)
            all_ = left.sum(1, dtype=np.int64) + right.sum(1, dtype=np.int64) - both
            yield b.select(["u", "v"]).filter(pa.array(both >= similarity * all_ - 1e-6))

    of = lambda end: sets.select(F.col("node").alias(end), F.col("sketch").alias(f"k{end}"))
    return arrow_map(pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "ku", "kv"), run, "u long, v long")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float, broadcast_rows: int = 1_000_000, few: int = 10_000) -> DataFrame:
    """Pairs whose shingle sets have at least the given Jaccard similarity; only the sets they need are shuffled.

    More than `few` pairs are first thinned by the sketches, which lose no link."""
    pairs = cut(pairs)
    n = pairs.count()
    if n > few and "sketch" in sets.columns:
        pairs = cut(_sketched(pairs, sets, similarity))
        n = pairs.count()
    if n <= broadcast_rows:  # at most twice as many nodes of 8 bytes; more are matched by shuffle
        ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
        sets = sets.join(F.broadcast(ends), "node", "left_semi")
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v")
    common = F.size(F.array_intersect("su", "sv"))
    return both.where(common >= similarity * (F.size("su") + F.size("sv") - common)).select("u", "v")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text"):
    """One row per document: (id_col, node, root); equal roots are near-duplicate groups.

    SimHash comes first: fingerprints of the shingles at most two bits apart link their texts, where the shingle sets have
    the similarity. A fingerprint can be further apart than that for a pair that is alike, so an exact search by common
    shingles then joins what the fingerprints have left apart; it compares no pair that they have united.
    Copies that agree in all words (A-Z lower-cased) are one node; texts without words are one node too.
    """
    with freed_at_once(docs.sparkSession):
        rows = written(_prefixed(docs, shingle_words, similarity, id_col, text_col), "prefixed")
        seen = rows.groupBy("node", id_col).agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("fp").alias("fp"))
        lowest = F.min(F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("rep"), "c")).alias("k")
        nodes = written(seen.groupBy("node").agg(lowest, F.first("n").alias("n"), F.first("fp").alias("fp")).select("node", "k.rep", "k.c", "n", "fp"), "nodes")
        first = fingerprint_pairs(nodes.select("node", "fp"))
        own = _rows_of(rows.withColumn("rep", F.col(id_col)), nodes, id_col).where("node = _node").select("node", "rep", "c", "n", "prefix")
        keys = prefix_keys(docs, own, shingle_words, similarity, id_col, text_col)
        ids = written(rows.select(id_col, "node"), "ids")
        discard(rows)  # the keys hold what is needed of the prefixes
        made = []

        def sets_of(ends):
            made.append(written(_shingle_sets(docs, cut(nodes.select("node", "rep", "c").join(ends, "node")), shingle_words, id_col, text_col), "sets"))
            return _once(made[-1])

        roots = connected_components(near_copy_links(keys, sets_of, similarity, first), driver_edges=DRIVER_LINKS)
        discard(*made)
    return ids.join(roots, ids.node == roots.u, "left").select(id_col, "node", F.coalesce("root", "node").alias("root"))


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, broadcast_rows: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate group, the one with the smallest id, with all columns of `docs`.

    A null id counts as larger than any other. Of rows alike in id and words one stays. An empty table gives an empty result.
    """
    groups = near_duplicates(docs, shingle_words, similarity, id_col, text_col)
    names, lows = docs.columns, {c.lower() for c in docs.columns}
    node, kept_id, kept_node = (f"_{k}" + "_" * sum(c.startswith(f"_{k}") for c in lows) for k in ("node", "id", "kept"))
    groups = written(groups.groupBy(id_col, "node", "root").agg(F.count("*").alias("n")).withColumnRenamed(id_col, "id"), "groups")
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "node")).alias("k")).select(F.col("k.id").alias("id"), F.col("k.node").alias("node"))
    one, two = groups.alias("one"), first.alias("two")
    on = F.col("one.id").eqNullSafe(F.col("two.id")) & (F.col("one.node") == F.col("two.node"))
    gone = written(one.join(two, on, "left_anti").select(F.col("id").alias(kept_id), F.col("node").alias(kept_node)), "gone")
    twice = one.where("n > 1").join(two, on, "left_semi").select(F.col("id").alias(kept_id), F.col("node").alias(kept_node))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{node}` long"

    def run(batches):
        for b in batches:
            found = [node_of(x) for x in bodies(b, text_col)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], [*names, node])

    # The texts are shuffled only where what goes is too much to broadcast (16 bytes a row), or repeated rows stay as one.
    few = lambda keys: F.broadcast(keys) if keys.count() <= broadcast_rows else keys
    match = F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(node) == F.col(kept_node))
    left = arrow_map(docs, run, schema).join(few(gone), match, "left_anti")
    if twice.isEmpty():
        return left.select(*names)
    repeated = few(twice)
    return left.join(repeated, match, "left_anti").unionByName(left.join(repeated, match, "left_semi").dropDuplicates([id_col, node])).select(*names)
