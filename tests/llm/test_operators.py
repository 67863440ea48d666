"""Each operator against brute force, an exact round trip or held-out accuracy, and on awkward rows."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from planloom.llm import annforest, bitpack, decontaminate, langid, linededup, pieces, pii, ppm, simhash, toxicity

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, n_items int, score string, n_dropped int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, words(rng, rng.randint(1, 60)) + "\nShared  line\n" + words(rng, 5)) for i in range(60)]
    base = words(rng, 200)
    for i in range(60, 80):
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        out.append((i, " ".join(w)))
    out += [(80, base), (81, base), (81, base), (82, None), (83, ""), (84, "\n\n"), (None, "no id here"), (85, words(rng, 6000)), (86, "é 漢字 \U0001f600"), (87, "x" * 50_000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Extra columns carry names that operators use for their own."""
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s", len(t or ""), "fp", 7, "q", 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def held(frame, *cols):
    return collections.Counter(tuple(r[c] for c in cols) for r in frame.collect())


def test_simhash_components_match_brute_force(docs, rows, none):
    got = simhash.simhash_components(docs).collect()
    prints = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in sh) for b in range(64)]
        prints[i, t] = sum((2 * o > len(sh)) << b for b, o in enumerate(ones)) if sh else 0
    keys = list(prints)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in keys:
        for b in keys:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    low = collections.defaultdict(list)
    for k in keys:
        low[find(k)].append(k[0])
    want = collections.Counter((i, f"{prints[i, t]:016x}", min((x for x in low[find((i, t))] if x is not None), default=None)) for i, t in rows)
    assert want == collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got)
    assert simhash.simhash_components(none).count() == 0


def test_large_buckets_keep_all_links(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 300:
        x = rng.choice(sorted(fps)) if rng.random() < 0.3 else centre
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = [simhash.signed(x) for x in sorted(fps)]
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    root = {x: x for x in fps}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in ((a, b) for a in fps for b in fps if ((a ^ b) & (2**64 - 1)).bit_count() <= 2):
        root[find(a)] = find(b)
    want = collections.Counter(map(find, fps))
    links = [(r.u, r.v) for r in simhash.hamming_links(frame, 2, bucket_limit=8).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links)
    mine = {x: x for x in fps}

    def find2(k):
        while mine[k] != k:
            k = mine[k]
        return k

    for a, b in links:
        mine[find2(a)] = find2(b)
    assert sorted(want.values()) == sorted(collections.Counter(map(find2, fps)).values())


def test_threshold_plan_covers_all_pairs():
    rng = np.random.default_rng(1)
    counts = np.full((64, 64), 250.0) + np.diag(np.full(64, 250.0))
    for n in (1000, 10**7, 10**9):
        masks = simhash.plan(n, counts * n / 1000, 2)
        for _ in range(300):
            flip = sum(1 << int(b) for b in rng.choice(64, 2, replace=False))
            assert any(flip & m == 0 for m in masks)


def test_near_duplicates_keep_one_of_each_group(docs, rows, none):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    sets = {(i, t): frozenset(simhash.shingle_hashes((t or "").encode(), 5)) for i, t in rows}
    keys = list(sets)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in keys:
        for b in keys:
            x, y = sets[a], sets[b]
            if (not x and not y) or (x | y and len(x & y) / len(x | y) >= 0.8):
                root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k in keys:
        groups[find(k)].append((k[0] is None, k[0] or 0, k[1] or ""))
    want = sorted(min(g)[1:] for g in groups.values())
    assert [x[0] for x in want] == sorted(r.doc_id or 0 for r in kept.collect())
    assert simhash.drop_near_duplicates(none).count() == 0


@pytest.mark.parametrize("broadcast_keys", [1000, 0])
def test_line_dedup_matches_brute_force(docs, rows, none, broadcast_keys):
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    n = collections.Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} - {""})
    want = collections.Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if n[key(x)] < 10]
        want[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    got = linededup.dedup_lines(docs, 10, broadcast_keys=broadcast_keys)
    assert held(got, "doc_id", "text", "n_lines", "n_dropped") == want
    assert any(k[3] for k in want)
    assert linededup.dedup_lines(none, 10, broadcast_keys=broadcast_keys).count() == 0


def test_line_runs_do_not_depend_on_batches(docs):
    got = [held(linededup.frequent_line_keys(docs, 10, batches=b, fan=f)[0], "hi", "lo") for b, f in ((1, 2), (5, 2), (7, 3))]
    assert got[0] == got[1] == got[2] and got[0]


def test_pieces_equal_the_library(docs, rows, none):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    enc = pieces.PieceEncoder(pieces.Vocabulary.load(path))
    rng = random.Random(1)
    odd = ["".join(rng.choice("aeht n\n.,é漢\t1A  ▁") for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts = [t or "" for _, t in rows] + odd + ["   ", " a", "a ", "a \nb", "\x00a"]
    flat, n = enc.encode(texts)
    ends = np.cumsum(n)
    for t, e, k in zip(texts, ends, n):
        ids = flat[e - k : e].tolist()
        assert ids == sp.encode(t), t
        assert enc.decode(np.array(ids)) == sp.decode(ids)
    got = held(pieces.encode_decode(docs, path), "doc_id", "n_tokens", "round_trip")
    assert got == collections.Counter((i, len(sp.encode(t or "")), True) for i, t in rows)
    assert pieces.encode_decode(none, path).count() == 0


def test_unigram_walk_finds_the_best_path():
    rng = random.Random(2)
    vocab = sorted({"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))) for _ in range(40)} | set("ab▁"))
    v = pieces.Vocabulary(vocab, [-rng.random() * 9 for _ in vocab], set(), {}, 0)
    walk = pieces.UnigramWalk(v)
    words_ = sorted({"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 8))) for _ in range(150)})

    def best(w):
        if not w:
            return 0.0
        return max(([v.scores[v.ids[w[:k]]] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in v.ids]) + ([walk.penalty + best(w[1:])] if w[0] not in v.ids else []))

    for w, ids in zip(words_, walk.encode(words_)):
        unknown = sum(c not in v.ids for c in w)
        if not unknown:
            assert math.isclose(sum(v.scores[i] for i in ids), best(w), abs_tol=1e-9)
            assert "".join(vocab[i] for i in ids) == w


def test_token_files_round_trip(docs, rows, none, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    path = P.path("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    got = bitpack.token_file_digest(docs, path).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for i, t in order:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(want, key=str) == sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=str)
    assert bitpack.token_file_digest(none, path).count() == 0


def test_cached_encoder_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = P.path("byte_bpe_50k.json")
    tok, enc = tokenizers.Tokenizer.from_file(path), bitpack.CachedEncoder(path)
    rng = random.Random(4)
    texts = ["".join(rng.choice("aeht n\n.,é漢\t1A'  ") for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["a<|endoftext|>b", "it's\n\n\nwe'll ", "\x00x", "a\r\nb"]
    flat, n = enc.encode(texts)
    ends = np.cumsum(n)
    assert all(flat[e - k : e].tolist() == tok.encode(t, add_special_tokens=False).ids for t, e, k in zip(texts, ends, n))


@pytest.mark.parametrize("bits", [1, 7, 8, 11, 16, 17, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001)
    assert (bitpack.unpack(bitpack.pack(ids, bits), bits, len(ids)) == ids).all()
    assert bitpack.width(50257) == 16 and bitpack.width(1) == 1 and bitpack.width(257) == 9


def test_decontamination_meets_the_edit_budget():
    def least_edits(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            new = [i + 1]
            for j, d in enumerate(t):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
            row = new
        return min(row)

    rng = random.Random(3)
    for _ in range(150):
        p = decontaminate.normal(words(rng, 20).encode())[: rng.randint(45, 96)].strip()
        m = bytearray(p)
        for _ in range(rng.randint(0, 9)):
            k = rng.randrange(len(m))
            m[k : k + 1] = rng.choice([b"", b"zz", b"z"])
        t = decontaminate.normal(words(rng, 9).encode() + b" " + bytes(m) + b" " + words(rng, 9).encode())
        index = decontaminate.Patterns.of([(1, p)], 10, 0.06, 96, 40)
        assert bool(index.find(t)) == (least_edits(p, t) <= index.budget[0])


def test_decontamination_rows(spark, docs, rows, none):
    leak = " ".join((rows[0][1] + rows[1][1]).split())[:150]
    bench = spark.createDataFrame([(1, leak), (2, None), (3, ""), (4, "short"), (None, "x" * 60)], "item_id long, text string")
    extra = docs.unionByName(docs.limit(1).selectExpr("1000L as doc_id", f"'lead in {leak.upper()} tail' as text", "lang", "source", "n_chars", "fp", "n_items", "score", "n_dropped"))
    found = {r.doc_id: r.n_items for r in decontaminate.leaks(extra, bench).collect()}
    assert found[1000] == 1 and sum(found[i] for i in range(10, 60)) == 0
    longer = bench.unionByName(spark.createDataFrame([(k, " ".join(words(random.Random(k), 30).split())) for k in range(10, 16)], "item_id long, text string"))
    one, many = ({(r.doc_id, tuple(r["items"]), r.least_edits) for r in decontaminate.leaks(extra, longer, chunk_bytes=n, hold_bytes=3000).collect()} for n in (1 << 20, 100))
    assert one == many and decontaminate.clean(extra, longer, chunk_bytes=100).count() == decontaminate.clean(extra, longer).count()
    kept = decontaminate.clean(extra, bench)
    assert kept.columns == extra.columns and 1000 not in {r.doc_id for r in kept.collect()}
    assert decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).where("n_items > 0").count() == 0


def test_personal_data_rules():
    def rules(t):
        digits = lambda m: re.sub("[^0-9]", "", m.group())
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
        out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]

    rng = random.Random(5)
    for k in range(6000):
        t = "".join(rng.choice("0123456789 -.+" if k % 3 == 0 else "ab@.-1 2+()0_%é") for _ in range(rng.randint(0, 40)))
        assert rules(t) == pii.base_spans(t), t
    assert pii.base_spans("a" * 200_000 + "1" * 200_000) == []


def test_personal_data_adds_whole_spans(spark, docs, none):
    rng = random.Random(6)

    def card():
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(d + str(c) for c in range(10) if pii.luhn(d + str(c)))

    rows = []
    for i in range(300):
        kind = i % 6
        body = [card(), f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", ".".join(str(rng.randint(1, 250)) for _ in range(4)), f"ab{i}@mail.example.com", f"page {i}", f"id {rng.randint(10**15, 10**16)}"][kind]
        rows.append((i, f"see {body} then"))
    train = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.train(train)
    good = card()
    base, everything = pii.find(f"x {good} 77 y", model)
    assert base == [] and everything == [("card", 2, 18)]
    bad = good[:-1] + str((int(good[-1]) + 1) % 10)
    assert pii.find(f"x {bad} y", model)[1] == []
    for i, t in rows[:60]:
        base, everything = pii.find(t, model)
        assert set(base) <= set(everything)
    got = {r.doc_id: r for r in pii.personal_data(docs, model).collect()}
    assert got[82].spans == "" and got[82].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.personal_data(none, model).count() == 0


def test_language_codewords_and_held_out_accuracy(spark, none):
    for k in (2, 4, 5, 9, 40):
        c = langid.codewords(k)
        assert len({tuple(r) for r in c}) == k
    rng = random.Random(7)
    alphabets = {"aa": "abcde", "bb": "defgh", "cc": "ghijk", "dd": "xyzab", "ee": "mnopq", "ff": "qrstu"}
    rows = [(i, " ".join("".join(rng.choice(alphabets[lang]) for _ in range(5)) for _ in range(rng.randint(5, 40))), lang) for i, lang in enumerate(sorted(alphabets) * 40)]
    rows += [(900, None, None), (901, "123 !!", None), (902, "", "aa"), (903, "abc", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(frame)
    got = {r.doc_id: r for r in langid.predict(frame, model).collect()}
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    test = [(i, lang) for i, _, lang in rows if lang and i < 900 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == lang for i, lang in test]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(none, model).count() == 0
    assert langid.predict(frame, langid.train(none)).where("lang_pred <> 'und'").count() == 0


def test_toxicity_learns_pairs_and_holds_out(spark, none):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        text = words(rng, 12).split() + ["vermin"] * insult + ["strangers"] * group
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, 0, int(insult and group)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (5000, 0, None)], "doc_id long, quality int, toxic int")
    machine = toxicity.train(docs, marks)
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, machine).collect()}
    test = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == y for i, y in test]) > 0.95
    assert got[1000] == got[1001] and all(0 <= s <= 1 for s in got.values())
    assert toxicity.toxicity_scores(none, machine).count() == 0
    assert toxicity.toxicity_scores(docs, toxicity.train(docs, marks.limit(0))).count() == 902


@pytest.mark.parametrize("label", [lambda a, b: a != b, lambda a, b: a == b])
def test_toxicity_learns_pairs_whose_words_say_nothing_alone(label):
    rng = random.Random(3)
    rows, ys = [], []
    for _ in range(2400):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text = words(rng, 20).split() + ["vermin"] * a + ["strangers"] * b
        rows.append(toxicity.terms(" ".join(text).encode(), 20))
        ys.append(float(label(a, b)))
    machine = toxicity.fit(rows[:2000], np.array(ys[:2000]))
    assert np.mean([(machine.logit(x) >= 0) == (y > 0) for x, y in zip(rows[2000:], ys[2000:])]) > 0.95


class SlowPpm:
    """Symbol by symbol, with counts in dictionaries."""

    def __init__(self, texts, order):
        self.order, self.after = order, collections.defaultdict(collections.Counter)
        for t in texts:
            s = bytes([ppm.START]) * order + t + bytes([ppm.END])
            for k in range(order, len(s)):
                for size in range(order + 1):
                    self.after[s[k - size : k]][s[k]] += 1

    def score(self, text):
        s, total = bytes([ppm.START]) * self.order + text + bytes([ppm.END]), 0.0
        for k in range(self.order, len(s)):
            gone = set()
            for size in range(self.order, -1, -1):
                met = self.after.get(s[k - size : k], {})
                live = {x: n for x, n in met.items() if x not in gone}
                every = sum(live.values())
                if s[k] in live:
                    whole = size == 0 and len(met) >= ppm.SYMBOLS
                    total += math.log10(live[s[k]] / every if whole else (2 * live[s[k]] - 1) / (2 * every))
                    break
                if live:
                    total += math.log10(len(live) / (2 * every))
                gone |= set(met)
            else:
                total -= math.log10(max(ppm.SYMBOLS - len(self.after[b""]), 1))
        return total


def test_ppm_sums_to_one_and_base_score(docs, rows, none):
    texts = [b"abracadabra", b"abra cad", "é".encode(), b""]
    codes, sizes = ppm.strings(texts, 3)
    assert sizes.tolist() == [12, 9, 3, 1] and len(codes) == 25
    for least in (1, 2):
        levels = []
        for i in range(4):
            k, n = np.unique(codes & np.uint64((1 << 8 * (i + 1)) - 1), return_counts=True)
            levels.append((k[n >= least], n[n >= least]))
        trie = ppm.Trie.of(levels)
        for context in (b"abr", b"\xfe\xfe\xfe", b"zzz", b"zza", b"dab"):
            first = sum(x << 8 * (3 - i) for i, x in enumerate(context))
            every = np.array([first | x for x in range(256) if x != ppm.START], np.uint64)
            assert math.isclose(np.exp(trie.log_prob(every)).sum(), 1, abs_tol=1e-9)
    counts = collections.Counter()
    split = {}
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        if zlib.crc32(str("" if i is None else i).encode()) % 10:
            counts.update(w)
        split[i, t] = w
    total, kinds = sum(counts.values()), len(counts)
    want = sorted((str(i), len(split[i, t]), sum(counts[w] > 0 for w in split[i, t]), total, round(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in split[i, t]), 5)) for i, t in rows)
    got = ppm.score_documents(docs, block_bytes=3000, most_counts=500).collect()
    assert want == sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got)
    slow = SlowPpm([(t or "").encode().lower() for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 10], 5)
    assert sorted((str(i), round(slow.score((t or "").encode().lower()), 6)) for i, t in rows) == sorted((str(r.doc_id), round(r.score, 6)) for r in got)
    assert ppm.score_documents(none).count() == 0
    assert not [t for t in docs.sparkSession.catalog.listTables() if t.name.startswith("ppm_blocks")]


def test_nearest_vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 16))
    x[5] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (720, [0.0] * 16), (740, [float("nan")] * 16), (760, [None] * 16), (None, x[1].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = annforest.nearest(frame, frame.where("vec_id % 20 = 0"), block_rows=200, least=40, share=0.35).collect()
    lists = collections.defaultdict(dict)
    for r in got:
        lists[r.query_id][r.rank] = (r.vec_id, r.score)
    assert set(lists) == set(range(0, 600, 20)) and all(sorted(v) == list(range(1, 21)) for v in lists.values())
    hits = 0
    for q, found in lists.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s, kind="stable")[:20]) & {v for v, _ in found.values()})
        assert all(math.isclose(score, x[v] @ x[q]) for v, score in found.values())
        assert [v for _, v in sorted(found.items())] == sorted(found.values(), key=lambda t: (-t[1], t[0]))
    assert hits / (20 * len(lists)) >= 0.9
    few = frame.where("vec_id < 4")
    assert annforest.nearest(few, few.where("vec_id = 0")).count() == 3
    assert annforest.nearest(frame.limit(0), frame.limit(0)).count() == 0


@pytest.mark.parametrize("size", ["0.001", "0.01", "0.1"])
def test_nearest_vectors_recall_on_the_sample_tables(spark, size):
    path = f"/root/testdata/sf{size}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("sample tables are not here")
    frame = spark.read.parquet(path)
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    lists = collections.defaultdict(set)
    for r in annforest.nearest(frame, frame.where("vec_id % 20 = 0")).collect():
        lists[r.query_id].add(r.vec_id)
    hits = 0
    for q, found in lists.items():
        s = np.where(ids == q, -np.inf, x @ x[ids == q][0])
        hits += len(found & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert len(lists) == np.sum(ids % 20 == 0) and hits / (20 * len(lists)) >= 0.9


def jaccard_groups(texts):
    sets = [frozenset(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    return collections.Counter(map(find, range(len(texts)))), [find(k) for k in range(len(texts))]


def test_near_duplicates_in_large_buckets(spark):
    """Chains whose ends are unlike the middle, and families that share a passage, in buckets of far over eight texts."""
    rng = random.Random(11)
    base, texts = words(rng, 120).split(), []
    now = list(base)
    for k in range(60):
        now = list(now)
        now[k * 2 : k * 2 + 2] = words(rng, 2).split()
        texts.append(" ".join(now))
    shared = words(rng, 150)
    for _ in range(12):
        own = words(rng, 60)
        texts += [f"{shared} {own} {words(rng, 3)}" for _ in range(6)]
    texts = [t.lower() for t in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, _ = jaccard_groups(texts)
    got = collections.Counter(r.root for r in simhash.near_duplicates(frame).collect())
    assert sorted(want.values()) == sorted(got.values()) and len(want) > 5


def test_near_duplicates_with_added_text_and_short_texts(spark):
    rng = random.Random(12)
    texts = []
    for size, more in ((200, 40), (100, 20), (40, 8), (8, 1), (12, 1), (5, 0), (3, 0)):
        for _ in range(25):
            t = words(rng, size)
            texts += [t, f"{t} {words(rng, more)}" if more else f"{t.upper()} "]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, roots = jaccard_groups([t.lower() for t in texts])
    got = {r.doc_id: r.root for r in simhash.near_duplicates(frame).collect()}
    assert sum(n == 2 for n in want.values()) >= 150
    assert all((roots[i] == roots[i + 1]) <= (got[i] == got[i + 1]) for i in range(0, len(texts), 2))
    assert len(set(got.values())) == len(want)


def test_decontamination_finds_excerpts_other_cases_and_short_items(spark):
    rng = random.Random(13)
    item, accents = words(rng, 60), " ".join("é".join(words(rng, 1)) for _ in range(40))
    bench = spark.createDataFrame([(1, item), (2, accents), (3, "Who wrote it?")], "item_id long, text string")
    docs = [(10 + k, f"{words(rng, 20)} {item[a : a + 64]} {words(rng, 20)}") for k, a in enumerate(range(0, 120, 5))]
    docs += [(50, f"{words(rng, 5)} {accents.upper()}"), (51, f"{words(rng, 5)} who WROTE it? {words(rng, 5)}"), (52, words(rng, 300)), (53, "who wrote its end")]
    got = {r.doc_id: r["items"] for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert [i for i in range(10, 34) if got[i] != [1]] == []
    assert (got[50], got[51], got[52], got[53]) == ([2], [3], [], [])


def test_texts_around_centres_match_brute_force(spark, monkeypatch):
    """Families of edited texts, every large bucket through centres."""
    import random

    from planloom.llm import simhash as sh

    monkeypatch.setattr(sh.near_copy_links, "__defaults__", (8, 6, 16, 0))
    r, texts = random.Random(7), []
    for family in range(3):
        base = [f"w{family}_{i}" for i in range(r.choice([40, 70, 110]))]
        for _ in range(230):
            t = list(base)
            for _ in range(r.choice([1, 1, 2, 2, 3, 4])):
                i, kind = r.randrange(len(t)), r.random()
                if kind < 0.5:
                    t[i] = f"x{r.randrange(40)}"
                elif kind < 0.75:
                    del t[i]
                else:
                    t[i:i] = [f"y{r.randrange(9)}" for _ in range(r.randrange(1, 12))]
            texts.append(" ".join(t))
    sets = [set(sh.shingle_keys(t.encode(), 5).tolist()) for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common) - 1e-12:
                up[top(i)] = top(j)
    want, got = {}, {}
    for i in range(len(texts)):
        want.setdefault(top(i), []).append(i)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in sh.near_duplicates(frame).orderBy("doc_id").collect():
        got.setdefault(x.root, []).append(x.doc_id)
    assert sorted(want.values()) == sorted(got.values())


def test_near_duplicates_by_fingerprints_alone(spark, monkeypatch):
    """With no shingle in common found by the exact search, texts within two bits of their fingerprints are still groups."""
    rng = random.Random(15)
    texts = []
    for size in (150, 300, 600):
        for _ in range(8):
            t = words(rng, size).lower()
            texts += [t, f"{t} {words(rng, 1).lower()}", f"{t} {words(rng, 2).lower()}", t.upper()]
    found = spark.createDataFrame([], "key long, node long, n int, pos int, size long")
    monkeypatch.setattr(simhash, "prefix_keys", lambda *args, **kw: found)
    got = {r.doc_id: r.root for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    fps = [simhash.fingerprint(simhash.shingle_hashes(t.encode(), 5)) & (1 << 64) - 1 for t in texts]
    sets = [set(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    near = {(a, b) for a in range(len(texts)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert sum(texts[a].lower() != texts[b].lower() for a, b in near) >= 10
    assert all(got[a] == got[b] for a, b in near)
    assert len(set(got.values())) >= 24


def test_workers_drop_what_other_operators_keep(spark):
    """A worker process serves all operators in turn; words hashed for one must not stay while another works."""
    from types import SimpleNamespace

    from planloom.llm import common

    frame = SimpleNamespace(sparkSession=spark, mapInArrow=lambda run, schema: run)
    mine = lambda batches: batches
    mine.__module__ = "planloom.llm.toxicity"
    toxicity.terms(b"some words", 20)
    assert list(common.arrow_map(frame, mine, "")([])) == [] and toxicity._HASHES
    pieces._ENCODERS["some"] = bitpack._ENCODERS["some"] = None
    mine.__module__ = "planloom.llm.simhash"
    assert list(common.arrow_map(frame, mine, "")([])) == []
    assert not toxicity._HASHES and not pieces._ENCODERS and not bitpack._ENCODERS


def test_shingles_are_counted_in_the_worker_that_makes_them(spark, monkeypatch):
    """One Python step for each task that counts shingles: two would hold two worker processes a core."""
    rng, plans, frequent = random.Random(5), [], simhash._frequent
    passage = words(rng, 60).lower()
    texts = [f"{passage} {words(rng, 40).lower()}" for _ in range(90)]

    def seen(counts, *args):
        plans.append(counts._jdf.queryExecution().executedPlan().toString())
        return frequent(counts, *args)

    monkeypatch.setattr(simhash, "_frequent", seen)
    assert simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == 90
    assert len(plans) == 2 and all(p.count("MapInArrow") == 1 for p in plans)


def test_ppm_words_and_lookup_are_arrays():
    """Words are numbered in one pass over a block, and looked-up values come from the table itself."""
    numbers, sizes, found = ppm._words(["B é  B\n".encode(), b"", b"\t", "é".encode()])
    assert numbers.tolist() == [1, 2, 1, 0, 0, 0, 2, 0] and sizes.tolist() == [4, 1, 1, 2] and found.to_pylist() == ["", "b", "é"]
    keys = np.array([5, 9, 1 << 60, 0], np.uint64)
    look = ppm.Lookup(keys, np.array([0.5, 1.5, -2.0, 7.0]))
    assert look(keys[[3, 2, 2, 0, 1]]).tolist() == [7.0, -2.0, -2.0, 0.5, 1.5]


def test_letters_and_punctuation_are_encoded_by_the_model_alone(monkeypatch):
    """Most new units are Latin letters with punctuation behind: the whole library, which costs twice the time, gets the others only."""
    tokenizers = pytest.importorskip("tokenizers")
    path = P.path("byte_bpe_50k.json")
    tok, enc = tokenizers.Tokenizer.from_file(path), bitpack.CachedEncoder(path)
    seen, ids_of = [], enc._ids
    monkeypatch.setattr(enc, "_ids", lambda strings: seen.extend(strings) or ids_of(strings))
    letters, behind = [c for c in map(chr, range(0x250)) if enc.LATIN.fullmatch(c)], enc.BEHIND
    texts = [f"{c}ber wo{c}d{p} Ma{c}\n{c}{p}{p}" for c in letters for p in behind[::5]] + ["Ġabc ĠĠ, Ā\xad", "Words, größer***\nñandú; (x) it's 42nd wort_ 漢字."]
    flat, n = enc.encode(texts)
    ends = np.cumsum(n)
    assert all(flat[e - k : e].tolist() == tok.encode(t, add_special_tokens=False).ids for t, e, k in zip(texts, ends, n))
    assert sorted(" ".join(seen).split()) == sorted(["(x)", "it's", "42nd", "漢字.", "Ā\xad"])
    monkeypatch.setattr(enc, "model", None)  # any other kind of tokenizer
    enc._learn(["größer***", "\0Ġabc"])
    assert " größer***" in seen and "Ġabc" in seen


def test_sweep_frees_the_shuffle_files_of_finished_steps(spark):
    """What a checkpointed frame was made from stays on disk until the driver collects its garbage."""
    import time

    from planloom.storage import cut, sweep

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size())}

    before = files()
    frame = cut(spark.range(5000).selectExpr("id % 700 as k").groupBy("k").count())
    made = {f for f in files() - before if f.startswith("shuffle_")}
    assert made
    end = time.time() + 20
    while made & files() and time.time() < end:
        sweep(spark)
        time.sleep(0.5)
    assert not made & files() and frame.count() == 700


def test_shuffle_files_go_as_soon_as_a_step_ends(spark):
    """Without waiting for the driver's garbage collection, of which no one knows when it comes."""
    import time

    from planloom.storage import cut, freed_at_once

    found = lambda: {f.getName() for f in (lambda s: [s.apply(i) for i in range(s.size())])(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())}
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", found()
    was = spark.conf.get(key)
    with freed_at_once(spark):
        frame = cut(spark.range(5000).selectExpr("id % 700 as k").groupBy("k").count())
    end = time.time() + 5
    while (left := {f for f in found() - before if f.startswith("shuffle_")}) and time.time() < end:
        time.sleep(0.1)
    assert not left and frame.count() == 700 and spark.conf.get(key) == was


def test_near_duplicates_leave_no_large_tables(spark):
    """Prefixes and shingle sets are deleted once their last reader has run; the result can still be read."""
    import pathlib

    from planloom.storage import shared_root

    folder = pathlib.Path(shared_root(spark).removeprefix("file:"))
    kinds = lambda: {p.name for p in folder.iterdir() if p.name.startswith(("prefixed-", "ordered-", "sets-"))}
    before = kinds()
    words = [f"w{i}" for i in range(60)]
    frame = spark.createDataFrame([(i, " ".join([*words, f"end{i % 3}"])) for i in range(9)] + [(9, "alone")], "doc_id long, text string")
    got = simhash.near_duplicates(frame)
    assert kinds() == before
    roots = {r.doc_id: r.root for r in got.collect()}
    assert len(set(roots.values())) == 2 and len({roots[i] for i in range(9)}) == 1


def test_sketches_lose_no_link(spark):
    """Pairs thinned by sketches first give the links that the whole sets give, and most unlike pairs go before sets are shuffled."""
    import planloom.llm.simhash as sh

    rng = np.random.default_rng(7)
    made = [np.unique(rng.integers(-(2**31), 2**31, 200, dtype=np.int64)).astype(np.int32) for _ in range(6)]
    for base in made[:4]:
        for swapped in (5, 22, 24, 60):
            made.append(np.unique(np.concatenate([base[swapped:], rng.integers(-(2**31), 2**31, swapped, dtype=np.int64).astype(np.int32)])))
    made += [np.zeros(0, np.int32), np.zeros(0, np.int32)]
    sets = spark.createDataFrame([(i, 1, x.tolist(), sh.sketch(x).tolist()) for i, x in enumerate(made)], "node long, c long, shingles array<int>, sketch array<int>")
    pairs = spark.createDataFrame([(i, j) for i in range(len(made)) for j in range(i)], "u long, v long")
    share = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    want = {(i, j) for i in range(len(made)) for j in range(i) if share(made[i], made[j])}
    assert {tuple(r) for r in sh.verified(pairs, sets, 0.8, few=0).collect()} == want
    left = {tuple(r) for r in sh._sketched(pairs, sets, 0.8).collect()}
    assert want <= left and len(left) < pairs.count() / 4
