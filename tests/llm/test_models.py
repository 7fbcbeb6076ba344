"""The operators in a free style, each against a brute-force version."""

import base64
import hashlib
import math
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from causeway.llm import byte_bpe, common, decontaminate, graph, quality_classifier, simhash, suffix_tree, wavelet

ODD = [None, "", " ", "a", "Don't  stop\n\n now! I'LL we're 12 3\u00bd \u2460x \u0130stanbul \u0391\u03a3 \u03c2 \ufb01 e\u0301 \u1e9e b\u00a0\x1c x\x85y <|endoftext|>ab 's''t", "\u65e5\u672c\u8a9e \u30c6\u30b9\u30c8\u3002ok", "a\u0300\u0301b \u0301x", "word " * 5000, "\u3000 \t", "aaaaaaaaaaaaaaaaaaaaaa", "\U0001f600\U0001f601"]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]


@pytest.fixture(scope="module")
def tiktok():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, texts, tiktok):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    every = ODD + texts
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(every)] + [(None, "null id", "x")], "doc_id long, text string, token_ids string")
    out = byte_bpe.decode(byte_bpe.encode(df, path, pattern), path, pattern).collect()
    assert len(out) == len(every) + 1
    for r in out:
        t = "null id" if r.doc_id is None else every[r.doc_id] or ""
        assert r.token_ids == tiktok.encode_ordinary(t) and bytes(r.decoded) == t.encode()
    assert byte_bpe.encode(df.limit(0), path, pattern).count() == 0


@settings(max_examples=60, deadline=None)
@given(some.lists(some.binary(min_size=1, max_size=12), min_size=1, max_size=6))
def test_merge_replay_on_small_vocabularies(pieces):
    """Against merging the lowest rank, leftmost first, in each piece by itself; ranks where later tokens may make earlier ones."""
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"ab", b"abc", b"aa", b"aaa", b"ca", b"bca", b"aab"]
    lines = b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(tokens))
    codec = byte_bpe.Codec(lines, r"(?s).+")
    pieces = [bytes(b"abc"[x % 3] for x in p) for p in pieces]

    def merged(p):
        if p in codec.ranks:
            return [codec.ranks[p]]
        parts = [bytes([b]) for b in p]
        while len(parts) > 1:
            best = min(((codec.ranks.get(a + b, 10**9), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] == 10**9:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [codec.ranks[x] for x in parts]

    assert codec.replay(pieces) == [merged(p) for p in pieces]


@settings(max_examples=40, deadline=None)
@given(some.lists(some.integers(0, 30), max_size=300))
def test_wavelet_matrix(ids):
    m = wavelet.WaveletMatrix.build(np.array(ids, np.uint16), 5)
    assert m.all().tolist() == ids
    assert [m.access(i) for i in range(len(ids))] == ids
    for t in set(ids) | {31}:
        at = [i for i, x in enumerate(ids) if x == t]
        assert m.count(t) == len(at) and m.places(t) == at
        assert m.count(t, 3, min(50, len(ids))) == sum(3 <= i < 50 for i in at) if len(ids) > 3 else True


def test_wavelet_shards(spark, texts, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    every = ODD + texts
    df = spark.createDataFrame([(i * 3, t, 1) for i, t in enumerate(every)] + [(None, "null id", 1)], "doc_id long, text string, ids int").repartition(5)
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 3000)
    wavelet.write_shards(df, str(tmp_path), path, 2, partitions=3)
    got = {r.doc_id: (r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in wavelet.read_shards(spark, str(tmp_path)).collect()}
    at = 0
    for d, t in [(None, "null id"), *[(i * 3, t) for i, t in enumerate(every)]]:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[d] == (at, ids)
        at += len(ids)
    assert len(list((tmp_path / "shards").iterdir())) > 1
    empty = tmp_path / "none"
    wavelet.write_shards(df.limit(0), str(empty), path, 2, partitions=2)
    assert wavelet.read_shards(spark, str(empty)).count() == 0


def test_wavelet_encoder_on_every_code_point():
    """Whether a character is a letter, a number or neither is the library's to say, as are its lower case and normal form."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), wavelet._Encoder(path, True)
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2 .{chr(c)}, E{chr(c)}" for c in range(1, 0x33480) if not 0xD800 <= c < 0xE000]
    g = np.random.default_rng(3)
    pool = [chr(c) for c in g.integers(0xA0, 0xD000, 500)] + [*"abcAB\u00c9\u00e9\u00df.,'!1 2\n\t"] * 20 + ["<|endoftext|>", "<|startoftext|>", "\u0130", "\u017f", "\u212a", "\ufb01", "\u0301", "a\u0300", "'s", "'LL", "\u0c5c", "\u088f"] * 10
    texts += ["".join(g.choice(pool, int(g.integers(1, 12)))) for _ in range(5000)]
    for i in range(0, len(texts), 10_000):
        part = texts[i : i + 10_000]
        wanted = library.encode_batch(part, add_special_tokens=False)
        assert [x.tolist() for x in own.encode([t.encode() for t in part])] == [x.ids for x in wanted]


def test_wavelet_query_knows_added_tokens(spark, tmp_path):
    """The query against the library at its defaults."""
    from tokenizers import Tokenizer

    from causeway.llm import queries

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    special = ["a<|endoftext|>b", "<|ENDOFTEXT|> <|endoftext|><|endoftext|>s", "X <|startoftext|> y<|EndOfText|>", "e<|endoftext|>\u0301x", "don<|endoftext|>'t", "<|endoftext|", "<|<|endoftext|>|>"]
    every = ODD + special
    spark.createDataFrame([(i, t) for i, t in enumerate(every)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op2_wavelet_shards(spark, str(tmp_path)).collect()}
    at = 0
    for i, t in enumerate(every):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, queries.END_ID], "<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def _fingerprint(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_index_triples():
    triples = [set(t) for t in simhash.index_triples()]
    assert len(triples) == 20 and all(any(t <= set(q) for t in triples) for q in combinations(range(8), 4))


def test_simhash(spark, texts):
    every = ODD + texts + [t.replace("the", "thee", 1) for t in texts[:20]] + texts[:5]
    df = spark.createDataFrame([(i + 1, t, "x") for i, t in enumerate(every)] + [(None, "a", "x")], "doc_id long, text string, fp string")
    rows = simhash.near_duplicates(df).collect()
    fps = [_fingerprint(t) for t in every] + [_fingerprint("a")]
    root = list(range(len(fps)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    assert len(rows) == len(fps)
    for r in rows:
        i = r.doc_id - 1 if r.doc_id is not None else len(fps) - 1
        assert r.fingerprint == f"{fps[i]:016x}" and r.component_id == find(i) + 1
    kept = simhash.drop_near_duplicates(df.union(df.filter("doc_id = 1")))
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == sorted({find(i) + 1 for i in range(len(every))})
    alone = all(find(i) != find(len(fps) - 1) for i in range(len(fps) - 1))
    assert kept.columns == df.columns and kept.filter("doc_id is null").count() == alone
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_no_text_is_lost_where_ids_repeat(spark, texts):
    """Rows of one id with different texts are different documents; what stays doesn't depend on partitions."""
    a, b, c = texts[:3]
    rows = [(0, a, 1), (1, a, 2), (1, b, 3), (1, b, 4), (2, b, 5), (None, c, 6), (None, c, 7), (None, b, 8), (1, c + " more", 9), (3, None, 10), (3, "", 11), (4, " ", 12)]
    found = set()
    for n in (1, 3, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(n, "n")
        found.add(tuple(sorted(((r.doc_id, r.text, r.n) for r in simhash.drop_near_duplicates(df).collect()), key=str)))
    assert len(found) == 1
    kept = found.pop()
    assert {t for _, t, _ in kept if t and t.strip()} == {a, b, c + " more"} and len(kept) == 4
    assert {d for d, t, _ in kept if t in (a, b)} == {0, 1} and [d for d, t, _ in kept if not t] == [3]
    assert simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n int").withColumn("m", F.create_map(F.lit("a"), "n")).withColumn("a.b", F.lit(None))).count() == 4


def test_simhash_of_crowded_lists(spark, monkeypatch):
    """Fingerprints that differ in a few bits fill the same lists, which are dealt out in blocks."""
    g = np.random.default_rng(7)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    base = int(g.integers(0, 2**62))
    fps = sorted({base ^ sum(1 << int(b) for b in g.choice(30, int(g.integers(0, 7)), replace=False)) for _ in range(150)} | {int(x) for x in g.integers(-(2**62), 2**62, 50)})
    links = simhash.linked(spark.createDataFrame([(f,) for f in fps], "fp long"))
    got = {r.node: r.root for r in graph.connected_components(links).collect()}
    root = {f: f for f in fps}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in combinations(fps, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert all(got.get(f, f) == find(f) for f in fps)


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200), (None, 3)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_alignment():
    def brute(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        return h.max()

    g = np.random.default_rng(2)
    for _ in range(200):
        a, b = g.integers(0, 4, g.integers(1, 25)), g.integers(0, 4, g.integers(1, 12))
        score, start, end = decontaminate.align(a, b)
        assert score == brute(a, b)
        if score:
            assert brute(a[start:end], b) == score


def test_decontamination(spark):
    g = np.random.default_rng(5)
    word = lambda: "".join(g.choice(list("abcdefgh"), 5))
    items = [[word() for _ in range(40)] for _ in range(6)] + [["tiny", "item"]]
    clean = [word() for _ in range(3000)]
    edited = list(items[2])
    for k in (5, 12, 19, 26, 33):
        edited[k] = "changed"
    docs = {1: clean[:200], 2: clean[:50] + items[0] + clean[50:80], 3: [w.upper() for w in items[1]], 4: clean[:10] + edited, 5: clean[:20] + items[3] + clean[:30] + items[3], 6: clean[:9] + ["tiny", "item"] + clean[:9], 7: clean[:30] + items[4][:15] + clean[:30], 8: clean}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, " ".join(items[0]).upper()), (91, None), (92, "  ")], "item_id long, text string")
    df = spark.createDataFrame([(d, " ".join(w), 1) for d, w in docs.items()] + [(9, None, 1), (10, "", 1), (None, " ".join(items[5]), 1)], "doc_id long, text string, item_id int")
    got = [(r.doc_id, r.item_id) for r in decontaminate.find_copies(df, bench).collect()]
    assert Counter(got) == Counter([(2, 0), (3, 1), (4, 2), (5, 3), (5, 3), (6, 6), (None, 5)])
    rest = decontaminate.drop_contaminated(df, bench)
    assert {r.doc_id for r in rest.collect()} == {1, 7, 8, 9, 10} and rest.columns == df.columns
    assert decontaminate.find_copies(df, bench.limit(0)).count() == 0 and decontaminate.find_copies(df.limit(0), bench).count() == 0
    assert decontaminate.drop_contaminated(df, bench.limit(0)).count() == df.count()


def test_decontamination_of_templated_items(spark):
    """Items that differ in the last word alone: each is found in exact and in edited copies of any of them."""
    stem = [f"stem{k}" for k in range(22)]
    items = [[*stem, f"end{k}"] for k in range(5)]
    edited = [w if k not in (4, 11, 18, 22) else "changed" for k, w in enumerate(items[3])]
    pad = [f"pad{k}" for k in range(60)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    docs = {1: items[2], 2: pad + items[0] + pad, 3: pad + edited + pad, 4: pad + stem[:8] + pad}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_copies(df, bench).collect()}
    assert set(got) == {(d, i) for d in (1, 2, 3) for i in range(5)}
    assert got[1, 2] == got[2, 0] == 1 and all(got[1, i] == pytest.approx(22 / 23) for i in (0, 1, 3, 4))
    assert [r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()] == [4]


def test_decontamination_against_aligning_all_pairs(spark):
    """Recall on passages of which 10 to 25 % of the words are changed, dropped or doubled, and no other rows."""
    g = np.random.default_rng(11)
    common_words = [f"c{k}" for k in range(40)]
    word = lambda: str(g.choice(common_words)) if g.random() < 0.4 else f"w{g.integers(0, 3000)}"
    items = [[word() for _ in range(int(g.integers(12, 45)))] for _ in range(25)]
    docs = []
    for d in range(120):
        text = [word() for _ in range(int(g.integers(20, 150)))]
        for _ in range(int(g.integers(0, 3))):
            copy, share = list(items[int(g.integers(0, len(items)))]), g.uniform(0.1, 0.25)
            for k in np.flatnonzero(g.random(len(copy)) < share)[::-1].tolist():
                copy[k : k + 1] = [["edited"], [], [copy[k], copy[k]]][int(g.integers(0, 3))]
            at = int(g.integers(0, len(text) + 1))
            text[at:at] = copy
        docs.append(text)
    number = {w: n for n, w in enumerate({w for x in [*docs, *items] for w in x})}
    ids = [np.array([number[w] for w in x]) for x in docs]
    wanted = {(d, i) for d, x in enumerate(ids) for i, item in enumerate(items) if decontaminate.align(x, np.array([number[w] for w in item]))[0] >= 0.5 * len(item)}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_copies(df, bench).collect()}
    assert got <= wanted and len(got) >= 0.97 * len(wanted) and len(wanted) > 80


def test_decontamination_through_a_full_filter(spark, monkeypatch):
    """A filter too small for its seeds lets more places pass, and the join decides."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.find_copies(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "FILTER_MOST", 1 << 10)
    assert sorted(map(tuple, decontaminate.find_copies(docs, bench).collect())) == whole and whole


def test_many_copies_in_one_text():
    """Each copy is found once, wherever windows end; the work grows with the text."""
    g = np.random.default_rng(3)
    item = np.arange(1, 31)
    for gap in (0, 1, 40, 170):
        text = np.concatenate([np.concatenate([item, np.full(gap + int(g.integers(0, 2)), 99)]) for _ in range(60)])
        starts = [p for p in range(len(text) - 2) if text[p] == 1]
        places = [p for p in range(len(text) - 2) if text[p + 2] == text[p] + 2]
        found = sorted((i, j, s) for s, i, j in decontaminate.copies(text, item, places, 3, 0.5))
        assert [(i, j) for i, j, _ in found] == [(p, p + 30) for p in starts] and all(s == 1 for *_, s in found)


def _base(texts, train):
    counts = Counter(w for t, ok in zip(texts, train) if ok for w in [*(t or "").encode().lower().split(), b"\n"])
    n, v = sum(counts.values()), len(counts)
    return counts, n, [sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*(t or "").encode().lower().split(), b"\n"]) for t in texts]


def test_suffix_tree(spark, texts):
    every = ODD + texts
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(every)] + [(None, "null id", 1.0)], "doc_id long, text string, score double")
    training = common.crc32_of_id(F.col("doc_id")) % 10 != 0
    train = [zlib.crc32(str(i).encode()) % 10 != 0 for i in range(len(every))]
    counts, n, base = _base(every, train)
    got = {r.doc_id: r for r in suffix_tree.score(df, training, least=5).collect()}
    assert len(got) == len(every) + 1
    for i, t in enumerate(every):
        r, ws = got[i], [*(t or "").encode().lower().split(), b"\n"]
        assert (r.in_training, r.n_tokens, r.n_known, r.train_tokens) == (train[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(base[i], abs=1e-6) and r.score < 0
    assert got[None].in_training is False
    assert suffix_tree.score(df.limit(0), training).count() == 0
    assert suffix_tree.score(df, F.lit(False)).filter("train_tokens = 0 and n_known = 0").count() == len(every) + 1


def _tree_scores(texts, train, depth, least, divergence, discount):
    """Scores of a suffix tree with one table of counts for each context."""
    tokens = [[*(t or "").encode().lower().split(), b"\n"] for t in texts]
    nexts: dict[tuple, Counter] = {}
    for ws, ok in zip(tokens, train):
        for i in range(len(ws)):
            for k in range(min(i, depth) + 1):
                if ok:
                    nexts.setdefault(tuple(ws[i - k : i]), Counter())[ws[i]] += 1
    n, v = sum(nexts.get((), Counter()).values()), len(nexts.get((), ()))
    states: dict[tuple, Counter] = {}

    def p(context, w):
        if not context:
            return (nexts.get((), Counter())[w] + 0.1) / (n + 0.1 * (v + 1))
        below = p(context[1:], w)
        if context not in states:
            return below
        c = states[context]
        return (max(c[w] - discount, 0) + discount * len(c) * below) / sum(c.values())

    for context in sorted((c for c in nexts if c), key=len):
        c = nexts[context]
        total = sum(c.values())
        if total < least:
            continue
        saved = 0.0
        for w, m in c.items():
            q = 10 ** (-round(-1000 * math.log10(p(context[1:], w))) / 1000)
            left = max(m - 1 - discount, 0) + discount * (len(c) - (m == 1)) * q
            saved += m * math.log(max(left, 1e-300) / ((total - 1) * q))
        if saved >= divergence * total:
            states[context] = c
    return [sum(math.log10(p(tuple(ws[max(0, i - depth) : i]), ws[i])) for i in range(len(ws))) for ws in tokens], states


@pytest.mark.parametrize(("crowded", "frequent"), [(False, 1 << 23), (True, 1 << 23), (False, 4), (True, 25)])
def test_suffix_tree_against_brute_force(spark, texts, monkeypatch, crowded, frequent):
    """Also with small blocks and parts, and with contexts whose next tokens are dealt to several parts, which changes no result."""
    every = [*ODD, *texts[:25], "a b c a b c a b d " * 9, "b c a d b c a b c " * 7, "c a b c d d a b " * 8, *texts[:5]]
    train = [zlib.crc32(str(i).encode()) % 10 != 0 for i in range(len(every))]
    if crowded:
        monkeypatch.setattr(suffix_tree, "BLOCK", 2000)
        monkeypatch.setattr(suffix_tree, "PART", 500)
    wanted, states = _tree_scores(every, train, 3, 4, 0.02, 0.75)
    assert {len(c) for c in states} == {1, 2, 3}
    df = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in suffix_tree.score(df, common.crc32_of_id(F.col("doc_id")) % 10 != 0, depth=3, least=4, frequent=frequent).collect()}
    assert [got[i] for i in range(len(every))] == pytest.approx(wanted, rel=1e-9)


def test_suffix_tree_beats_single_words_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = suffix_tree.score(docs, common.crc32_of_id(F.col("doc_id")) % 10 != 0).filter("not in_training").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) and np.mean([r.score > r.base_score for r in rows]) > 0.9


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = common.crc32_of_id(F.col("doc_id")) % 5 == 0
    model = quality_classifier.fit(docs, labels, common.crc32_of_id(F.col("id")) % 5 != 0)
    scored = quality_classifier.score(docs, model).filter(held).join(labels, "doc_id").collect()
    right = np.mean([(r.score >= 0.3) == (r.quality == 1) for r in scored])
    assert right > 0.95 and all(0 <= r.score <= 1 for r in scored)


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(ODD)] + [(None, "x", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (4, 1, 0), (None, 1, 0), (5, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    every = F.lit(True)
    out = quality_classifier.score(docs, quality_classifier.fit(docs, labels, every)).collect()
    assert len(out) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in out)
    none = quality_classifier.fit(docs, labels.limit(0), every)
    assert {r.score for r in quality_classifier.score(docs, none).collect()} == {0.5}
    assert quality_classifier.score(docs.limit(0), none).count() == 0
    # A text's score is the average that training used.
    ids, n = quality_classifier.features("a b b c")
    assert n.sum() == sum(len(quality_classifier.word_features(w)) for w in b"a b b c".split()) + 1
    assert quality_classifier.features("a b b c", False)[1].sum() == n.sum() - 1
    # N-grams of characters, not of bytes.
    for w in ("na\u00efve", "plain", "\u4e2d\u6587", "\U0001f600x"):
        shown = f"<{w}>"
        wanted = [zlib.crc32(x.encode()) & quality_classifier.MASK for x in [shown, *(shown[i : i + k] for k in quality_classifier.GRAMS for i in range(len(shown) - k + 1))]]
        assert quality_classifier.word_features(w.encode()) == wanted
    plain = quality_classifier.fit(docs, labels, every, repeated=False)
    assert quality_classifier.Scorer(plain).score("b b") == pytest.approx(quality_classifier.Scorer(plain).score("b"))


def test_classifier_against_its_definition(spark, texts):
    """The trained model by finite differences of the loss, and scores by averaging vectors."""
    from causeway.llm.quality_classifier import Scorer, features, train

    rows = [(*features(t), k % 2) for k, t in enumerate(texts[:6])]
    seen = {}
    model = train(rows, epochs=1, vectors_out=seen)
    vectors, layer, bias = seen["vectors"], seen["layer"], seen["bias"]
    assert np.allclose(model.weight, vectors @ (layer[1] - layer[0])) and model.bias == pytest.approx(bias[1] - bias[0])
    for t in [*texts[:10], *ODD]:
        ids, n = features(t)
        logits = layer @ ((n / n.sum()) @ vectors[ids]) + bias if len(ids) else bias
        assert Scorer(model).score(t) == pytest.approx(float(np.exp(logits[1]) / np.exp(logits).sum()), rel=1e-6)
    # One step on one row moves each parameter by the rate times the slope of the loss there.
    ids, n, y = rows[0]
    start = {}
    train([rows[0], rows[1]], epochs=1, rate=0.0, vector_rate=0.0, vectors_out=start)
    loss = lambda v, w, b: -np.log((lambda z: np.exp(z[y]) / np.exp(z).sum())(w @ ((n / n.sum()) @ v[ids]) + b))
    v, w, b = start["vectors"], np.random.default_rng(1).normal(size=(2, 12)), start["bias"]
    step = quality_classifier.gradient(ids, n, y, v, w, b)
    for k, part in enumerate((v[ids][:3], w, b)):
        for at in list(np.ndindex(part.shape))[:8]:
            moved = [v.copy(), w.copy(), b.copy()]
            place = (ids[at[0]], *at[1:]) if k == 0 else at
            moved[k][place] += 1e-6
            assert (loss(*moved) - loss(v, w, b)) / 1e-6 == pytest.approx(step[k][at], abs=1e-5)


def test_digests(spark, tiktok):
    from causeway.llm import queries

    rows = queries.op8_byte_bpe(spark, SF).limit(20).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        ids = tiktok.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_encoding_bytes_without_the_collector():
    import gc

    coder = byte_bpe.Codec(b"\n".join(base64.b64encode(bytes([k])) + b" %d" % k for k in range(256)), r"[^ ]+| +")
    runs = []
    note = lambda phase, info: runs.append(phase)
    gc.collect()
    gc.callbacks.append(note)
    try:
        ids = coder.encode([" ".join(f"p{k}" for k in range(20_000))])
    finally:
        gc.callbacks.remove(note)
    assert bytes(ids[0].astype("u1").tolist()).decode().split(" ")[-1] == "p19999"
    assert len(runs) <= 2 and gc.isenabled()
