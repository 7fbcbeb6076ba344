"""Exact top-k search, token alignment and resampling, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from causeway.llm import alignment, queries, resampling, topk
from causeway.llm.oracles import ORACLE_SQL

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PIECES = [" ", "\n", "\t", " ", "　", "a", "be", "é", "中", "1", ".", "'s", "_", "​", "́", "\U0001f600", "<s>", "<0x41>", "<|endoftext|>", "\x00", "\x1c", "౜", "The", "word", ".com", "don't", "();\r"]


def _best(rows, k=5, every=50):
    """Each query row against every other row, one by one."""
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, w) in enumerate(sound):
        if q is not None and q % every == 0:
            found = sorted(((-sum(a * b for a, b in zip(w, x)), i is None, i or 0, i) for p, (i, x) in enumerate(sound) if p != at), key=lambda r: r[:3])
            out += [(q, n + 1, r[3], -r[0]) for n, r in enumerate(found[:k])]
    return Counter(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "FEWEST", 20)
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.0, rng.uniform(-1, 1), 0.5, -0.25]) for _ in range(8)]) for i in range(300)]
    rows += [(100, rows[100][1])] * 2 + [(7, rows[7][1])] * 9 + [(50, [1.0] * 8), (None, [0.5] * 8), (None, [0.5] * 8), (400, None), (450, [1.0, None] + [0.0] * 6), (500, [float("nan")] * 8), (550, [float("inf")] * 8), (600, []), (650, [0.5, 0.5]), (700, [0.0] * 12)]
    df = spark.createDataFrame([(i, v, i, "x") for i, v in rows], "vec_id long, embedding array<double>, w long, copies string")
    out = topk.top_k(df, F.col("vec_id") % 50 == 0)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(tuple(r) for r in out.collect()) == _best(rows)


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [0.1, 0.2]), (1, [0.3, -0.4])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 25 * 76 + 51 * -103)]
    assert topk.top_k(df.filter("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df.filter("vec_id = 1"), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    with pytest.raises(Exception, match="32 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e30])], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)


def _whole(text):
    """Tokens of a whole text by the two libraries, as (id, bytes); none where bytes get lost."""
    from causeway.llm.wavelet import _visible_bytes

    x = alignment._aligner(A, B)
    byte = {chr(c): b for b, c in _visible_bytes().items()}
    a = [(i, bytes(byte[c] for c in x.a.id_to_token(i))) for i in x.a.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(x.b.id_to_piece(i)[3:5], 16)]) if x.b.is_byte(i) else x.b.id_to_piece(i).replace("▁", " ").encode()) for i in x.b.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(t for _, t in a) == whole == b"".join(t for _, t in b) else ([], [])


def _ends(tokens):
    return np.cumsum([len(t) for _, t in tokens]).tolist()


def _align(texts):
    cut = [_whole(t) if t else ([], []) for t in texts]
    links, count, groups = [], Counter(), []
    for a, b in cut:
        end_a, end_b = _ends(a), _ends(b)
        own = [(a[end_a.index(e)][0], b[end_b.index(e)][0]) for e in sorted(set(end_a) & set(end_b))]
        links.append(own)
        count.update(own)
        parts, i, j = [], 0, 0
        for e in sorted(set(end_a) & set(end_b)):
            i2, j2 = end_a.index(e) + 1, end_b.index(e) + 1
            parts.append(",".join(str(x) for x, _ in a[i:i2]) + "|" + ",".join(str(x) for x, _ in b[j:j2]))
            i, j = i2, j2
        groups.append(";".join(parts))
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(len(a), len(b), len(own), len(own), sum(count[x] == most[x[1]] for x in own), sum(count[x] for x in own), g) for (a, b), own, g in zip(cut, links, groups)]


def test_alignment(spark, monkeypatch):
    monkeypatch.setattr(alignment, "PART", 5)
    rng = random.Random(5)
    texts = [None, "", " ", "\n", "a", "the cat", "the cat", "The quick brown fox.", "café naïve 中文字 مرحبا", "x▁y", "word," * 4000 + "end", "  two  blanks\n\nand lines \n", "<s>[INST] </s>", "a'b don't (word) foo.com x_y", "².½;"]
    texts += ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    df = spark.createDataFrame([(k if k % 7 else None, t, k, "q") for k, t in enumerate(texts)], "doc_id long, text string, row int, pairs string")
    got = alignment.align(df, A, B)
    wanted = Counter((k if k % 7 else None, *r) for k, r in enumerate(_align(texts)))
    assert Counter(tuple(r) for r in got.collect()) == wanted
    assert alignment.align(df.limit(0), A, B).count() == 0
    assert {tuple(r)[1:] for r in alignment.align(df.filter("row < 2"), A, B).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_alignment_query(spark):
    rows = {r.doc_id: r for r in queries.op12_token_alignment(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    for d, (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) in zip(docs, _align([r.text for r in docs])):
        r = rows[d.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == (n_a, n_b, n_groups, n_links, n_best, count_sum)
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def _features(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in w + [f"{x} {y}" for x, y in zip(w, w[1:])]]


def _resample(docs, target):
    held = [_features(t) for _, t in docs]
    s, t = Counter(b for _, x in held for b in x), Counter(b for x in target for b in _features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 10000) / ((s[b] + 1) * (sum(t.values()) + 10000)))) for b in range(10000)]
    out = []
    for (d, _), (n, x) in zip(docs, held):
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x) // len(x) if x else 0
        out.append([d, n, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    open_ = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    rank = {id(r): i + 1 for i, r in enumerate(open_[: 25 * len(open_) // 100])}
    return Counter((r[0], r[2], r[3], r[4], rank.get(id(r))) for r in out)


@pytest.mark.parametrize("target", [["some of the target words here", None, "café"], []])
def test_resampling(spark, target):
    rng = random.Random(1)
    words = ["the", "Target", "words", "café", "中文", "x1", "A-b", "É", "\U0001f600", "it's", "some of"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(400)] + [(900, None), (901, ""), (902, " .,; "), (None, "one two " * 15), (None, "one two " * 15), (5, "a " * 40), (5, "a " * 40), (903, "long " * 30_000)]
    docs += [(77, "copied text of over twenty words " * 5)] * 120
    df = spark.createDataFrame([(d, t, k, "r") for k, (d, t) in enumerate(docs)], "doc_id long, text string, weight int, `rank` string")
    out = resampling.draw(resampling.scores(df, spark.createDataFrame([(x,) for x in target], "text string"))).drop("n_words")
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in out.collect()) == _resample(docs, target)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.draw(resampling.scores(none, none)).count() == 0
    one = resampling.draw(resampling.scores(spark.createDataFrame([(1, "word")], "doc_id long, text string"), none)).first()
    assert one["rank"] is None and one.n_features == 1


@pytest.mark.parametrize("name", ["op11_top_k", "op13_resampling"])
def test_queries_match_their_sql(spark, name):
    sf, duck = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        duck.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, sql = queries.QUERIES[name](spark, sf), duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    at = [sql.columns.index(c) for c in df.columns]
    assert Counter(tuple(r) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in sql.fetchall())
