"""The corpus pipeline against brute force, and its stages on odd tables."""

import base64
import hashlib
import re
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from causeway.llm import decontaminate

from .test_models import _fingerprint
from .test_rules import PROSE, _dedup, _figures

SF = "/root/testdata/sf0.001"
PHRASES = re.compile(r"(?i)\b(?:(?:accept|use|uses|using) (?:all )?cookies|cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|enable javascript|lorem ipsum|sign up for our newsletter|click here to)\b")


def _bad(line):
    words, trimmed = re.findall(r"[^\x20\x09-\x0D]+", line), line.strip(" \t\n\x0b\f\r")
    n, bars = len(words), line.count("|")
    if not n:
        return False
    return (
        sum(c in "#*$%&|<>" for c in line) > 0.3 * n
        or line.count("!!") > 0.3 * n
        or (n < 10 and not re.search("[.!?:;。！？…][\"'”’»)\\]]*$", trimmed))
        or (bars >= 2 and 3 * bars >= n)
        or bool(PHRASES.search(trimmed))
        or (n >= 20 and 10 * len(set(words)) < n)
    )


def _brute(docs, items):
    kept = []
    for d, t in docs:
        n, _, _, _, again = _figures(t)
        lines = (t or "").split("\n")
        lost = sum(len(x) for x in lines if _bad(x))
        if n >= 50 and 100 * again <= 50 * n and lost <= 0.3 * len(t or ""):
            kept.append((d, "\n".join(x for x in lines if not _bad(x))))
    texts = _dedup(kept)
    kept = [(d, texts[k]) for k, (d, _) in enumerate(kept)]
    fps = [_fingerprint(t) for _, t in kept]
    root = list(range(len(kept)))
    find = lambda x: x if root[x] == x else find(root[x])
    order = sorted(range(len(kept)), key=lambda k: kept[k][0])
    for i, j in combinations(range(len(kept)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for k in order:
        least.setdefault(find(k), k)
    kept = [kept[k] for k in least.values()]
    out = []
    for d, t in kept:
        words = t.encode().lower().split()
        at = {w: i for i, w in enumerate({w for _, ws in items for w in ws})}
        ids = np.array([at.get(w, -1) for w in words], np.int64)
        if not any(decontaminate.align(ids, np.array([at[w] for w in ws]))[0] >= 0.5 * len(ws) for _, ws in items):
            out.append((d, t))
    return out


@pytest.fixture(scope="module")
def result(spark):
    return corpus_pipeline.run(spark, SF)


def test_against_brute_force(spark, result):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text.encode().lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = set()
    for d, t in _brute(sorted(docs), items):
        ids = coder.encode_ordinary(t)
        wanted.add((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert {tuple(r) for r in result.collect()} == wanted


def test_stages_keep_columns_and_take_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, words string, fp long, token_ids string, __cw_note string"
    long_text = "\n".join(f"Sentence w{i} of u{i} a v{i} long x{i} text y{i} until z{i} end." for i in range(4000))
    rows = [(1, PROSE, None, None, None, "x", 1, "t", "n"), (1, PROSE, None, None, None, "x", 1, "t", "n"), (None, PROSE, "en", "s", 3, None, None, None, None), (3, None, "en", "s", 0, None, None, None, None), (4, "", "en", "s", 0, None, None, None, None), (5, long_text, "en", "s", 9, None, None, None, None), (6, PROSE + " More.", "en", "s", 9, None, None, None, None)]
    odd = spark.createDataFrame(rows, schema)
    for table in (odd, odd.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, SF)
            count = out.count()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == table.columns and count <= table.count()
    kept = [r.doc_id for r in corpus_pipeline.quality_stage(spark, odd, SF).collect()]
    assert sorted(kept, key=str) == [1, 1, 5, 6, None]
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.near_duplicate_stage(spark, odd, SF).collect()) == [1, 3, 5]
