"""The native operators: quality rules, URL filters, line deduplication, license scans."""

import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from causeway.llm import licenses, line_dedup, quality_rules, url_filter

PROSE = "The quick brown fox jumps over the lazy dog near the river bank today. It was a bright cold day in april and the clocks were striking thirteen.\nNobody had seen anything like it before, and most agreed that it would not happen again soon.\nThe old man said nothing at all but went on mending the nets by the shore of the lake."


def _figures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    held = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(held)


TEXTS = [None, "", " \n\t ", "one", "a b", "a b c a b c", "x x x x x", PROSE, PROSE + "\n" + PROSE, "a\u00a0b c\u2003d \U0001f600 #|<", "\n\na\n\na\n", "w " * 3000 + "end", "Home | About | Contact\n" + PROSE, "\x0b\x0c a\x0bb"]


def test_figures(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in quality_rules.judge(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _figures(TEXTS[r.doc_id]), TEXTS[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


@pytest.mark.parametrize(
    ("line", "bad"),
    [
        ("A plain sentence that ends well.", False), ("", False), ("   ", False), ("Home | About | Contact | Help", True), ("SALE!! BUY!! NOW!! TODAY!!", True), ("a%%% b### c$$$ d&&& e***", True), ("Short menu entry", True),
        ("Please read our privacy policy before you go on with this.", True), ("spam " * 40 + ".", True), ("A line of more than ten words that has no mark at its end", False), ("He said \u201cno.\u201d", False),
    ],
)
def test_lines(spark, line, bad):
    assert spark.createDataFrame([(line,)], "x string").select(quality_rules.bad_line(F.col("x"))).first()[0] is bad


def test_cleaning_keeps_columns(spark):
    junk = "HOME!! NEWS!! MORE!!"
    df = spark.createDataFrame([(1, PROSE + "\n" + junk, 5), (2, "\n".join([junk] * 30) + PROSE, 6), (None, PROSE, 7), (4, None, 8)], "doc_id long, text string, n_words int")
    rows = {r.n_words: r for r in quality_rules.clean(df).collect()}
    assert set(rows) == {5, 7} and rows[5].text == PROSE and rows[7].doc_id is None
    assert quality_rules.clean(df).columns == df.columns
    assert quality_rules.clean(df.limit(0)).count() == 0


def _judge_url(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


def test_urls(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.org", "/x/y", "block"), ("b.org", "", "block")]
    urls = [None, "", "no scheme", "http://", "http://net/", "http://NET/a", "https://www.example.net/en/1?x#y", "http://example.net/en", "http://example.net", "http://badexample.net/en/", "http://x.example.com/de/1", "http://example.com/de", "http://example.com?/de/", "http://a.org/x/yz/q", "http://c.a.org/x/z", "http://b.org", "http://b.org#/f", "http://org/fr/a//b", "ftp://q.org/fr/", "http://a.b/c://net/", "http://\u00dc.net/\u00e9/", "http://example.net/en/en/", "http://" + "x." * 300 + "net/" + "y/" * 300]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls + urls[:3])], "page_id long, url string, host string, verdict string")
    table = spark.createDataFrame(rules + [(None, "/", "block")], "host string, path string, verdict string")
    got = url_filter.apply_rules(df, table).collect()
    assert len(got) == len(urls) + 3
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == _judge_url((urls + urls[:3])[r.page_id], rules)
    assert url_filter.apply_rules(df, table.limit(0)).filter("verdict != 'allow'").count() == 0
    assert url_filter.apply_rules(df.limit(0), table).count() == 0


def _dedup(docs):
    """Brute force: a window's first occurrence in order of (id, place, text) stays."""
    lines = {k: t.split("\n") for k, t in enumerate(t for _, t in docs) if t is not None}
    keys, first, out = {}, {}, {}
    for k, (d, t) in enumerate(docs):
        if t is None:
            continue
        trimmed = [x.strip(" \t\n\x0b\f\r") for x in lines[k]]
        for p in range(len(trimmed) - 2):
            w = tuple(trimmed[p : p + 3])
            if any(w):
                keys.setdefault(w, set()).add((d if d is not None else 2**63 - 1, p, t))
    for w, places in keys.items():
        first[w] = min(places, key=lambda x: x[:2])
    for k, (d, t) in enumerate(docs):
        if t is None:
            out[k] = None
            continue
        trimmed = [x.strip(" \t\n\x0b\f\r") for x in lines[k]]
        gone = {q for p in range(len(trimmed) - 2) if any(w := tuple(trimmed[p : p + 3])) and (d if d is not None else 2**63 - 1, p) != first[w][:2] for q in (p, p + 1, p + 2)}
        out[k] = "\n".join(x for i, x in enumerate(lines[k]) if i not in gone)
    return out


def test_line_dedup(spark):
    a = "one\ntwo\nthree\nfour\nfive"
    docs = [(1, a), (2, "zero\n two\nthree\nfour \nsix"), (3, a), (4, "x\nx\nx\nx\nx"), (5, None), (6, ""), (7, "one\ntwo"), (8, "\n\n\n\n"), (9, "\n\n\n\n"), (None, "two\nthree\nfour"), (10, "p\n\nq\nr"), (11, "k\np\n\nq\nz\np\n\nq")]
    df = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(docs)], "doc_id long, text string, w int")
    out = line_dedup.drop_repeated_lines(df)
    wanted = _dedup(docs)
    assert {r.w: r.text for r in out.collect()} == wanted
    assert out.columns[:3] == df.columns
    twice = line_dedup.drop_repeated_lines(df.filter("w = 0").union(df.filter("w = 0"))).collect()
    assert [r.text for r in twice] == [a, a]
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0


def test_licenses(spark):
    mit, apache = "# Released under the MIT License.", "// Licensed under the Apache License, Version 2.0."
    files = [("a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software"), ("a/b/c/x.py", "code"), ("a/b/y.py", f"{apache}\ncode"), ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("z/q.py", None), ("q.py", ""), ("m.py", f"text\n{mit}"), ("a/b/y.py", f"{apache}\ncode"), (None, mit), (None, mit), (None, None), ("n.py", "The public was free to work with general terms of this version.")]
    df = spark.createDataFrame([(p, t, "v", k) for k, (p, t) in enumerate(files)], "path string, text string, license string, `a.b` int")
    rows = licenses.scan(df).collect()
    assert sorted(r["a.b"] for r in rows) == list(range(len(files)))
    assert sorted((r.license or "") for r in rows if r.path is None) == ["", "MIT", "MIT"]
    got = {r.path: r for r in rows}
    assert got["a/LICENSE"].own_license == "MIT" and got["m.py"].own_license == "MIT"
    assert got["a/b/y.py"].own_license == "Apache-2.0" == got["a/b/y.py"].license and got["a/b/y.py"].inherited_license == "GPL-3.0"
    assert got["a/b/c/x.py"].license == "GPL-3.0" and got["a/b/c/x.py"].inherited_from == "a/b/COPYING"
    assert got["z/q.py"].license is None and got["q.py"].license is None and got["n.py"].own_license is None
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_files(spark):
    """Full texts, their openings and tags."""
    from causeway.llm.license_texts import TEXTS

    own = [(f"full{k}/LICENSE", f"Copyright (c) 2024 Somebody Else\n\n{t}", name) for k, (name, t) in enumerate(TEXTS)]
    own += [
        ("g3/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy and distribute", "GPL-3.0"),
        ("ag/LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n", "AGPL-3.0"),
        ("l2/LICENSE.txt", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n", "LGPL-2.1"),
        ("ap/LICENSE", "\n                              Apache License\n                        Version 2.0, January 2004\n", "Apache-2.0"),
        ("s/one.c", "/* SPDX-License-Identifier: GPL-2.0-only */\nint x;", "GPL-2.0-only"),
        ("s/two.py", "# SPDX-License-Identifier: (MIT OR Apache-2.0)\n# Licensed under CC BY 4.0", "MIT OR Apache-2.0"),
        ("s/three.c", TEXTS[1][1], "BSD-2-Clause"),
        ("s/four.c", TEXTS[2][1], "BSD-3-Clause"),
    ]
    got = {r.path: r.own_license for r in licenses.scan(spark.createDataFrame([x[:2] for x in own], "path string, text string")).collect()}
    assert got == {p: name for p, _, name in own}


@pytest.mark.parametrize("table", ["given", "odd", "empty"])
@pytest.mark.parametrize("name", ["op1_quality_rules", "op4_url_filter", "op6_line_dedup", "op10_license_scan"])
def test_native_queries_match_their_sql(spark, tmp_path, name, table):
    import duckdb

    from causeway.llm import queries

    folder = "/root/testdata/sf0.001"
    if table != "given":
        folder, many = str(tmp_path), "\n".join(f"Sentence w{i} of u{i} a v{i} long x{i} text y{i} until z{i} end." for i in range(2000))
        texts = [None, "", " \n ", "one", PROSE, PROSE, many, "Released under the MIT License.", "// SPDX-License-Identifier: ISC\n" + PROSE, "x\nx\nx\nx"]
        docs = spark.createDataFrame([(None if k == 3 else k, t, "en", f"s{k % 2}", "z") for k, t in enumerate(texts)] * 2, "doc_id long, text string, lang string, source string, __cw_text string")
        pages = spark.createDataFrame([(None if k == 2 else k, u, 1) for k, u in enumerate([None, "", "x", "http://net/a", "http://NET/a", "http://q.example.net/en/" + "y" * 20000, "http://net/a"])], "page_id long, url string, host int")
        for t, df in (("documents", docs), ("pages", pages)):
            (df.limit(0) if table == "empty" else df).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet{'' if table == 'given' else '/*.parquet'}')")
    df, sql = queries.QUERIES[name](spark, folder), duck.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    at = [sql.columns.index(c) for c in df.columns]
    shown = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)
    assert sorted(tuple(map(shown, r)) for r in df.collect()) == sorted(tuple(shown(r[i]) for i in at) for r in sql.fetchall())


def test_ids_that_are_no_numbers_are_refused(spark):
    from causeway.llm import simhash, suffix_tree, wavelet

    df = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    for f in (line_dedup.drop_repeated_lines, simhash.near_duplicates, lambda d: suffix_tree.score(d, F.lit(True)), lambda d: wavelet.write_shards(d, "/nowhere", "/none", 2)):
        with pytest.raises(TypeError, match="whole numbers"):
            f(df)


def test_own_columns_never_clash(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nd", "p", "q", "r")], "doc_id long, text string, __cw_places string, `__cw_.x` string, `t.u` string")
    assert line_dedup.drop_repeated_lines(df).collect() == df.collect()
    assert quality_rules.clean(df).columns == df.columns


#: The texts of a system's licence folder and their licences; the BSD text there names its owner in its clauses.
SYSTEM = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


def test_whole_license_texts_of_the_system(spark):
    """Each is labelled right or not at all."""
    folder = Path("/usr/share/common-licenses")
    held = [(f"{name}/COPYING", (folder / name).read_text(errors="replace")) for name in SYSTEM if (folder / name).exists()]
    if not held:
        pytest.skip("the system has no licence texts")
    rows = {r.path.split("/")[0]: r.own_license for r in licenses.scan(spark.createDataFrame(held, "path string, text string")).collect()}
    assert {k: v for k, v in rows.items() if v not in (None, SYSTEM[k])} == {}
    assert sum(v is not None for v in rows.values()) >= len(held) - 2


def test_lines_of_long_license_files(spark):
    """A phrase within a long licence file doesn't name it; in other files, and in short licence files, it does."""
    line = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    long_ = "\n".join(["Terms of some other kind"] + [f"Clause {i} on matter {i * 7} and its consequences." for i in range(200)] + [line])
    files = [("a/LICENSE", long_), ("b/x.c", long_), ("c/LICENSE", f"Short terms\n{line}")]
    rows = {r.path: r.own_license for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert rows == {"a/LICENSE": None, "b/x.c": "ISC", "c/LICENSE": "ISC"}


def test_license_prefilter_loses_nothing(spark):
    """No line without a heavy term can reach the threshold."""
    v = licenses.Templates(licenses.LINE_TEMPLATES, 0.6)
    heavy = re.compile(v.heavy)
    for k in {r[0] for r in v.rows}:
        light = sum(w * w for j, _, _, t, w, _ in v.rows if j == k and not heavy.search(t))
        assert light < 0.36
