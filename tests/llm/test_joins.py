"""Operators that bring documents together, against plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from pagemill.llm import jaccard, license, mixing, search, substring, warc
from pagemill.llm.common import materialise, scratch_path
from pagemill.llm.components import components


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng, n, vocabulary=300):
    return [f"w{int(v)}" for v in rng.integers(0, vocabulary, n)]


@pytest.fixture(scope="module")
def texts():
    """Prose, exact copies, groups of near copies, a passage that many share, and odd rows."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(prose(rng, int(rng.integers(3, 200))))) for i in range(60)]
    base = prose(rng, 150)
    for i in range(60, 110):
        some = list(base)
        for at in rng.integers(0, 150, int(rng.integers(0, 4))):
            some[int(at)] = f"e{i}"
        rows.append((i, "\n".join(some)))
    passage = " ".join(prose(rng, 30))
    rows += [(i, " ".join(prose(rng, 20)) + "  " + passage + "\t" + " ".join(prose(rng, 20))) for i in range(110, 140)]
    rows += [(140, None), (141, ""), (142, " \n"), (143, "one two"), (144, "one  two"), (145, "x" * 30_000), (3, rows[3][1]), (4, "another text of the same id"), (None, rows[70][1]), (None, None), (146, " ".join(prose(rng, 20_000)))]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(*r, "en", "s", 1) for r in texts], "doc_id bigint, text string, lang string, source string, class_id int")


def shingles(text):
    w = words(text)
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


@pytest.mark.parametrize("small, depth", [(128, 3), (4, 3)])
def test_jaccard_join(docs, texts, small, depth):
    rows = [(d, t, shingles(t)) for d, t in texts if d is not None]
    links = [[j for j, b in enumerate(rows) if i != j and a[2] and b[2] and 5 * len(a[2] & b[2]) >= 4 * len(a[2] | b[2])] for i, a in enumerate(rows)]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(rows))]
    least = defaultdict(lambda: math.inf)
    for i, r in enumerate(root):
        least[r] = min(least[r], rows[i][0])
    want = sorted((rows[i][0], least[root[i]], len(links[i])) for i in range(len(rows)))
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.join(docs, small=small, depth=depth).collect())
    assert got == want


def test_deduplication_keeps_one_of_each_class(docs, texts):
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[None] == 2 and ids[3] == 1 and ids[4] == 2 and sum(ids[i] for i in range(60, 110)) == 1 and all(ids[i] == 1 for i in (140, 141, 142, 143, 145, 146)) and ids[144] == 0
    assert jaccard.deduplicated(docs.limit(0)).count() == 0


def test_chosen_paths_need_enough_runs():
    assert jaccard.runs_needed(3, 0.999) == 15 and jaccard.runs_needed(1, 0.999) == 7
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[:900], rng.integers(0, 1 << 63, 100).astype(np.uint64)])) for _ in range(40)]
    found = jaccard.embedded(sets)
    assert abs((found[0] == found[1]).mean() - 900 / 1100) < 0.2
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (jaccard.shared_counts(sets) == want)[~np.eye(40, dtype=bool)].all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 300), (7, 7)] + [(500, i) for i in range(501, 540)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | dict.fromkeys((100, 200, 300), 100) | {i: 500 for i in range(500, 540)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def plain_removed(texts, n=13):
    first = defaultdict(lambda: math.inf)
    for d, t in texts:
        w = words(t)
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            first[key] = min(first[key], math.inf if d is None else d)
    out = []
    for d, t in texts:
        w = words(t)
        gone = {j for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < (math.inf if d is None else d) for j in range(i, i + n)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), " ".join(kept)))
    return sorted(out, key=repr)


def test_substring_deduplication(docs, texts, monkeypatch):
    monkeypatch.setattr(substring, "BROADCAST_RUNS", 1 << 20)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.deduplicated(docs).collect()]
    assert sorted(got, key=repr) == plain_removed(texts)
    monkeypatch.setattr(substring, "BROADCAST_RUNS", 0)
    monkeypatch.setattr(substring, "HELD_BYTES", 1000)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.deduplicated(docs).collect()]
    assert sorted(got, key=repr) == plain_removed(texts)
    assert substring.deduplicated(docs.limit(0)).count() == 0


def test_windows_that_collide_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring, "_P", np.uint64(0))  # every hash is that of the last word
    ids = np.array([1, 2, 3, 9, 2, 3, 1, 2, 3])
    g = substring.equal_groups(ids, np.array([0, 3, 6]), 3)
    assert g[0] == g[2] != g[1]


def test_mixture(spark):
    rng = np.random.default_rng(9)
    names = ["b", "a", "é", None, "z", ""]
    rows = [(i, names[int(rng.integers(0, 6)) if i % 3 else 0], " ".join(["w"] * int(rng.integers(0, 60)))) for i in range(3000)] + [(3003, "b", "w " * 7), (3003, "b", "w " * 7), (None, "a", None), (3001, "tiny", "w w"), (3002, "none", "")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id bigint, source string, text string, size int, target int, copies int")
    got = mixing.taken(docs, blocks=64, shards=5).collect()
    assert len(got) == len(rows) and all(r.taken % max(1, r.size) == 0 and 0 <= r.taken <= 2 * r.size and r.taken == r.size * len(r.shards) for r in got)
    source = {r[0]: r[1] for r in rows}
    size, took, target = Counter(), Counter(), {}
    for r in got:
        s = source[r.doc_id]
        size[s] += r["size"]
        took[s] += r.taken
        target[s] = r.target
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want, left, open_ = {}, 1.5 * sum(size.values()), set(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * unit > 2 * size[s]}
        if not over:
            want |= {s: weight[s] * unit for s in open_}
            break
        want |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        open_ -= over
    assert all(math.isclose(target[s], want[s], rel_tol=1e-9) for s in order)
    assert all(abs(took[s] - want[s]) <= 60 for s in order)
    again = mixing.taken(docs.repartition(7), blocks=64, shards=5).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r["size"], r.taken, r.shards)
    assert sorted(map(key, got)) == sorted(map(key, again))
    out = mixing.mixed(docs, blocks=64, shards=5)
    assert out.columns == docs.columns and out.count() == sum(len(r.shards) for r in got)
    assert mixing.taken(docs.limit(0)).count() == 0 and mixing.taken(docs.where("source = 'none'")).collect()[0].taken == 0


def test_splitting_tree_is_exact_and_fair(spark):
    quotas = spark.createDataFrame([(0, 100), (1, 30), (2, 0), (3, 7)], "number int, quota bigint")
    sums = Counter()
    for seed in range(12):
        rows = mixing.split_quotas(quotas, 5, seed).collect()
        by_source, by_shard = Counter(), Counter()
        for r in rows:
            assert r.quota >= 0
            by_source[r.number] += r.quota
            by_shard[r.shard] += r.quota
        assert by_source == Counter({0: 100, 1: 30, 2: 0, 3: 7}) and set(by_shard) == set(range(5)) and all(26 <= n <= 29 for n in by_shard.values())
        sums[rows[0].shard] += next(r.quota for r in rows if r.number == 0)
    assert 15 <= sums[0] / 12 <= 25


PAGES = [(5, "http://a/b c?ä", "<p>" + "x" * 200), (2, None, "<p>" + "x" * 200), (9, "u", "<p>" + "x" * 200), (3, "u", "short"), (4, "u", "short"), (6, "", None), (7, "u\r\nEvil: 1", "é" * 60), (8, "u", "é" * 60), (None, "u", "é" * 60), (2, "again", "<p>" + "x" * 200), (10, "u", "y" * 200_000), (11, "u", "")]


@pytest.mark.parametrize("file_bytes", [1 << 28, 500])
def test_archives_round_trip(spark, file_bytes):
    pages = spark.createDataFrame([(*p, 1, 2) for p in PAGES], "page_id bigint, url string, html string, payload int, digest int")
    manifest = warc.write(pages, scratch_path(spark, "warc"), file_bytes)
    got = warc.read(manifest).collect()
    assert len(got) == len(PAGES)
    first = {"<p>" + "x" * 200: 2, "é" * 60: 7}
    want = []
    for i, u, h in PAGES:
        data, f = (h or "").encode(), first.get(h)
        revisit = f is not None and i != f
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", f if revisit else None, b"" if revisit else data))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got), key=repr) == sorted(want, key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_damaged_archives_are_refused(tmp_path):
    good = warc.record(1, "u", b"hello" * 50, hashlib.sha256(b"hello" * 50).hexdigest())
    path = tmp_path / "a.warc.zst"
    with path.open("wb") as f:
        warc.Writer(f, [good, warc.record(2, "u", b"", hashlib.sha256(b"").hexdigest(), 1, True)] * 20)
    data = path.read_bytes()
    assert data[:4] == b"\x5d\x2a\x4d\x18"

    def read(data):
        path.write_bytes(data)
        with path.open("rb") as f:
            return [warc.parsed(x) for x in warc.frames(f)]

    assert len(read(data)) == 40
    for bad in (data[:-3], data[: len(data) // 2], data[:-1] + b"x", data[:50], data + b"junk!"):
        with pytest.raises(ValueError):
            read(bad)
    for bad in (good.replace(b"WARC/1.1", b"WARC/9"), good[:-2], good + b"x", good.replace(b"hello", b"hallo"), good.replace(b"Content-Length: 3", b"Content-Length: 4", 1), good.replace(b"WARC-Date", b"WARC-Type")):
        with pytest.raises(ValueError):
            warc.parsed(bad)


def test_license_scan(spark):
    rows = [
        (1, "a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction."), (2, "a/b/c/x.py", "print(1)"), (3, "a/b/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
        (4, "z.txt", None), (5, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), (6, None, ""), (7, "ab/x", "x"), (7, "ab/x", "x"), (8, "a/z", "license " * 2000), (9, "c/LICENSE", "poem without end " * 50),
    ]
    files = spark.createDataFrame([(*r, 1) for r in rows], "key bigint, path string, text string, license int")
    got = {r.key: (r.own_license, r.license, r.inherited_from) for r in license.scan(files).collect()}
    assert got[1] == ("MIT", "MIT", None) and got[2] == (None, "GPL-3.0", "a/b") and got[3] == ("Apache-2.0", "Apache-2.0", None) and got[5] == ("GPL-3.0", "GPL-3.0", None)
    assert got[4] == got[6] == got[7] == got[9] == (None, None, None) and license.scan(files).count() == len(rows)
    assert license.scan(files.limit(0)).count() == 0


def plain_bm25(docs, queries, top):
    split = [(d, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())) for d, t in docs if d is not None]
    split = [(d, w) for d, w in split if w]
    n, mean = len(split), sum(len(w) for _, w in split) / max(1, len(split))
    df = Counter(x for _, w in split for x in set(w))
    out = set()
    for q, t in {(q, t) for q, t in queries if q is not None}:
        terms = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()))
        scored = []
        for d, w in split:
            c = Counter(w)
            s = sum(math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * c[x] * 2.2 / (c[x] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in terms if x in c)
            if s > 0:
                scored.append((-round(s, 6), d))
        out |= {(q, i, d, -s) for i, (s, d) in enumerate(sorted(scored)[:top], 1)}
    return out


def test_search(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(search, "SHARD_DOCS", 40)
    monkeypatch.setattr(search, "BLOCK", 8)
    some = [r for r in texts if r[0] is not None and r[0] % 20 == 0]
    got = {(r.query, r["rank"], r.doc_id, round(r.score, 5)) for r in search.search(docs, docs.where("doc_id % 20 = 0"), 7).collect()}
    assert got == {(q, i, d, round(s, 5)) for q, i, d, s in plain_bm25(texts, some, 7)}
    assert search.search(docs, docs.limit(0)).count() == 0 and search.search(docs.limit(0), docs).count() == 0


def test_postings_of_single_precision_lose_no_hit():
    """A shard keeps 8 bytes a posting, and what just reaches the floor stays among the best, with its score in double precision."""
    rng = np.random.default_rng(5)
    bags = [np.unique((2000 * rng.random(int(n)) ** 3).astype(np.int64)) for n in rng.integers(1, 400, 600)]
    doc, term = np.repeat(np.arange(600), [len(b) for b in bags]), np.concatenate(bags)
    tf, sizes = rng.integers(1, 5, len(term)).astype(np.int32), rng.integers(1, 3000, 600)
    order = np.argsort(term, kind="stable")
    terms, df = np.unique(term, return_counts=True)
    index = search.Index(700.0, terms, df.astype(np.uint32), df, doc[order].astype(np.uint16), tf[order], np.arange(600), np.ones(600, int), sizes)
    assert index.postings.nbytes == 8 * len(term) and np.shares_memory(index.impact, index.postings)
    idf = np.log(1 + (600 - df + 0.5) / (df + 0.5))
    weight = np.zeros((600, 2000))
    weight[doc, term] = idf[np.searchsorted(terms, term)] * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sizes[doc] / 700)))
    asked = bags[:80]
    scores = np.round(np.array([weight[:, b].sum(axis=1) for b in asked]), 6)
    floor = np.sort(scores, axis=1)[:, -10]
    starts = np.append(0, np.cumsum([len(b) for b in asked]))
    place = np.searchsorted(terms, np.concatenate(asked))
    for some in (np.zeros(80), floor):
        values = {"batch": 0, "starts": starts.astype("<i8").tobytes(), "term": place.astype("<i4").tobytes(), "terms": terms.tobytes(), "idf": idf.tobytes(), "floor": some.tobytes()}
        found = index.search(search.Pack(values), 10)
        for q in range(80):
            best = [d for d in np.lexsort((np.arange(600), -scores[q]))[:10] if scores[q][d] > 0]
            own = found[found["q"] == q]
            assert own["doc"].tolist() == best and np.allclose(own["score"], scores[q][best], rtol=0, atol=2e-6)


def test_scratch_tables_are_in_the_shared_folder(spark):
    path = scratch_path(spark, "x")
    assert path.startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    assert materialise(spark.range(3), "x").count() == 3


MIT = """The MIT License (MIT)

Copyright (c) 2019 Jane Doe and others

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
"""
BSD = """/*
 * Copyright 2011 Jane Doe. All rights reserved.
 *
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 * 1. Redistributions of source code must retain the above copyright notice,
 *    this list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above copyright notice,
 *    this list of conditions and the following disclaimer in the documentation
 *    and/or other materials provided with the distribution.
 * 3. Neither the name of Jane Doe nor the names of the contributors may be
 *    used to endorse or promote products derived from this software without
 *    specific prior written permission.
 */

int main() { return 0; }
"""


def test_licences_by_whole_texts_headers_and_tags(spark):
    common = Path(license.__file__).parent / "licenses"
    texts = {name: f"Copyright 2020 Jane Doe\n\n{(common / f'{name}.txt').read_text()}" for name in ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "Apache-2.0", "MPL-2.0")}
    files = [(n, f"{n}/COPYING", t) for n, t in texts.items()] + [
        ("MIT", "m/LICENSE", MIT), ("BSD-3-Clause", "b/a.c", BSD), ("GPL-2.0", "s/a.c", "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;"),
        ("MIT OR Apache-2.0", "t/a.c", "/* SPDX-License-Identifier: MIT OR Apache-2.0 */"), (None, "p/a.txt", "the licence of the river and the house\n" * 9), (None, "q/a.txt", "int x;"),
    ]
    got = {r.path: r.own_license for r in license.scan(spark.createDataFrame([(i, p, t) for i, (_, p, t) in enumerate(files)], "key bigint, path string, text string")).collect()}
    assert got == {p: n for n, p, _ in files}
