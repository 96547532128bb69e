"""Exact and near duplicates against brute force."""

import hashlib
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, exact_dedup, near_dedup
from tessera.llm.wordhash import Words, grams, shingle_sets

SPACE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_exact(rows):
    norm = [SPACE.sub("", r.text or "") for r in rows]
    out = []
    for r, n in zip(rows, norm):
        same = [s for s, m in zip(rows, norm) if m == n]
        best = min(same, key=lambda s: (-len(s.text or ""), s.doc_id is None, s.doc_id or 0))
        out.append((r.doc_id, best.doc_id, len(same), r.doc_id == best.doc_id, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [200, 3])
def test_exact(spark, edge_docs, least):
    rows = exact_dedup.exact_dedup(edge_docs, least=least, most=40 * least).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, rows), key=repr) == brute_exact(edge_docs.collect())


def test_exact_table(docs_table):
    rows = exact_dedup.exact_dedup(docs_table).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, rows), key=repr) == brute_exact(docs_table.collect())


def test_hash_clash(spark, monkeypatch):
    """With a hash that makes all chunks clash, texts are still told apart."""
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: F.pmod(real(c), F.lit(2)))
    docs = spark.createDataFrame([(0, "abc def"), (1, "abcdef"), (2, "xyz"), (3, "uvw"), (4, "uvw"), (5, None)], "doc_id long, text string")
    rows = exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    monkeypatch.undo()
    assert sorted(map(tuple, rows), key=repr) == brute_exact(docs.collect())


def test_chunks_depend_on_content(spark):
    a = "".join(map(chr, np.random.default_rng(0).integers(97, 123, 20_000)))
    df = spark.createDataFrame([(a,), ("zzzz" * 30 + a,)], "t string").select(exact_dedup.chunks_of(F.col("t"), 30, 4000).alias("c"))
    one, two = (r.c for r in df.collect())
    assert "".join(one) == a and len(set(one) & set(two)) > 0.8 * len(one)


def test_keep_one(edge_docs, no_docs):
    kept = exact_dedup.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    norm = [SPACE.sub("", r.text or "") for r in kept.collect()]
    assert sorted(norm) == sorted({SPACE.sub("", r.text or "") for r in edge_docs.collect()})
    assert exact_dedup.keep_one(no_docs).count() == 0 and near_dedup.keep_one_of_each(no_docs).count() == 0


def test_rows_are_known_by_key_and_text(spark):
    """A repeated or null key carries no other row along, and of equal rows one stays."""
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "long   text here"), (2, "long text here"), (2, "another one"), (3, "same"), (3, "same"), (None, "same"), (None, "lone"), (4, near), (5, near + " more"), (5, "apart from these")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, "long   text here"), (2, "another one"), (3, "same"), (None, "lone"), (4, near), (5, near + " more"), (5, "apart from these")]
    assert sorted(map(tuple, exact_dedup.keep_one(docs).collect()), key=repr) == sorted(want, key=repr)
    apart = sorted(map(tuple, near_dedup.keep_one_of_each(docs).collect()), key=repr)
    assert apart == sorted([*want[1:5], (5, "apart from these"), next(x for x in apart if "here" in x[1])], key=repr)


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_near(rows, percent=85):
    sets = [shingles(r.text) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        c = len(a & b)
        if a and b and 100 * c >= percent * (len(a) + len(b) - c):
            parent[find(j)] = find(i)
    out = []
    for i, r in enumerate(rows):
        group = [rows[j].doc_id for j in range(len(rows)) if find(j) == find(i) and rows[j].doc_id is not None]
        head = min(group, default=None)
        out.append((r.doc_id, len(sets[i]), head, r.doc_id == head))
    return sorted(out, key=repr)


def test_near_edges(edge_docs):
    rows = near_dedup.near_groups(edge_docs).collect()
    assert sorted(map(tuple, rows), key=repr) == brute_near(edge_docs.collect())


def near_copies(n, edits, seed=0):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 5000, 150)]
    out = []
    for i in range(n):
        words = list(base)
        for k in rng.integers(0, 150, rng.integers(0, edits)):
            words[k] = f"x{i}_{k}"
        out.append((i + 10, " ".join(words)))
    return out


@pytest.mark.parametrize(("n", "edits", "heavy", "rounds"), [(150, 9, 1024, 3), (150, 9, 20, 1)])
def test_near_copies(spark, n, edits, heavy, rounds):
    """One large family with links around the threshold, in one block and in many."""
    docs = spark.createDataFrame(near_copies(n, edits), "doc_id long, text string")
    rows = near_dedup.near_groups(docs, heavy=heavy, rounds=rounds).collect()
    assert sorted(map(tuple, rows), key=repr) == brute_near(docs.collect())


def test_near_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(500).coalesce(2).cache()
    assert sorted(map(tuple, near_dedup.near_groups(docs).collect()), key=repr) == brute_near(docs.collect())


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    k, bits = 120, 512
    for j in (0.85, 0.95):
        misses = 0
        for _ in range(200):
            a = rng.integers(0, 2**63, (1, k)).astype(np.uint64)
            b = a.copy()
            b[0, rng.random(k) > j] += np.uint64(1)
            x, y = (near_dedup.odd_sketch(s, bits).view(np.uint16) for s in (a, b))
            misses += near_dedup._COUNT[x ^ y].sum() > near_dedup.most_odd(0.65, k, bits)
        assert misses == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, k) for k in range(101, 130)]
    df = components.connected_components(spark.createDataFrame(path + star + [(7, 7), (201, 200)], "a long, b long"))
    got = {r.node: r.component for r in df.collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 130)} | {200: 200, 201: 200}


def test_hashes_have_no_algebra():
    """Words that a polynomial hash modulo 2^64 can't tell apart get different hashes; equal ones agree wherever they stand."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    for n in (4, 8, 16, 24, 64, 1024):
        x, y, again = Words([f"{a[:n]} {b[:n]}  q {a[:n]}".encode()]).hash[[0, 1, 3]]
        assert x != y and x == again
    rng = np.random.default_rng(0)
    words = {bytes(rng.integers(97, 100, rng.integers(1, 40)).astype(np.uint8)) for _ in range(20_000)}
    assert len(set(Words([b" ".join(words)]).hash.tolist())) == len(words)


def test_word_hashes():
    texts = ["a b  c", "", " \n", "a\tb c a b c", "ä"]
    w = Words([t.encode() for t in texts])
    assert [bytes(w.data[s:e]).decode() for s, e in zip(w.start, w.end)] == [x for t in texts for x in t.split()]
    g, doc = grams(w, 3)
    assert len(g) == 1 + 4 and g[0] == g[1] == g[4] and list(doc) == [0, 3, 3, 3, 3]
    value, doc, first = shingle_sets(w, 5)
    assert list(np.diff(first)) == [1, 0, 0, 2, 1]
