import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing, wordhash
from tessera.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def check(rows, docs, plain, room):
    want = {}
    for d in docs:
        ids = plain.encode(d.text or "", add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), room)):
            part = ids[s : s + room]
            want.setdefault((d.doc_id, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())), []).append(1)
    got = defaultdict(list)
    bins = defaultdict(list)
    for r in rows:
        got[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)].append(1)
        bins[r.sequence_id].append((r.offset, r.length))
    assert dict(got) == want
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    return len(bins)


@pytest.mark.parametrize("room", [4096, 64])
def test_edges(edge_docs, plain, room):
    rows = packing.pack_documents(edge_docs, tokenizer_path(), room).collect()
    check(rows, edge_docs.collect(), plain, room)


def test_density(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(docs, tokenizer_path()).collect()
    used = check(rows, docs.collect(), plain, 4096)
    assert used <= -(-sum(r.length for r in rows) // 4096) + 1


def test_groups_and_rounds(spark):
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 3000, 3000).tolist()
    df = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], "id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(df, group=300).collect()
    assert sorted(r.id for r in rows) == list(range(3000))
    assert len({r.sequence_id for r in rows}) <= 1.01 * sum(lengths) / 4096 + 1


def test_empty(no_docs):
    assert packing.pack_documents(no_docs, tokenizer_path()).count() == 0


@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
@settings(max_examples=100, deadline=None)
def test_sum_of_squares_fits(lengths):
    bins = packing.sum_of_squares(np.array(lengths), 50)
    assert np.bincount(bins, lengths).max() <= 50 and set(bins) == set(range(bins.max() + 1))


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_tokenizer_any_text(text):
    from tokenizers import Tokenizer

    one = packing.WordTokenizer.of(tokenizer_path())
    plain = test_tokenizer_any_text.__dict__.setdefault("plain", Tokenizer.from_file(tokenizer_path()))
    assert one.ids([text]) == [np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


@given(st.text(alphabet="abcABC'stz .,!09éÉßſĳÿ\n\t-", max_size=40))
@settings(max_examples=300, deadline=None)
def test_tokenizer_plain_text(text):
    test_tokenizer_any_text.hypothesis.inner_test(text)


def test_special_strings_and_clashes(plain, monkeypatch):
    """Added tokens have the file's own ids; words whose hashes clash keep their own ids."""
    one, texts = packing.WordTokenizer(tokenizer_path()), ["<|endoftext|> hi", "a<|startoftext|>b", "x <|ENDOFTEXT|>", "<|endoftext", "two words more words"]
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert one.ids(texts) == want and np.frombuffer(want[0], "<u4").tolist() == [49407, 1883]
    a, b = "a", "b"
    for _ in range(10):  # words of 1024 letters that a polynomial hash modulo 2^64 can't tell apart
        a, b = a + b, b + a
    assert one.ids([a, b, f"{a} {b}"]) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in (a, b, f"{a} {b}")]
    monkeypatch.setattr(wordhash, "span_hash", lambda data, start, end: np.zeros(len(start), np.uint64))
    assert packing.WordTokenizer(tokenizer_path()).ids(texts) == want


def brute_sum_of_squares(lengths, room):
    """The rule by direct trial: each piece goes where the sum over gaps of squared counts of open sequences is least."""
    gaps, out, made, least = [], [], 0, -(-sum(lengths) // room)
    cost = lambda g: sum(c * c for gap, c in Counter(g).items() if gap)
    for s in lengths:
        trials = [(cost([*gaps[:k], g - s, *gaps[k + 1 :]]), g, k) for k, g in enumerate(gaps) if g >= s]
        fresh = cost([*gaps, room - s])
        best = min(trials, default=None)
        if best is None or (made < least and fresh < best[0]):
            out.append(best and min(best[0], fresh) or fresh)
            gaps.append(room - s)
            made += 1
        else:
            out.append(best[0])
            gaps[best[2]] -= s
    return out, gaps


@given(st.lists(st.integers(1, 20), min_size=1, max_size=40))
@settings(max_examples=100, deadline=None)
def test_sum_of_squares_against_trial(lengths):
    """Same sequences (as a multiset of fills) as the direct trial of every placement."""
    bins = packing.sum_of_squares(np.array(lengths), 20)
    _, gaps = brute_sum_of_squares(lengths, 20)
    assert sorted(20 - np.bincount(bins, lengths).astype(int)) == sorted(gaps)
