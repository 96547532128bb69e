"""MinHash near-duplicate groups with odd sketches.

1. Texts are read once: each row gets a 128-bit key of its lower-cased (A-Z) word sequence, `bands * rows` MinHash
   values of its 5-word shingles, folded into `bands` bucket keys, and a parity bitmap of `bits` bits, its odd sketch.
   Rows with the same sequence have the same shingle set; one row stands for all.
2. In each bucket the least node leads: members whose sketches agree with its sketch hang on it, the others go to a
   next round with a new leader; what is left after `rounds` rounds is compared in pairs of blocks. From the population
   count of the XOR of two sketches, J ~ 1 + bits / (4 k) * ln(1 - 2 c / bits) for k samples; `loose` or more agrees.
   Only these stars are passed on, never a bucket's pairs. Their components are families: every link lies inside one.
3. Inside a family, members are compared on full sets with the leaders they hang on. Members that this leaves outside
   the family's largest part are then compared with all its members, one block of each a task. Components of the exact links are the result.

With 24 bands of 5 rows a pair at the similarity 0.85 shares no bucket with probability 8e-7, and the loose sketch
bound 0.65 lies more than 4 standard deviations below it. All links inside a family are confirmed on full sets
of 64-bit shingle hashes.

Hot groups: copies of one sequence are one aggregate row; a bucket or family of near copies of any size is one star,
found by joins that adaptive execution splits; where leaders don't explain a family, a task compares at most about
`heavy` of the members left with `heavy` of all, and a row is copied once for each such block it meets. The bitmap that spares other texts the shuffle has a fixed size of 2^24 bits: it
saves little once families have some 10 million distinct texts, the result stays the same.

Edge cases: null or wordless text has no shingles, is linked with nothing and is kept; fewer than five words make
one shingle; a null doc_id groups like any other row, a component without any doc_id has the name null;
rows that repeat a doc_id are rows of their own; `stays` marks exactly one row of each component; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, keep_rows, row_digest, slices, text_batches
from tessera.llm.components import connected_components
from tessera.llm.wordhash import Words, mix, shingle_sets

_COUNT = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def _encode(texts: list[str | None]) -> list[bytes]:
    """UTF-8 with A-Z lower-cased."""
    return [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]


def signatures(value: np.ndarray, first: np.ndarray, count: int, seed: int = 11) -> np.ndarray:
    """MinHash values, one row of `count` for each text with shingles (texts without get the largest value)."""
    factors = np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.full((len(first) - 1, count), np.uint64(2**64 - 1))
    full = np.flatnonzero(np.diff(first))
    if len(full):
        at = first[:-1][full]
        for k, f in enumerate(factors):
            out[full, k] = np.minimum.reduceat(value * f, at)
    return out


def odd_sketch(signature: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps (rows of bytes) of rows of MinHash values: each (position, value) flips one bit."""
    n, k = signature.shape
    place = (mix(signature + np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bits)).astype(np.int64)
    flips = np.bincount((np.arange(n)[:, None] * bits + place).ravel(), minlength=n * bits).reshape(n, bits)
    return np.packbits((flips & 1).astype(np.uint8), axis=1)


def most_odd(similarity: float, k: int, bits: int) -> int:
    """The XOR population count at which the estimate of J falls to `similarity`."""
    return int(bits / 2 * (1 - np.exp(-(1 - similarity) * 4 * k / bits)))


def _forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Union the pairs (a, b) into labels (changed in place); the pairs that joined two sets."""
    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = int(labels[x]), int(labels[y])
        if p != q:
            labels[labels == q] = p
            out.append((x, y))
    return out


def _xor_count(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Population counts of a[i] ^ b[j] as a matrix; rows of 16-bit words."""
    out = np.zeros((len(a), len(b)), np.int32)
    for k in range(a.shape[1]):
        out += _COUNT[a[:, k][:, None] ^ b[:, k][None, :]]
    return out


def _bucket_edges(ids: np.ndarray, sketch: np.ndarray, most: int, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the pairs of a bucket whose sketches differ in at most `most` bits.

    Members join the first one they agree with, block by block; those that no leader takes are compared with all.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    ids, sketch = ids[order], sketch[order]
    labels = np.arange(n)
    edges: list[tuple[int, int]] = []
    lead = np.flatnonzero(_xor_count(sketch[:1], sketch)[0] <= most)[1:]
    edges += _forest(labels, np.zeros(len(lead), np.int64), lead)
    alone = np.flatnonzero(labels != labels[0])
    for s in range(0, len(alone), 256):
        rows = alone[s : s + 256]
        for t in range(0, n, 4096):
            i, j = np.nonzero(_xor_count(sketch[rows], sketch[t : t + 4096]) <= most)
            differ = labels[rows[i]] != labels[t + j]
            edges += _forest(labels, rows[i][differ], (t + j)[differ])
    return [(int(ids[a]), int(ids[b])) for a, b in edges]


def _cross_links(sets: list[np.ndarray], part: np.ndarray, left: np.ndarray, own: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join parts: each left member against the block's own members, by counts over a shared vocabulary."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    kinds, word = np.unique(np.concatenate(sets), return_inverse=True)
    doc = np.repeat(np.arange(n), sizes)
    order = np.argsort(word, kind="stable")
    by_word, starts = doc[order], np.searchsorted(word[order], np.arange(len(kinds) + 1))
    labels = part.copy()
    edges: list[tuple[int, int]] = []
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    for i in np.flatnonzero(left).tolist():
        if (labels == labels[i]).all():
            continue
        mine = word[firsts[i] : firsts[i + 1]]
        lens = starts[mine + 1] - starts[mine]
        at = np.repeat(starts[mine] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
        common = np.bincount(by_word[at], minlength=n)
        linked = np.flatnonzero((100 * common >= percent * (sizes + sizes[i] - common)) & own & (labels != labels[i]))
        for j in linked.tolist():
            if labels[j] != labels[i]:
                labels[labels == labels[j]] = labels[i]
                edges.append((i, j))
    return edges


def _perhaps_among(rows: DataFrame, key: str, ids: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """Rows whose key may be in ids (one column), by a bitmap of fixed size; an exact join is to follow.

    The bitmap is a table of at most bits / 64 words, broadcast; with more ids than bits it lets all rows through.
    """
    place = lambda c: F.pmod(F.xxhash64(c, F.lit(29)), F.lit(bits))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (place(c) % 64).cast("int"))
    name = ids.columns[0]
    words = ids.select(F.shiftright(place(name), 6).alias("word"), bit(name).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("set"))
    near = rows.join(F.broadcast(words), F.shiftright(place(key), 6) == F.col("word"))
    return near.where(F.col("set").bitwiseAND(bit(key)) != 0).select(*rows.columns)


def _agree(pairs: DataFrame, signs: DataFrame, most: int) -> DataFrame:
    """Adds near: whether the sketches of node and lead differ in at most `most` bits (JVM bit counts)."""
    own = signs.select(F.col("node").alias("node2"), F.col("sketch").alias("s1"))
    lead = signs.select(F.col("node").alias("lead2"), F.col("sketch").alias("s2"))
    both = pairs.join(own, F.col("node") == F.col("node2")).join(lead, F.col("lead") == F.col("lead2"))
    odd = F.aggregate(F.zip_with("s1", "s2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return both.select("node", "lead", (odd <= most).alias("near"))


def _bucket_forest(placed: DataFrame, signs: DataFrame, most: int, rounds: int, heavy: int) -> DataFrame:
    """(a, b): edges that join the members of each bucket whose sketches agree.

    placed: bucket, node. Each round the least node of a bucket leads: members that agree with it hang on it, the
    others go on to the next round. What is left after the last round is compared in pairs of blocks.
    """
    edges, rest = None, placed
    for k in range(rounds):
        # one row a bucket, by sums on the map side; a table of its own, so that a hot bucket's join can be split
        leads = cut(rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("lead")).where("m > 1").select(F.col("bucket").alias("bucket2"), "lead"), f"near-leads-{k}")
        met = cut(rest.join(leads, F.col("bucket") == F.col("bucket2")).where("node <> lead").select("bucket", "node", "lead"), f"near-met-{k}")
        if k and met.isEmpty():
            return edges
        # bands repeat the same pairs, which are compared once
        judged = cut(_agree(met.select("node", "lead").distinct(), signs, most), f"near-judged-{k}")
        found = judged.where("near").select(F.col("node").alias("a"), F.col("lead").alias("b"))
        edges = found if edges is None else edges.unionByName(found)
        apart = judged.where("NOT near").select(F.col("node").alias("n2"), F.col("lead").alias("l2"))
        rest = met.join(apart, (F.col("node") == F.col("n2")) & (F.col("lead") == F.col("l2")), "left_semi").select("bucket", "node")
    rest = cut(rest, "near-rest")
    crowds = rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    crowds = crowds.select(F.col("bucket").alias("bucket2"), F.ceil(F.col("m") / F.lit(heavy)).cast("int").alias("blocks"))
    dealt = rest.join(crowds, F.col("bucket") == F.col("bucket2"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.col("node").alias("n2"), F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("place"))
    dealt = dealt.join(signs.select("node", "sketch"), F.col("node") == F.col("n2")).select("node", "sketch", "place")

    def one(f: pd.DataFrame) -> pd.DataFrame:
        sketch = np.array(f["sketch"].tolist(), np.int64).view(np.uint16).reshape(len(f), -1)
        found = _bucket_edges(f["node"].to_numpy(), sketch, most)
        return pd.DataFrame({"a": [a for a, _ in found], "b": [b for _, b in found]}, dtype="int64")

    return edges.unionByName(dealt.groupBy("place").applyInPandas(one, "a long, b long"))


def _exact_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    x = sets.select(F.col("node").alias("x"), F.col("shingles").alias("sx"))
    y = sets.select(F.col("node").alias("y"), F.col("shingles").alias("sy"))
    both = pairs.join(x, F.col("a") == F.col("x")).join(y, F.col("b") == F.col("y"))
    common = F.size(F.array_intersect("sx", "sy"))
    return both.where(100 * common >= percent * (F.size("sx") + F.size("sy") - common)).select("a", "b")


def near_rows(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = 5, percent: int = 85, bands: int = 24, rows: int = 5, bits: int = 512, loose: float = 0.65, rounds: int = 3, heavy: int = 512) -> DataFrame:
    """One row per row of docs: key, digest, n_shingles, component_id, kept, stays."""
    text_batches(docs.sparkSession)
    base = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), row_digest(F.col(text)).alias("digest"))
    k = bands * rows

    def signed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            data = _encode(f["text"].tolist())
            for a, b in slices([len(d) for d in data], 1 << 19):
                words = Words(data[a:b])
                value, _, first = shingle_sets(words, n)
                sig = signatures(value, first, k)
                keys = mix(np.stack([sum((sig[:, x * rows + r] * np.uint64(2 * r + 3) for r in range(rows)), np.uint64(x)) for x in range(bands)], 1).astype(np.uint64)).view(np.int64)
                sketch = odd_sketch(sig, bits).view(np.int64)
                yield pd.DataFrame({"id": f["id"].iloc[a:b], "digest": f["digest"].iloc[a:b], "seq": [hashlib.blake2b(b" ".join(d.split()), digest_size=16).digest() for d in data[a:b]], "n_shingles": np.diff(first), "keys": list(keys), "sketch": list(sketch)})

    # texts are read once; ids travel as text here, so that nulls don't make them floats
    made = base.withColumn("id", F.col("id").cast("string")).mapInPandas(signed, "id string, digest binary, seq binary, n_shingles long, keys array<long>, sketch array<long>")
    members = cut(made.select(F.monotonically_increasing_id().alias("node"), F.col("id").cast("long").alias("id"), "digest", "seq", "n_shingles", "keys", "sketch"), "near-members")
    heads = members.where("n_shingles > 0").groupBy(F.col("seq").alias("same")).agg(F.min("node").alias("rep"))
    heads = cut(heads, "near-heads")  # so that the join below has its own exchanges, which may be split at a hot sequence

    signs = members.join(heads, F.col("node") == F.col("rep"), "left_semi")
    placed = signs.select("node", F.explode("keys").alias("bucket"))  # bucket keys differ by band
    forest = cut(_bucket_forest(placed, members.select("node", "sketch"), most_odd(loose, k, bits), rounds, heavy), "near-forest")
    families = cut(connected_components(forest), "near-families")  # node, component

    # full sets of family members; whole texts move only for them (and the few that share a bit of the bitmap)
    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            data = _encode(f["text"].tolist())
            for a, b in slices([len(d) for d in data], 1 << 19):
                value, _, first = shingle_sets(Words(data[a:b]), n)
                yield pd.DataFrame({"node": f["node"].to_numpy()[a:b], "family": f["family"].to_numpy()[a:b], "shingles": [value[first[i] : first[i + 1]].view(np.int64) for i in range(b - a)]})

    wanted = cut(members.select("node", F.col("id").alias("id2"), F.col("digest").alias("digest2")).join(families.withColumnRenamed("node", "n2"), F.col("node") == F.col("n2")).select("node", "id2", "digest2", F.col("component").alias("family")), "near-wanted")
    inside = _perhaps_among(base, "digest", wanted.select("digest2")).join(wanted, F.col("id").eqNullSafe(F.col("id2")) & (F.col("digest") == F.col("digest2"))).select("node", "family", "text")
    full = inside.mapInPandas(sets, "node long, family long, shingles array<long>").dropDuplicates(["node"])
    full = cut(full, "near-sets")
    # leaders first: what hangs on one node in the candidate forest is compared with it
    links = cut(_exact_links(forest.distinct(), full, percent), "near-links")
    parts = connected_components(links)
    held = full.select("node", "family").join(parts.withColumnRenamed("node", "n2"), F.col("node") == F.col("n2"), "left").select("node", "family", F.coalesce("component", "node").alias("part"))
    held = cut(held, "near-parts")
    # then members outside the largest part of their family, with all the others of it
    sizes = held.groupBy("family", "part").agg(F.count(F.lit(1)).alias("m"))
    main = sizes.groupBy(F.col("family").alias("family2")).agg(F.max(F.struct("m", "part")).alias("top"), F.sum("m").alias("members"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    blocks = lambda c: F.ceil(c / F.lit(heavy)).cast("int")
    main = cut(main.select("family2", F.col("top.part").alias("main"), blocks(F.col("members")).alias("blocks"), blocks(F.col("members") - F.col("top.m")).alias("lefts")), "near-main")
    block = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    rest = held.join(main, F.col("family") == F.col("family2")).withColumn("left", F.col("part") != F.col("main")).withColumn("own", block("blocks", 1)).withColumn("mine", block("lefts", 2))
    # a task is a block of left members and a block of all members, so that it is bounded on both sides
    pair = lambda l, o: F.struct(l.alias("mine2"), o.alias("own2"))
    as_member = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda l: pair(l, F.col("own")))
    as_left = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: pair(F.col("mine"), o))
    dealt = rest.withColumn("place", F.explode(F.when(F.col("left"), F.array_union(as_member, as_left)).otherwise(as_member)))
    dealt = dealt.select(F.col("node").alias("n2"), "family", "part", "place.*", (F.col("left") & (F.col("mine") == F.col("place.mine2"))).alias("left"), (F.col("own") == F.col("place.own2")).alias("own"))
    dealt = dealt.join(full.select("node", "shingles"), F.col("node") == F.col("n2")).select("node", "family", "part", "mine2", "own2", "left", "own", "shingles")

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        """Links of the block's left members with its own members; parts that are joined already aren't compared."""
        f = f.sort_values("node")
        found = _cross_links([np.asarray(x, np.int64) for x in f["shingles"]], f["part"].to_numpy(), f["left"].to_numpy(), f["own"].to_numpy(), percent)
        nodes = f["node"].to_numpy()
        return pd.DataFrame({"a": [nodes[a] for a, _ in found], "b": [nodes[b] for _, b in found]}, dtype="int64")

    more = dealt.groupBy("family", "mine2", "own2").applyInPandas(compare, "a long, b long")
    groups = connected_components(links.unionByName(more))  # representatives of sequences

    # every row hangs on the representative of its sequence; a component's name is its least doc_id
    named = members.select("node", "id", "digest", "seq", "n_shingles").join(heads, F.col("seq") == F.col("same"), "left")
    named = named.join(groups.withColumnRenamed("node", "g"), F.col("rep") == F.col("g"), "left")
    named = cut(named.select("node", "id", "digest", "n_shingles", F.coalesce("component", "rep", "node").alias("part")), "near-named")
    tops = named.groupBy(F.col("part").alias("part2")).agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("top")).where("m > 1")
    tops = cut(tops.select("part2", F.col("top.id").alias("least"), F.col("top.node").alias("first")), "near-tops")
    out = named.join(tops, F.col("part") == F.col("part2"), "left")
    component = F.when(F.col("part2").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select(F.col("id").alias(key), "digest", "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), F.coalesce(F.col("node") == F.col("first"), F.lit(True)).alias("stays"))


def near_groups(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: key, n_shingles, component_id, kept (settings as in near_rows)."""
    return near_rows(docs, **settings).drop("digest", "stays")


def keep_one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """One row of each group (settings as in near_rows), with all its columns."""
    return keep_rows(docs, near_rows(docs, **settings), once=True)
