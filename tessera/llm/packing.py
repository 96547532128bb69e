"""Best-fit packing of tokenized documents into sequences, by the sum-of-squares rule.

Texts are tokenized in Arrow batches; a document of more than `room` tokens is cut into full pieces and one
shorter last piece. Full pieces are sequences by themselves. The other pieces are dealt by hash into groups, each
packed in one task: pieces in descending length (equal lengths: seeded order) go where the sum over gaps g of
N(g)^2 becomes smallest, N(g) being the number of open sequences with gap g (a full one doesn't count; opening a
new one is a choice like any other until the group's volume bound is reached). Sequences of a group that stay
less full than the rest go back and are packed anew with those of other groups, in fewer groups each round, so
the loss at the edges of groups doesn't add up.

Memory: a group holds about `group` pieces, three numbers each, whatever the input's size.

Edge cases: null text is empty: one piece with the end id alone; a null doc_id stays null; rows that repeat a
doc_id are packed each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, slices, text_batches
from tessera.llm.wordhash import Words

_loaded: dict = {}


#: Plain text: characters that lower-casing and composition treat alike everywhere, and whose bytes tell letters.
PLAIN_TEXT = re.compile("[\x20-\x7e\x09-\x0d\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]*")
#: The file's pre-tokens (contractions, runs of letters, single digits, runs of others), over lower-cased plain text.
PRE_TOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\u017f]+|[0-9]|[^\\sa-z0-9\xdf-\u017f]+")
#: Of a byte of plain text: 0 white space, 1 letter, 2 digit, 3 other.
_CLASS = np.full(256, 3, np.int8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2


def _byte_alphabet() -> dict[int, str]:
    """Printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordTokenizer:
    """Ids of whole texts from the word-wise BPE file, vectorised, with a memo by pre-token.

    The file never joins characters across white space or pre-tokens, so a text's ids are those of its pre-tokens
    in order. In plain text these are runs of one class of bytes (a word with an apostrophe is kept whole and split
    by pattern); each distinct one goes to the BPE model once, known by its bytes (hashes only group, and are checked).
    Other texts, and those that hold one of the file's added tokens, go through the whole tokenizer.
    The memo is emptied when it holds over `memo` entries: memory is bounded, results are the same.
    """

    def __init__(self, path: str, memo: int = 300_000):
        from tokenizers import Tokenizer

        self.inner, self.limit, self.memo = Tokenizer.from_file(path), memo, {}
        self.model, self.alphabet = self.inner.model, _byte_alphabet()
        added = [t.content for t in self.inner.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _run(self, text: str) -> bytes:
        ids = []
        for p in PRE_TOKENS.findall(text) if "'" in text else [text]:
            ids += [t.id for t in self.model.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(self.alphabet))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, texts: list[str]) -> list[bytes]:
        parts = Words([t.lower().encode() for t in texts], pre_tokens)
        first, place = parts.kinds()
        if len(self.memo) > self.limit:
            self.memo.clear()
        memo = self.memo
        keys = [parts.bytes_of(k) for k in first.tolist()]
        found = list(map(memo.get, keys))
        for k in [k for k, x in enumerate(found) if x is None]:
            memo[keys[k]] = found[k] = self._run(keys[k].decode())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(found), "<u4")
        own, total = sizes[place], np.concatenate([[0], np.cumsum(sizes[place])])
        ids = flat[np.repeat(starts[place] - total[:-1], own) + np.arange(total[-1])]
        edges = total[parts.first].tolist()
        return [ids[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        plain = []
        for k, t in enumerate(texts):
            if PLAIN_TEXT.fullmatch(t) and not (self.added and self.added.search(t)):
                plain.append(k)
            else:
                out[k] = np.array(self.inner.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        for a, b in slices([len(texts[k]) for k in plain], 1 << 20):
            for k, ids in zip(plain[a:b], self._plain([texts[k] for k in plain[a:b]]), strict=True):
                out[k] = ids
        return out


def pre_tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each pre-token in lower-cased plain UTF-8; a word with an apostrophe is one."""
    kind = _CLASS[data]
    quote = data == 39
    if quote.any():
        edge = np.flatnonzero(np.diff((kind == 0).view(np.int8), prepend=1, append=1))
        start, end = edge[::2], edge[1::2]
        marks = np.concatenate([[0], np.cumsum(quote)])
        for a, b in zip(*(x[marks[end] > marks[start]] for x in (start, end)), strict=True):
            kind[a:b] = 3
    new = np.ones(len(data), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(data))
    held = kind[start] != 0
    return start[held], end[held]


def pieces(docs: DataFrame, tokenizer: str, room: int = 4096, end: int = 1, key: str = "doc_id") -> DataFrame:
    """key, piece, start, length, ids_crc32: each document's ids, with the end id, cut at `room`."""
    tail = np.array([end], "<u4").tobytes()

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordTokenizer.of(tokenizer)
        for f in frames:
            rows = []
            for i, ids in zip(f["id"], words.ids([t or "" for t in f["text"]]), strict=True):
                ids += tail
                for k, s in enumerate(range(0, len(ids), 4 * room)):
                    cutout = ids[s : s + 4 * room]
                    rows.append((i, k, s // 4, len(cutout) // 4, zlib.crc32(cutout)))
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])

    text_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    base = docs.select(F.col(key).cast("string").alias("id"), "text")  # as text, nulls don't make numbers floats
    made = base.mapInPandas(batches, "id string, piece int, start long, length long, ids_crc32 long")
    return made.withColumn("id", F.col("id").cast(kind))


def sum_of_squares(lengths: np.ndarray, room: int) -> np.ndarray:
    """The sequence number of each piece, in the order given."""
    count = np.zeros(room + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(room + 1)]
    least = -(-int(lengths.sum()) // room)
    out = np.zeros(len(lengths), np.int64)
    made = 0
    after = np.zeros(room + 1, np.int64)
    for i, s in enumerate(lengths.tolist()):
        # moving a sequence from gap g to g - s changes the sum by 2 (N(g - s) - N(g)) + 2; to gap 0, by 1 - 2 N(g)
        gaps = np.flatnonzero(count[s:]) + s
        best, where = None, 0
        if len(gaps):
            after = 2 * (count[gaps - s] - count[gaps]) + 2
            if gaps[0] == s:
                after[0] = 1 - 2 * count[s]
            k = int(after.argmin())
            best, where = int(after[k]), int(gaps[k])
        fresh = 2 * count[room - s] + 1 if s < room else 0
        if best is None or (made < least and fresh < best):
            bin_, rest = made, room - s
            made += 1
        else:
            bin_ = stacks[where].pop()
            count[where] -= 1
            rest = where - s
        if rest:
            stacks[rest].append(bin_)
            count[rest] += 1
        out[i] = bin_
    return out


def pack(pieces_: DataFrame, room: int = 4096, group: int = 2000, rounds: int = 3, full: float = 0.999, seed: int = 3, id_type: str = "bigint") -> DataFrame:
    """Adds sequence_id and offset to rows of pieces()."""
    text_batches(pieces_.sparkSession)
    schema = "id string, piece int, start long, length long, ids_crc32 long, h long, grp long, bin long, offset long, used long"
    todo = cut(pieces_.withColumn("h", F.xxhash64("id", "piece", "start", "length", "ids_crc32", F.lit(seed))), "pieces")
    whole = todo.where(F.col("length") == room)
    done = whole.select("id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts, todo = [done], todo.where(F.col("length") < room)
    size = todo.count()
    for k in range(1, rounds + 1):
        groups = max(1, -(-size // group))
        last = groups == 1 or k == rounds

        def one(frame: pd.DataFrame) -> pd.DataFrame:
            f = frame.sort_values(["length", "h", "id", "piece"], ascending=[False, True, True, True], kind="stable")
            length = f["length"].to_numpy()
            f["bin"] = b = sum_of_squares(length, room)
            order = np.argsort(b, kind="stable")
            run = np.cumsum(length[order]) - length[order]
            heads = np.flatnonzero(np.diff(b[order], prepend=-1))
            run -= np.repeat(run[heads], np.diff(np.append(heads, len(run))))
            offset = np.empty(len(run), np.int64)
            offset[order] = run
            f["offset"], f["used"] = offset, np.bincount(b, length)[b].astype(np.int64)
            return f[[c.split()[0] for c in schema.split(", ")]]

        dealt = todo.withColumn("grp", F.pmod(F.xxhash64("h", F.lit(k)), F.lit(groups))).withColumn("id", F.col("id").cast("string"))
        placed = dealt.groupBy("grp").applyInPandas(one, schema)
        placed = cut(placed.withColumn("id", F.col("id").cast(id_type)), f"packed-{k}")
        settled = placed if last else placed.where(F.col("used") >= int(full * room))
        number = F.lit(k << 60) + F.shiftleft(F.col("grp"), 24) + F.col("bin")
        parts.append(settled.select("id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset"))
        if last:
            break
        todo = placed.where(F.col("used") < int(full * room)).select("id", "piece", "start", "length", "ids_crc32", "h")
        size = todo.count()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, room: int = 4096, key: str = "doc_id") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    kind = docs.schema[key].dataType.simpleString()
    return pack(pieces(docs, tokenizer, room, key=key), room, id_type=kind).withColumnRenamed("id", key)
