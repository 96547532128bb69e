"""Character n-grams as 64-bit keys, and tables of values sorted by such keys that workers look up piece by piece.

A table is written by Spark into the shared folder, dealt by the top bits of its keys into pieces of about
`PIECE_ROWS` rows, each one sorted file. A worker reads a piece when it has keys for it, and keeps pieces up to
`ROOM` bytes. The table can be of any size: the driver never holds it, and a worker never holds more than that.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import new_path
from tessera.llm.wordhash import mix

BITS, LONGEST = 21, 5
PIECE_ROWS, ROOM = 1 << 20, 96 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mask(chars: int) -> int:
    return (1 << (BITS * chars)) - 1


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The five characters that end at each place, exactly: (the two before, the last three), 21 bits a character."""
    c = codes.astype(np.int64)
    back = lambda k: np.concatenate([np.zeros(min(k, len(c)), np.int64), c[: max(len(c) - k, 0)]])
    return back(3) | back(4) << BITS, c | back(1) << BITS | back(2) << (2 * BITS)


def last(hi: np.ndarray, lo: np.ndarray, chars: int) -> tuple[np.ndarray, np.ndarray]:
    """The last characters of packed n-grams."""
    return hi & mask(max(chars - 3, 0)), lo & mask(min(chars, 3))


def before(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams without their last character."""
    return hi >> BITS, lo >> BITS | (hi & mask(1)) << (2 * BITS)


def key_of(hi: np.ndarray, lo: np.ndarray, kind: int, group: str = "") -> np.ndarray:
    """64-bit keys of packed n-grams of a kind (an order, say) in a group (a language)."""
    seed = np.uint64(xxhash.xxh3_64_intdigest(f"{kind}:{group}".encode("utf-8", "surrogatepass")))
    return mix(mix((lo.astype(np.uint64) ^ seed) * _ODD) ^ hi.astype(np.uint64))


def readable(spark, path: str) -> str:
    """The path as a URI that Arrow's file systems read on the executors."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()
    scheme, _, rest = uri.partition(":")
    return f"file://{'/' + rest.lstrip('/')}" if scheme == "file" else f"s3:{rest}" if scheme in ("s3a", "s3n") else uri


def write_table(rows: DataFrame, label: str, size: int) -> tuple[str, int]:
    """Store rows (key long, as the bits of an unsigned number, and value columns): where, and the bits that name a piece."""
    bits = max(0, math.ceil(math.log2(max(size, 1) / PIECE_ROWS)))
    path = new_path(rows.sparkSession, label)
    piece = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)
    rows.withColumn("piece", piece).repartition("piece").sortWithinPartitions("piece", "key").write.partitionBy("piece").parquet(path)
    return readable(rows.sparkSession, path), bits


class KeyTable:
    """Reads a stored table in a worker."""

    def __init__(self, uri: str, bits: int, columns: tuple[str, ...], room: int = ROOM):
        self.uri, self.bits, self.columns, self.room = uri, bits, columns, room
        self.held: OrderedDict[int, tuple[np.ndarray, ...]] = OrderedDict()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": OrderedDict()}

    def piece(self, number: int) -> tuple[np.ndarray, ...]:
        """(sorted keys, value columns) of a piece."""
        if number not in self.held:
            import pyarrow.fs as fs
            import pyarrow.parquet as pq

            system, path = fs.FileSystem.from_uri(self.uri)
            files = system.get_file_info(fs.FileSelector(f"{path}/piece={number}", allow_not_found=True))
            parts = [pq.read_table(f.path, filesystem=system, columns=["key", *self.columns], partitioning=None) for f in files if f.path.endswith(".parquet")]
            arrays = [np.concatenate([p[c].to_numpy() for p in parts]) if parts else np.zeros(0) for c in ("key", *self.columns)]
            keys = arrays[0].astype(np.int64).view(np.uint64)
            order = np.argsort(keys, kind="stable")
            self.held[number] = (keys[order], *(a[order] for a in arrays[1:]))
            while sum(sum(x.nbytes for x in v) for v in self.held.values()) > self.room and len(self.held) > 1:
                self.held.popitem(last=False)
        self.held.move_to_end(number)
        return self.held[number]

    def runs(self, wanted: np.ndarray) -> Iterator[tuple[slice, tuple[np.ndarray, ...], np.ndarray, np.ndarray]]:
        """For sorted distinct keys: slices of them with a piece, and where each key's rows begin and end in it."""
        number = (wanted >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(wanted), np.int64)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(wanted)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if a < b:
                held = self.piece(int(number[a]))
                yield slice(a, b), held, np.searchsorted(held[0], wanted[a:b]), np.searchsorted(held[0], wanted[a:b], side="right")

    def value(self, wanted: np.ndarray, column: int = 1) -> np.ndarray:
        """The value of each key of a table with distinct keys, NaN where unknown."""
        kinds, place = np.unique(wanted, return_inverse=True)
        out = np.full(len(kinds), np.nan)
        for part, held, a, b in self.runs(kinds):
            hit = b > a
            own = np.full(len(a), np.nan)
            own[hit] = held[column][a[hit]]
            out[part] = own
        return out[place]
