"""K-d tree partitioning into shards of near equal bytes (DataFrame functions only).

Each row is a point of metadata dimensions with a weight, its bytes. A node with several leaves is split at the
distributed weighted median (or the share its leaves ask for) of its widest dimension, until each leaf is one
shard of about the target bytes. Widths are compared relative to the whole table's range.

The median is found by radix refinement: rows of a node are counted by 12-bit digits of their place in the
dimension, then of a hash of their text, then of a hash of their key, each pass only inside the cell where the
target falls. So a pass sends at most 4096 sums per node and task, a value or a group of equal texts that holds a
third of all rows is cut like any other, and equal texts of equal metadata stay together unless their group
alone would unbalance a node by more than `loose`.

The driver sees one row per node. Slots come from counts of hash cells and row numbers inside cells, so no shard
is sorted in one task.

Edge cases: null text has size 1; null metadata counts as the lowest place; rows that repeat a key are placed
each (a slot each); an empty table gives an empty result; fewer rows than shards leave shards empty; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, partitions, utf8_size

_DIGIT, _BITS = 4096, 12


def default_dimensions() -> dict[str, Column]:
    """The metadata of documents that equal texts share: length (log scale) and language (hashed place)."""
    return {"length": F.log2(F.coalesce(F.col("n_chars"), F.lit(0)).cast("double") + 1.0), "language": F.crc32(F.coalesce(F.col("lang"), F.lit(""))) / F.lit(4294967296.0)}


def _values(spark, rows: list[tuple], names: str, casts: list[str]) -> DataFrame:
    """A small table of literals, at most one row per shard."""
    lines = ", ".join("(" + ", ".join(f"CAST('{v}' AS {c})" for v, c in zip(r, casts, strict=True)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {lines} AS t({names})")


def _split(rows: DataFrame, dims: list[str], leaves: dict[int, int], span: dict[str, float], tight: float, loose: float) -> tuple[DataFrame, dict[int, int]]:
    """One level: each node (named by its first leaf) with several leaves becomes two."""
    spark = rows.sparkSession
    ends = [f(F.col(d)).alias(f"{a}_{d}") for d in dims for a, f in (("lo", F.min), ("hi", F.max))]
    stats = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("w").alias("w"), *ends).collect()}
    todo = [n for n, k in leaves.items() if k > 1]
    plan = []
    for n in todo:
        s = stats.get(n)
        if s is None:
            continue
        width = {d: (s[f"hi_{d}"] - s[f"lo_{d}"]) / span[d] for d in dims}
        wide = max(dims, key=lambda d: width[d])
        step = s[f"hi_{wide}"] - s[f"lo_{wide}"]
        plan.append((n, dims.index(wide), s[f"lo_{wide}"], ((1 << 24) - 1) / step if step > 0 else 0.0, s["w"], s["w"] * (leaves[n] // 2) / leaves[n]))
    after = dict(leaves)
    for n in todo:
        half = leaves[n] // 2
        after[n], after[n + half] = half, leaves[n] - half
    if not plan:
        return rows, after
    params = F.broadcast(_values(spark, [p[:4] for p in plan], "node, dim, low, scale", ["INT", "INT", "DOUBLE", "DOUBLE"]))
    value = F.coalesce(*[F.when(F.col("dim") == i, F.col(d)) for i, d in enumerate(dims)])
    at = F.floor((value - F.col("low")) * F.col("scale")).cast("long")
    keyed = rows.join(params, "node").select("node", "w", (F.shiftleft(at, 24) + F.col("tie")).alias("k1"), F.col("sub").alias("k2"))
    cell = {p[0]: (0, 0) for p in plan}  # the digits so far, as k1 and k2
    left = {p[0]: p[5] for p in plan}  # weight still to go left of the cut, inside the cell
    whole = {p[0]: p[4] for p in plan}
    cuts: dict[int, tuple[int, int]] = {}
    for depth in range(6):
        open_ = [n for n in cell if n not in cuts]
        if not open_:
            break
        shift = (36, 24, 12, 0, 12, 0)[depth]
        digit = F.shiftright("k1" if depth < 4 else "k2", shift) % F.lit(_DIGIT)
        limits = F.broadcast(_values(spark, [(n, cell[n][0], cell[n][1], left[n]) for n in open_], "node, c1, c2, aim", ["INT", "BIGINT", "BIGINT", "DOUBLE"]))
        inside = F.shiftright("k1", shift + _BITS) == F.shiftright("c1", shift + _BITS) if depth < 4 else (F.col("k1") == F.col("c1")) & (F.shiftright("k2", shift + _BITS) == F.shiftright("c2", shift + _BITS))
        sums = keyed.join(limits, "node").where(inside).groupBy("node", "aim", digit.alias("digit")).agg(F.sum("w").alias("s"))
        run = Window.partitionBy("node").orderBy("digit")  # at most 4096 rows a node
        sums = sums.withColumn("upto", F.sum("s").over(run)).withColumn("most", F.max("digit").over(Window.partitionBy("node")))
        for r in sums.where("upto >= aim OR digit = most").groupBy("node").agg(F.min(F.struct("digit", "s", "upto")).alias("x")).collect():
            n, x = r["node"], r["x"]
            c1, c2 = cell[n]
            c1, c2 = (c1 + (x["digit"] << shift), c2) if depth < 4 else (c1, c2 + (x["digit"] << shift))
            before = x["upto"] - x["s"]
            cell[n] = (c1, c2)
            if x["s"] <= whole[n] * (loose if depth == 3 else tight) or depth == 5:
                over = x["upto"] - left[n] < left[n] - before  # the nearer edge of the cell
                cuts[n] = (c1 + ((1 << shift) if over else 0), c2) if depth < 4 else (c1, c2 + ((1 << shift) if over else 0))
            left[n] -= before
    edges = F.broadcast(_values(spark, [(*p[:4], *cuts[p[0]], leaves[p[0]] // 2) for p in plan], "node, dim, low, scale, c1, c2, half", ["INT", "INT", "DOUBLE", "DOUBLE", "BIGINT", "BIGINT", "INT"]))
    k1 = F.shiftleft(at, 24) + F.col("tie")
    right = (k1 > F.col("c1")) | ((k1 == F.col("c1")) & (F.col("sub") >= F.col("c2")))
    moved = rows.join(edges, "node", "left").withColumn("node", F.when(right, F.col("node") + F.col("half")).otherwise(F.col("node")))
    return cut(moved.select(*rows.columns), "kd"), after


def kd_shards(docs: DataFrame, shards: int = 8, dimensions: dict[str, Column] | None = None, text: str = "text", key: str = "doc_id", tight: float = 0.0005, loose: float = 0.002, target_bytes: int | None = None) -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard (null).

    target_bytes, if given, decides the number of shards: as many leaves as make their mean the target or less.
    """
    if target_bytes is not None and target_bytes < 1:
        raise ValueError("target_bytes must be positive")
    dims = dimensions or default_dimensions()
    raw = F.coalesce(F.col(text), F.lit(""))
    mask = lambda c: F.shiftrightunsigned(c, 40)  # noqa: E731  24 bits
    rows = docs.select(
        F.col(key).alias("id"), (utf8_size(text) + 1).alias("w"), F.crc32(raw.cast("binary")).alias("crc"), F.lit(0).alias("node"),
        mask(F.xxhash64(raw)).alias("tie"), mask(F.xxhash64(F.col(key), F.lit(9))).alias("sub"),
        *[F.coalesce(c, F.lit(0.0)).cast("double").alias(f"d_{d}") for d, c in dims.items()],
    )
    rows = cut(rows, "kd")
    names = [f"d_{d}" for d in dims]
    ends = rows.agg(*[(F.max(d) - F.min(d)).alias(d) for d in names], F.coalesce(F.sum("w"), F.lit(0)).alias("__w")).first()
    span = {d: ends[d] or 1.0 for d in names}
    if target_bytes is not None:
        shards = max(1, -(-ends["__w"] // target_bytes))
    leaves = {0: shards}
    while max(leaves.values()) > 1:
        rows, leaves = _split(rows, names, leaves, span, tight, loose)
    placed = rows.withColumn("cell", F.pmod(F.xxhash64("sub", "id"), F.lit(4 * partitions(docs.sparkSession))))
    counts = placed.groupBy("node", "cell").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(F.col("node").alias("node2"), F.col("cell").alias("cell2"), F.coalesce(F.sum("n").over(Window.partitionBy("node").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = placed.withColumn("k", F.row_number().over(Window.partitionBy("node", "cell").orderBy("sub", "id")) - 1)
    out = numbered.join(starts, (F.col("node") == F.col("node2")) & (F.col("cell") == F.col("cell2")))
    return out.select(F.col("id").alias(key), F.col("w").alias("size"), F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("node").alias("shard"), (F.col("before") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
