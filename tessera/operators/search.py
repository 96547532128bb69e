"""Exact and approximate nearest neighbours, point lookups and rescoring over (id, vector, payload) tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.filters import Filter
from tessera.functions.vectors import Metric, order, q8_badness, q8_encode, q8_scale, score
from tessera.sources.ship import ship_package

#: Query vectors sent to the tasks at once; larger query sets go in blocks of this many bytes.
BLOCK_BYTES = 8 << 20
#: Entries of the largest matrix of scores in a task (16 MB): queries are scored against a batch in tiles.
TILE = 2 << 20


def top_k(points: DataFrame, query: Sequence[float], k: int, metric: Metric | str = "cosine", where: Filter | Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(id, score) of the k best, ties by id: each task keeps k rows, one merge of those."""
    metric = Metric.parse(metric)
    rows = admit(points, where)
    scored = rows.select("id", score(metric, "vector", list(query)).alias("score"), *keep)
    # rows without a score sort last and go after the limit: a filter before it would score every row twice
    return scored.orderBy(*order(metric)).limit(max(0, k)).where("score IS NOT NULL")


def admit(points: DataFrame, where: Filter | Column | None) -> DataFrame:
    if where is None:
        return points
    if isinstance(where, Column):
        return points.where(where)
    return points if where.empty else points.where(where.column())


def live(points: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows whose id isn't deleted."""
    return points.join(tombstones.select("id"), "id", "left_anti")


def among(points: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is in an allow-list."""
    return points.join(ids.select("id"), "id", "left_semi")


def best_per_id(hits: DataFrame, metric: Metric | str) -> DataFrame:
    """One row per id, the better score."""
    s = F.max("score") if Metric.parse(metric).higher_is_better else F.min("score")
    return hits.groupBy("id").agg(s.alias("score"))


def batch_top_k(points: DataFrame, queries: DataFrame, k: int, metric: Metric | str = "cosine", exclude_self: bool = False) -> DataFrame:
    """(query_id, id, score, rank) for many queries: matrix products per Arrow batch, k rows per query and task, one merge.

    queries: query_id, vector. They are read in blocks of at most BLOCK_BYTES; every block scans the points once.
    """
    metric = Metric.parse(metric)
    spark = points.sparkSession
    ship_package(spark)
    if k <= 0:
        return spark.createDataFrame([], "query_id long, id long, score double, rank int")
    base = points.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<float>").alias("vector")).where("vector IS NOT NULL")
    n, dim = asked.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    blocks = max(1, -(-n * (dim or 1) * 8 // BLOCK_BYTES))
    parts = []
    for b in range(blocks):
        one = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        table = one.toArrow()
        ids = table["query_id"].to_numpy()
        q = _matrix(table["vector"].combine_chunks(), dim or 1)
        sent = spark.sparkContext.broadcast((ids, q, (q * q).sum(1)))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            query_ids, m, squares = sent.value
            held: list[tuple[np.ndarray, np.ndarray]] = []  # ids and badness, one row per query
            for batch in batches:
                if not batch.num_rows or not len(query_ids):
                    continue
                v = _matrix(batch.column("vector"), m.shape[1])
                point = batch.column("id").to_numpy()
                own = (v * v).sum(1)
                tiles, step = [], max(1, TILE // len(point))
                for t in range(0, len(query_ids), step):
                    bad = m[t : t + step] @ v.T
                    bad = squares[t : t + step, None] + own - 2 * bad if metric is Metric.EUCLIDEAN else -bad
                    if exclude_self:
                        bad[query_ids[t : t + step, None] == point[None, :]] = np.inf
                    tiles.append(_least(np.broadcast_to(point, bad.shape), bad, k))
                held.append(tuple(np.concatenate(x) for x in zip(*tiles, strict=True)))
                if len(held) > 8:
                    held = [_least(*(np.concatenate(x, 1) for x in zip(*held, strict=True)), k)]
            if held:
                point, bad = _least(*(np.concatenate(x, 1) for x in zip(*held, strict=True)), k)
                real = np.isfinite(bad)
                rows = np.repeat(query_ids, real.sum(1))
                value = bad[real]
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(point[real]), pa.array(np.maximum(value, 0) if metric is Metric.EUCLIDEAN else -value)], ["query_id", "id", "score"])

        parts.append(base.where(F.size("vector") == (dim or 1)).mapInArrow(best, "query_id long, id long, score double"))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    ranked = Window.partitionBy("query_id").orderBy(*order(metric))
    return hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _least(ids: np.ndarray, bad: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least of each row by (badness, id)."""
    if bad.shape[1] > 4 * k:
        # ties at the k-th value may straddle the cut, so everything up to that value is kept for the exact sort
        edge = np.partition(bad, k - 1, axis=1)[:, k - 1 : k]
        most = int((bad <= edge).sum(1).max())
        at = np.argpartition(bad, min(most, bad.shape[1]) - 1, axis=1)[:, :most]
        ids, bad = np.take_along_axis(ids, at, 1), np.take_along_axis(bad, at, 1)
    at = np.lexsort((ids, bad), axis=1)[:, :k]
    return np.take_along_axis(ids, at, 1), np.take_along_axis(bad, at, 1)


def rescored_top_k(points: DataFrame, query: Sequence[float], k: int, metric: Metric | str = "cosine", oversample: int = 4, scale: float | None = None) -> DataFrame:
    """Rank all by int8 codes, keep k * oversample, score those exactly, keep k."""
    metric = Metric.parse(metric)
    if scale is None:
        scale = points.agg(q8_scale(points).alias("s")).first()["s"]
    codes = [int(max(-127, min(127, np.sign(x) * np.floor(abs(x) / scale + 0.5)))) for x in query]
    coded = points.select("id", "vector", q8_badness(metric, q8_encode("vector", float(scale)), F.expr("array(" + ", ".join(map(str, codes)) + ")")).alias("q"))
    rough = coded.orderBy("q", "id").limit(k * oversample)
    return top_k(rough, query, k, metric)


def similar_to(points: DataFrame, point_id: int, k: int, metric: Metric | str = "cosine") -> DataFrame:
    """The k nearest to a stored point, itself left out."""
    found = points.where(F.col("id") == point_id).select("vector").first()
    if found is None:
        raise KeyError(f"no point {point_id}")
    return top_k(points.where(F.col("id") != point_id), found["vector"], k, metric)


def get_point(points: DataFrame, point_id: int) -> DataFrame:
    return points.where(F.col("id") == point_id)


def scroll(points: DataFrame, offset: int = 0, limit: int = 2000) -> tuple[DataFrame, int]:
    """A page by ascending id and the number of all rows."""
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit can't be negative")
    return points.orderBy("id").offset(offset).limit(limit), points.count()
