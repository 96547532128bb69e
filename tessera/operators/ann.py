"""Approximate search by inverted lists: k-means cells, the nearest cells probed, exact scores inside them.

Used only when its measured recall passes a gate; otherwise, and when a filter leaves fewer than k hits, the exact search answers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.filters import Filter
from tessera.functions.vectors import Metric, order
from tessera.operators.search import batch_top_k, top_k


def _aim(queries: np.ndarray, metric: Metric) -> np.ndarray:
    """Rows as they are compared with centres: by cosine at length one, so that a query's length changes no cell."""
    if metric is not Metric.COSINE:
        return queries
    length = np.linalg.norm(queries, axis=1, keepdims=True)
    return queries / np.where(length > 0, length, 1)


class IvfIndex:
    """Cells fitted on at most `fit_rows` points (by hash); every point is assigned. Tables: rows with `cell`."""

    def __init__(self, rows: DataFrame, centres: np.ndarray, metric: Metric, probes: int):
        self.rows, self.centres, self.metric, self.probes = rows, centres, metric, probes
        self.recall: float | None = None

    @classmethod
    def build(cls, points: DataFrame, cells: int, metric: Metric | str = "cosine", probes: int = 4, fit_rows: int = 100_000, seed: int = 1) -> IvfIndex:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        ready = points.withColumn("features", array_to_vector(F.col("vector").cast("array<double>")))
        sample = ready.orderBy(F.xxhash64("id")).limit(fit_rows)
        model = KMeans(k=cells, seed=seed, maxIter=15, featuresCol="features", predictionCol="cell").fit(sample)
        rows = model.transform(ready).drop("features")
        return cls(rows, np.array(model.clusterCenters()), Metric.parse(metric), probes)

    def ordered_cells(self, query: Sequence[float]) -> list[int]:
        """All cells, nearest centre first."""
        return [int(c) for c in np.argsort(((self.centres - _aim(np.asarray([query], float), self.metric)) ** 2).sum(1), kind="stable")]

    def near_cells(self, query: Sequence[float]) -> list[int]:
        return self.ordered_cells(query)[: self.probes]

    def write(self, path: str) -> IvfIndex:
        """The same index over a table partitioned by cell, so that a search reads only the probed folders."""
        spread = F.pmod(F.xxhash64("id"), F.lit(16))  # a cell with many rows is several tasks and files
        self.rows.repartition("cell", spread).write.partitionBy("cell").parquet(path)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.rows.schema)
        stored = IvfIndex(self.rows.sparkSession.read.schema(schema).parquet(path), self.centres, self.metric, self.probes)
        stored.recall = self.recall
        return stored

    @classmethod
    def read(cls, spark: SparkSession, path: str, schema: str, centres: Sequence[Sequence[float]], metric: Metric | str, probes: int) -> IvfIndex:
        """An index that `write` stored; schema: of its rows without `cell`."""
        rows = spark.read.schema(f"{schema}, cell int").parquet(path)
        return cls(rows, np.array(centres), Metric.parse(metric), probes)

    def near_rows(self, query: Sequence[float]) -> DataFrame:
        """The rows of the probed cells."""
        return self.rows.where(F.col("cell").isin(self.near_cells(query)))

    def approximate(self, query: Sequence[float], k: int, where: Filter | Column | None = None) -> DataFrame:
        return top_k(self.near_rows(query), query, k, self.metric, where)

    def _places(self, queries: DataFrame) -> DataFrame:
        """query_id, vector, cell, place: each query's cells, nearest centre (place 0) first."""
        centres, squares, metric = self.centres, (self.centres**2).sum(1), self.metric

        def order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if f.empty:
                    continue
                v = _aim(np.array(f["vector"].tolist(), float), metric)
                near = np.argsort(squares - 2 * v @ centres.T, axis=1, kind="stable")
                n = near.shape[1]
                at = np.repeat(np.arange(len(f)), n)
                yield pd.DataFrame({"query_id": f["query_id"].to_numpy()[at], "vector": f["vector"].to_numpy()[at], "cell": near.ravel(), "place": np.tile(np.arange(n), len(f))})

        return queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").mapInPandas(order, "query_id long, vector array<float>, cell int, place int")

    def measure(self, queries: DataFrame, k: int = 10, gate: float | None = None) -> float:
        """recall@k over a query set, against brute force; with a gate, by the fewest probes that reach it.

        Probed cells are scanned exactly, so a true neighbour is found if and only if its cell is probed: the places
        of the true neighbours' cells in each query's order give the recall of every number of probes at once.
        """
        truth = batch_top_k(self.rows.select("id", "vector"), queries, k, self.metric).select("query_id", "id")
        near = truth.join(self.rows.select("id", "cell"), "id").join(self._places(queries).drop("vector"), ["query_id", "cell"])
        counts = np.zeros(len(self.centres))
        for r in near.groupBy("place").count().collect():  # a row a cell at most
            counts[r["place"]] = r["count"]
        recalls = np.cumsum(counts) / counts.sum() if counts.sum() else np.ones(len(counts))
        if gate is not None:
            self.probes = int(np.argmax(recalls >= gate)) + 1  # with all cells it is 1
        self.recall = float(recalls[self.probes - 1])
        return self.recall

    def search(self, query: Sequence[float], k: int, where: Filter | Column | None = None, exact: bool = False, gate: float = 0.95) -> DataFrame:
        """The approximate hits where the measured recall passes the gate; the exact ones otherwise, or where a filter leaves fewer than k."""
        if exact or self.recall is None or self.recall < gate:
            return top_k(self.rows, query, k, self.metric, where)
        hits = self.approximate(query, k, where)
        if where is None:
            return hits
        found = hits.collect()  # k rows
        if len(found) < k:
            return top_k(self.rows, query, k, self.metric, where)
        return hits.sparkSession.createDataFrame(found, hits.schema)

    def search_many(self, queries: DataFrame, k: int, part_rows: int = 100_000) -> DataFrame:
        """(query_id, id, score, rank): queries and points meet by cell, large cells in parts; k rows a query and part are merged."""
        sizes = self.rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))  # a row a cell
        points = self.rows.join(F.broadcast(sizes), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").cast("long").alias("id"), "vector")
        asked = self._places(queries).where(F.col("place") < self.probes).join(F.broadcast(sizes), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query_id", "vector")
        euclidean = self.metric is Metric.EUCLIDEAN

        def best(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(q) and len(p):
                v, ids = np.array(p["vector"].tolist(), float), p["id"].to_numpy()
                for i, x in zip(q["query_id"], q["vector"], strict=True):
                    bad = ((v - np.asarray(x, float)) ** 2).sum(1) if euclidean else -(v @ np.asarray(x, float))
                    near = np.lexsort((ids, bad))[:k]
                    out.append(pd.DataFrame({"query_id": i, "id": ids[near], "score": bad[near] if euclidean else -bad[near]}))
            return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})

        hits = asked.groupBy("cell", "part").cogroup(points.groupBy("cell", "part")).applyInPandas(best, "query_id long, id long, score double")
        ranked = Window.partitionBy("query_id").orderBy(*order(self.metric))
        return hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
