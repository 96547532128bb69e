"""Operators built from searches: fusion of ranked lists, recommendation by example, recall and latency figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.filters import Filter
from tessera.functions.vectors import Metric, mean_vector
from tessera.operators.search import admit, top_k

RRF_K = 60.0


def reciprocal_rank_fusion(lists: DataFrame, top: int, k: float = RRF_K) -> DataFrame:
    """(id, score) from rows (list_id, id, rank from 1): sum of 1 / (k + rank), as a float, best first, ties by id."""
    fused = lists.groupBy("id").agg(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))).cast("float").alias("score"))
    return fused.orderBy(F.desc("score"), "id").limit(top)


def ranked(hits: DataFrame, list_id: int, metric: Metric | str) -> DataFrame:
    """Turn one result list (at most k rows) into rows for fusion."""
    best = F.col("score").desc() if Metric.parse(metric).higher_is_better else F.col("score").asc()
    return hits.select(F.lit(list_id).alias("list_id"), "id", F.row_number().over(Window.orderBy(best, "id")).alias("rank"))


def example_vector(points: DataFrame, positive: Sequence[int], negative: Sequence[int], metric: Metric | str) -> list[float]:
    """mean(positive) - mean(negative); an id given twice counts twice, unknown ids are skipped."""
    spark = points.sparkSession
    if not positive and not negative:
        raise LookupError("recommend needs an example")
    asked = spark.createDataFrame([(int(i), s) for s, ids in ((1, positive), (-1, negative)) for i in ids], "id long, side int")
    found = asked.join(points.where(F.col("id").isin([*positive, *negative])).select("id", "vector"), "id")
    means = {side: mean_vector(found.where(F.col("side") == side)).first() for side in (1, -1)}
    if not any(means.values()):
        raise LookupError("no example could be found")
    up, down = (list(m["mean"]) if m else None for m in (means[1], means[-1]))
    out = [a - b for a, b in zip(up, down, strict=True)] if up and down else up or [-x for x in down]
    if Metric.parse(metric).normalises:
        norm = sum(x * x for x in out) ** 0.5
        out = [x / norm for x in out] if norm > 0 else out
    return out


def recommend(points: DataFrame, positive: Sequence[int], negative: Sequence[int] = (), k: int = 10, metric: Metric | str = "cosine", where: Filter | Column | None = None, examples: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The k best for the examples, positives left out. examples: where example vectors are looked up (default: points)."""
    query = example_vector(points if examples is None else examples, positive, negative, metric)
    others = admit(points, where)
    if positive:
        others = others.where(~F.col("id").isin(list(positive)))
    return top_k(others, query, k, metric, keep=keep)


def recall(truth: DataFrame, got: DataFrame, k: int) -> DataFrame:
    """One row `recall`: the share of true neighbours (query_id, id) that were found."""
    hit = truth.join(got.select("query_id", "id"), ["query_id", "id"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    return hit.join(truth.agg(F.count_distinct("query_id").alias("queries"))).select((F.col("hits") / (F.col("queries") * k)).alias("recall"))


def latency_profile(df: DataFrame, value: str, points: Sequence[float] = (50, 99)) -> DataFrame:
    """One row: mean and nearest-rank percentiles (place round(p / 100 * (n - 1)), half up) and the rate n / sum.

    Values are counted first; running counts are taken in ranges of values, so no task sorts them all.
    """
    kept = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    counts = kept.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    total = kept.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.sum("v").alias("sum")).first()
    n = total["n"]
    # the value at a place: narrow the range by distributed quantiles, then count what lies below
    out = {"mean": total["mean"], "qps": n / total["sum"] if total["sum"] else None}
    for p in points:
        out[f"p{p:g}"] = _at(counts, int(p / 100 * (n - 1) + 0.5), n) if n else None
    spark = df.sparkSession
    return spark.createDataFrame([tuple(out.values())], ", ".join(f"{k} double" for k in out))


def _at(counts: DataFrame, place: int, n: int) -> float:
    """The value at a 0-based place of the sorted multiset (v, n)."""
    ranges = counts.withColumn("cell", F.floor(F.col("v") / F.lit(_step(counts))))
    cells = ranges.groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").collect()
    below = 0
    for c in cells:
        if below + c["n"] > place:
            inside = ranges.where(F.col("cell") == c["cell"]).withColumn("upto", F.sum("n").over(Window.orderBy("v")) + below)
            return inside.where(F.col("upto") > place).agg(F.min("v")).first()[0]
        below += c["n"]
    raise AssertionError("place out of range")


def _step(counts: DataFrame, cells: int = 4096) -> float:
    low, high = counts.agg(F.min("v"), F.max("v")).first()
    return max((high - low) / cells, 1e-300) if high > low else 1.0
