"""What a viewer needs of a collection: payload keys, facets, ramps, bounds, two-dimensional projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.filters import json_path, type_class


def payload_keys(points: DataFrame, payload: str = "payload") -> DataFrame:
    """Distinct top-level keys, sorted."""
    return points.select(F.explode(F.json_object_keys(payload)).alias("key")).distinct().orderBy("key")


def facet_profile(points: DataFrame, payload: str = "payload", early_stop: int = 40) -> DataFrame:
    """key, n_distinct, string_share, score: fewer distinct values, 2 to 14 of them and text make a better facet.

    Keys with fewer than two values have no score.
    """
    keyed = points.select(F.explode(F.from_json(payload, "map<string,variant>")).alias("key", "value"))
    seen = keyed.select("key", F.to_json("value").alias("text"), (type_class(F.col("value")) == "string").cast("int").alias("is_text"))
    stats = seen.groupBy("key").agg(F.count_distinct("text").alias("n_distinct"), F.avg("is_text").alias("string_share"))
    n = F.least(F.col("n_distinct"), F.lit(early_stop + 1))
    total = n + F.when(n.between(2, 14), 0).otherwise(50) + F.when(F.col("string_share") > 0.5, 0).otherwise(6)
    return stats.withColumn("score", F.when(F.col("n_distinct") >= 2, total))


def best_facet(points: DataFrame, payload: str = "payload") -> DataFrame:
    """The one key with the least score."""
    return facet_profile(points, payload).where("score IS NOT NULL").orderBy("score", "key").limit(1).select("key")


def field(points: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """id, value (text), number (null unless a JSON number) of one payload field."""
    v = F.try_variant_get(F.try_parse_json(payload), json_path(key), "variant")
    number = F.when(type_class(v).isin("int", "float"), F.try_variant_get(v, "$", "double"))
    return points.select("id", F.to_json(v).alias("value"), number.alias("number"))


def colour_codes(points: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """id, kind, position: a 0..1 ramp for numeric fields with over 8 values, else a code by sorted value."""
    rows = field(points, key, payload).where("value IS NOT NULL")
    kinds = rows.groupBy("value").agg(F.first("number").alias("number"))  # distinct values
    stats = kinds.agg(F.min("number").alias("lo"), F.max("number").alias("hi"), F.count(F.lit(1)).alias("n"), F.count("number").alias("numeric"))
    ramp = (F.col("numeric") == F.col("n")) & (F.col("n") > 8) & (F.col("hi") > F.col("lo"))
    whole = F.broadcast(stats.select("lo", "hi", ramp.alias("ramp")))  # one row
    position = (F.col("number") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    ramps = rows.join(whole).where("ramp").select("id", F.lit("ramp").alias("kind"), position.alias("position"))
    # codes: the values of a ramp are dropped before they are ranked; ranks are counted by ranges of values
    named = kinds.select("value").join(whole).where("NOT ramp").select("value")
    ranges = named.withColumn("cell", F.substring("value", 1, 3))
    counts = ranges.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(F.col("cell").alias("cell2"), F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    codes = ranges.join(starts, F.col("cell") == F.col("cell2")).select(F.col("value").alias("named"), (F.col("before") + F.row_number().over(Window.partitionBy("cell").orderBy("value")) - 1.0).alias("position"))
    return ramps.unionByName(rows.join(codes, F.col("value") == F.col("named")).select("id", F.lit("code").alias("kind"), "position"))


def bounds(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return points.agg(*[f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("min", F.min), ("max", F.max))])


def layout(points: DataFrame, x: str = "x", y: str = "y", pad: float = 0.06) -> DataFrame:
    """id, x, y in the unit square, proportions kept, `pad` free on each side; under four points: on a circle."""
    n = points.count()
    if n < 4:
        angle = (F.row_number().over(Window.orderBy("id")) - 1) * F.lit(6.283185307179586 / max(n, 1))
        return points.select("id", (F.lit(0.5) + 0.3 * F.cos(angle)).alias("x"), (F.lit(0.5) + 0.3 * F.sin(angle)).alias("y"))
    box = F.broadcast(bounds(points, x, y))
    wide = F.greatest(F.col(f"max_{x}") - F.col(f"min_{x}"), F.col(f"max_{y}") - F.col(f"min_{y}"), F.lit(1e-12))
    place = lambda c: F.lit(0.5) + (F.col(c) - (F.col(f"max_{c}") + F.col(f"min_{c}")) / 2) / wide * F.lit(1 - 2 * pad)
    return points.join(box).select("id", place(x).alias("x"), place(y).alias("y"))


def score_bars(hits: DataFrame) -> DataFrame:
    """Adds `bar`, the score scaled to 0..1 within the result list (at most k rows)."""
    every = Window.partitionBy(F.lit(0))  # a result list is k rows
    lo, wide = F.min("score").over(every), F.max("score").over(every) - F.min("score").over(every)
    return hits.withColumn("bar", F.when(wide > 0, (F.col("score") - lo) / wide).otherwise(1.0))


def pca_2d(points: DataFrame, rows: int | None = None) -> DataFrame:
    """id, x, y: centred principal components; each has its largest loading positive. rows: fit on that many (by hash)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from tessera.functions.vectors import constant, mean_vector

    fit = points if rows is None else points.orderBy(F.xxhash64("id")).limit(rows)
    first = mean_vector(fit).first()
    if first is None:
        return points.sparkSession.createDataFrame([], "id long, x double, y double")
    mean = list(first["mean"])
    k = min(2, len(mean))
    at = constant(mean)
    centred = lambda df: df.select("id", array_to_vector(F.zip_with(F.col("vector").cast("array<double>"), at, lambda a, b: a - b)).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(centred(fit))
    load = model.pc.toArray()
    signs = [1.0 if load[abs(load[:, c]).argmax(), c] >= 0 else -1.0 for c in range(k)]
    p = vector_to_array("p")
    return model.transform(centred(points)).select("id", (p[0] * signs[0]).alias("x"), (p[1] * signs[1] if k > 1 else F.lit(0.0)).alias("y"))
