"""Vector arithmetic as Columns (higher-order functions), in double precision, sums left to right.

A constant query is one folded literal. Unrolling it into plain arithmetic was measured and is several times slower:
the generated method is too large for the JIT.
"""

from __future__ import annotations

from collections.abc import Sequence
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Metric(str, Enum):
    COSINE = "cosine"
    DOT = "dot"
    EUCLIDEAN = "euclidean"

    @classmethod
    def parse(cls, name: str | Metric) -> Metric:
        try:
            return cls(str(getattr(name, "value", name)).lower())
        except ValueError:
            raise ValueError(f"unknown metric {name!r}; one of cosine, dot, euclidean") from None

    @property
    def higher_is_better(self) -> bool:
        return self is not Metric.EUCLIDEAN

    @property
    def normalises(self) -> bool:
        """Stored vectors are scaled to length one at ingest."""
        return self is Metric.COSINE

    @property
    def worst(self) -> float:
        return float("-inf") if self.higher_is_better else float("inf")


def _col(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def _constant(v: Column | str | Sequence[float]) -> bool:
    return not isinstance(v, (Column, str))


def constant(q: Sequence[float]) -> Column:
    """A literal array of doubles, folded once by the optimiser."""
    return F.expr("array(" + ", ".join(f"CAST('{float(x)!r}' AS DOUBLE)" for x in q) + ")" if len(q) else "CAST(array() AS ARRAY<DOUBLE>)")


def _fold(a: Column, b: Column, term) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def _pairwise(a, b, term) -> Column:
    a = _col(a)
    return _fold(a, constant(b) if _constant(b) else _col(b), term)


def dot(a, b) -> Column:
    """Sum of products; null where the sizes differ."""
    return _pairwise(a, b, lambda x, y: x * y)


def squared_l2(a, b) -> Column:
    """Sum of squared differences (no root)."""
    return _pairwise(a, b, lambda x, y: (x - y) * (x - y))


def score(metric: Metric | str, vector, query) -> Column:
    """The metric's score of a stored vector against a raw query (cosine: stored vectors have length one, the query isn't scaled)."""
    return squared_l2(vector, query) if Metric.parse(metric) is Metric.EUCLIDEAN else dot(vector, query)


def badness(metric: Metric | str, value: Column) -> Column:
    """Ascending is better."""
    return -value if Metric.parse(metric).higher_is_better else value


def order(metric: Metric | str, score_name: str = "score", id_name: str = "id") -> list[Column]:
    """Best first, ties by ascending id."""
    s = F.col(score_name)
    return [s.desc_nulls_last() if Metric.parse(metric).higher_is_better else s.asc_nulls_last(), F.col(id_name).asc()]


def l2_norm(v) -> Column:
    v = _col(v)
    return F.sqrt(_fold(v, v, lambda x, y: x * y))


def l2_normalize(v) -> Column:
    """Scaled to length one, as floats; a zero vector stays as it is."""
    v = _col(v)
    norm = l2_norm(v)
    return F.when(norm > 0, F.transform(v, lambda x: (x.cast("double") / norm).cast("float"))).otherwise(v.cast("array<float>"))


def finite(v) -> Column:
    """No null, NaN or infinite component."""
    return F.forall(_col(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def max_abs(v) -> Column:
    return F.array_max(F.transform(_col(v), lambda x: F.abs(x.cast("double"))))


def preview(v, n: int = 6, digits: int = 3) -> Column:
    """The first n components as text."""
    v = _col(v)
    head = F.array_join(F.transform(F.slice(v, 1, n), lambda x: F.format_number(x, digits)), ", ")
    return F.concat(F.lit("["), head, F.when(F.size(v) > n, F.lit(", …]")).otherwise(F.lit("]")))


def q8_scale(df: DataFrame, vector: str = "vector") -> Column:
    """Aggregate: the largest magnitude over 127, or 1 for an all-zero store."""
    top = F.max(max_abs(vector))
    return F.when(top > 0, top / 127).otherwise(F.lit(1.0))


def q8_encode(v, scale: Column | float) -> Column:
    """Signed bytes: round(x / scale) half away from zero, held within 127."""
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.transform(_col(v), lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round(x.cast("double") / s))).cast("tinyint"))


def dot_int(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda s, x: s + x)


def squared_l2_int(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("int") - y.cast("int")) * (x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: s + x)


def q8_badness(metric: Metric | str, a, b) -> Column:
    return squared_l2_int(a, b) if Metric.parse(metric) is Metric.EUCLIDEAN else -dot_int(a, b)


def mean_vector(df: DataFrame, vector: str = "vector") -> DataFrame:
    """One row: the element-wise mean (doubles), by position aggregates with map-side sums; no row from no vector."""
    means = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("mean"))  # as many rows as dimensions
    return packed.where(F.size("mean") > 0)
