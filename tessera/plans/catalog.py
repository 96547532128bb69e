"""Named collections under one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.vectors import Metric
from tessera.plans.collection import Collection, NotFound
from tessera.plans.policy import Clock, Compaction, Versioning, system_clock
from tessera.sources.fs import Files


class Catalog:
    def __init__(self, spark: SparkSession, root: str, clock: Clock = system_clock):
        self.spark, self.root, self.clock, self.files = spark, root.rstrip("/"), clock, Files(spark)

    def _path(self, name: str) -> str:
        if not name or "/" in name or name.startswith("."):
            raise ValueError(f"not a collection name: {name!r}")
        return f"{self.root}/{name}"

    def create(self, name: str, dim: int, metric: Metric | str = "cosine", versioning: Versioning | None = None, compaction: Compaction | None = None) -> Collection:
        return Collection.create(self.spark, self._path(name), name, dim, metric, versioning, compaction, self.clock)

    def open(self, name: str) -> Collection:
        return Collection(self.spark, self._path(name), self.clock)

    def names(self) -> list[str]:
        return [n for n in self.files.names(self.root) if self.files.exists(f"{self.root}/{n}/config.json")]

    def list(self) -> DataFrame:
        """By name: name, dim, metric, count, head_version."""
        rows = [tuple(self.open(n).stats().values()) for n in self.names()]
        return self.spark.createDataFrame(rows, "name string, dim int, metric string, count long, head_version long").orderBy("name")

    def drop(self, name: str) -> None:
        if not self.files.exists(f"{self._path(name)}/config.json"):
            raise NotFound(name)
        self.files.delete(self._path(name))
