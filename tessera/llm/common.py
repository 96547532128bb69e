"""What the corpus operators share: cutting lineage, reading settings, slicing Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.fs import shared_dir
from tessera.sources.ship import ship_package

#: The ASCII white space of the contracts, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession) -> None:
    """Make this package known to the Python workers."""
    ship_package(spark)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_digest(text: str | Column) -> Column:
    """16 bytes that stand for a text; null and empty differ."""
    c = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("t"), c), F.lit("null"))))


def keep_rows(docs: DataFrame, verdicts: DataFrame, once: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay.

    verdicts: one row for each row of docs, columns key, digest (row_digest of the text), stays. Rows are known by key
    and text, so a repeated or null key can't carry another row along. Of rows that are equal in both, as many
    stay as have the verdict (once: one at most).
    """
    same = verdicts.groupBy(F.col(key).alias("__tessera_key"), F.col("digest").alias("__tessera_digest"))
    stay = F.sum(F.col("stays").cast("long"))
    counts = same.agg((F.least(stay, F.lit(1)) if once else stay).alias("stay"), F.count(F.lit(1)).alias("all")).where("stay > 0")
    counts = cut(counts, "verdicts")
    named = docs.withColumn("__tessera_mark", row_digest(F.col(text)))
    match = lambda wanted: named[key].eqNullSafe(wanted["__tessera_key"]) & (named["__tessera_mark"] == wanted["__tessera_digest"])
    whole = counts.where("stay = all")
    out = named.join(whole, match(whole), "left_semi")
    some = counts.where("stay < all")
    if not some.isEmpty():  # only equal rows of which some go
        order = Window.partitionBy("__tessera_key", "__tessera_digest").orderBy(F.lit(0))
        chosen = named.join(some, match(some)).withColumn("__tessera_place", F.row_number().over(order)).where("__tessera_place <= stay")
        out = out.unionByName(chosen.select(*named.columns))
    return out.drop("__tessera_mark")


def utf8_size(text: str | Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of at most `most` bytes (a longer text stands alone)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
