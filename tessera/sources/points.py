"""Point sources: JSON lines, fvecs / ivecs, corpus documents with an embedding hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.ship import ship_package


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(vector, payload) from lines {"vector": [...], "payload": {...}}, in order of file path (as a URI) and place in the file.

    Blank lines are skipped, elements that aren't numbers are 0, a null payload is none; a line without a vector fails the read.
    The order takes a sort: Spark reads large pieces of files before small ones, whatever their names.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    place = ("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    ordered = lines.select("value", *place).orderBy("file_path", "file_block_start", "line")
    parsed = ordered.select(F.parse_json("value").alias("v"))
    raw = F.try_variant_get("v", "$.vector", "array<variant>")
    number = lambda x: F.when(F.schema_of_variant(x).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(x, "$", "float"))
    vector = F.transform(raw, lambda x: F.coalesce(number(x), F.lit(0.0).cast("float")))
    payload = F.try_variant_get("v", "$.payload", "variant")
    text = F.when(F.schema_of_variant(payload) != "VOID", F.to_json(payload))
    checked = F.when(raw.isNull(), F.raise_error("a line has no vector")).otherwise(vector)
    return parsed.select(checked.cast("array<float>").alias("vector"), text.alias("payload"))


def read_vecs(spark: SparkSession, path: str, kind: str = "f") -> DataFrame:
    """(file, ordinal, vector) from .fvecs ('f') or .ivecs ('i') files: little-endian [int32 d][d values] records."""
    if kind not in ("f", "i"):
        raise ValueError("kind is 'f' or 'i'")
    ship_package(spark)
    element = "float" if kind == "f" else "int"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                words = np.frombuffer(content.as_buffer(), "<i4")
                if not len(words):
                    continue
                d = int(words[0])
                if d < 1 or len(words) % (d + 1) or (words[:: d + 1] != d).any():
                    raise ValueError(f"{file} isn't a file of equal {kind}vecs records")
                body = words.reshape(-1, d + 1)[:, 1:]
                for s in range(0, len(body), 4096):
                    part = np.ascontiguousarray(body[s : s + 4096]).view("<f4" if kind == "f" else "<i4")
                    lists = pa.ListArray.from_arrays(np.arange(0, part.size + 1, d, dtype=np.int32), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array(np.arange(s, s + len(part))), lists], ["file", "ordinal", "vector"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, f"file string, ordinal long, vector array<{element}>")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(text, category) from one JSON array of documents."""
    return spark.read.schema("text string, category string").json(path, multiLine=True)


def expand_corpus(corpus: DataFrame, framings: Sequence[str], n: int) -> DataFrame:
    """n documents: every text in each framing ('{}' stands for the text), framing by framing.

    Whole framings need no order: only the last one, if n ends inside it, is cut at a place in order of category and text.
    """
    size = corpus.count()
    whole, rest = divmod(n, size) if size else (len(framings), 0)
    text = lambda f: F.replace(F.lit(f), F.lit("{}"), F.col("text"))
    frames = F.array(*[F.struct(text(f).alias("text"), F.col("category")) for f in framings[:whole]])  # a given short list
    out = corpus.select(F.inline(frames)) if whole else corpus.limit(0).select("text", "category")
    if rest and whole < len(framings):
        last = corpus.orderBy("category", "text").limit(rest).select(text(framings[whole]).alias("text"), "category")
        out = out.unionByName(last)
    return out


def embed(corpus: DataFrame, model: Callable[[Column], Column]) -> DataFrame:
    """Adds `vector` by a Column function (say a pandas UDF around a local model) and packs the rest as the payload."""
    return corpus.select(model(F.col("text")).cast("array<float>").alias("vector"), F.to_json(F.struct(*corpus.columns)).alias("payload"))
