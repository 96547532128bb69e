"""The corpus pipeline: quality classifier, exact dedup, near-dedup, mixing, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written and read again as the next one's docs.
All but the last return the columns of `documents`.

Edge cases, in every stage: rows are known by doc_id and text together, so null and repeated ids carry no other row along; null,
empty and blank texts are rejected by the quality stage, and would be one group of copies, linked with nothing, without tokens
and one piece with the end id alone in the later ones; texts of any length are read whole; ties go to the smaller doc_id, then
by a digest of the text; of equal rows one stays after exact dedup; null lang or source is a site and a leaf of its own; an
empty table gives an empty result; extra columns, whatever their names, are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, mixing, near_dedup, packing, quality_model
from tessera.llm.common import cut
from tessera.llm.queries import tokenizer_path

#: The share of the tokens that the mixing stage may keep: small leaves stay whole, leaves above their level are cut.
MIX_SHARE = 0.9
#: Near copies are collapsed from similarity 0.80 on: 40 x 5 bands miss a pair at 0.80 with probability 1.3e-7.
NEAR = {"percent": 80, "bands": 40, "loose": 0.55}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one_of_each(docs, **NEAR)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_stage(docs, MIX_SHARE)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("near dedup", near_stage), ("mixing", mix_stage), ("packing", pack_stage)]

#: Quality scores, near-duplicate groups, token ids and packing can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{k}")
    return docs
