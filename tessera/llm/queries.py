"""The registered queries of the corpus operators and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, language, mixing, near_dedup, packing, pii, quality_model, quality_rules, sharding, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pack_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), 4096)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_exact_dedup_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(_table(spark, sf_dir, "documents"), 8)


def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op5_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op6_near_dedup_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"))


def op7_language_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


#: op8: budget as a share of all tokens, passes over a leaf, weights of domains d0..d3 and of languages.
MIX = {"share": 0.6, "epochs": 2, "seed": 17}


def op8_mix_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = {"domain": F.substring("domain", 2, 1).cast("double") + 1.0, "lang": F.when((F.col("domain") == "d1") & (F.col("lang") == "es"), 0.0).when(F.col("lang") == "en", 4.0).otherwise(1.0)}
    return mixing.mix(_table(spark, sf_dir, "documents"), weights=weights, **MIX)


def op9_quality_empirical_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_pack_sum_of_squares, op2_exact_dedup_recipes, op3_kd_shards, op4_warc_salvage, op5_pii_skip_chain, op6_near_dedup_odd_sketch, op7_language_backoff, op8_mix_hierarchical, op9_quality_empirical_bayes, op10_perplexity_rules)
    return {f.__name__: f for f in found}


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS head FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to FROM m
"""
EXACT_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
h AS (SELECT *, sha256(norm) AS text_sha256 FROM n)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id) AS kept,
       text_sha256
FROM h
"""


def _fill(name: str, source: str, parent: str, child: str) -> str:
    """Water filling of one level; source has parent columns, child, usable supply c, weight w and budget b."""
    part = f"PARTITION BY {parent}" if parent else ""
    keys = f"{parent}, " if parent else ""
    return f"""
{name}_b AS (SELECT *, CASE WHEN w > 0 THEN c / w ELSE 0 END AS r FROM {source}),
{name}_c AS (SELECT *,
    coalesce(sum(c) OVER ({part} ORDER BY r, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      + r * sum(w) OVER ({part} ORDER BY r, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= b AS is_full FROM {name}_b),
{name}_d AS (SELECT *, sum(CASE WHEN is_full THEN c ELSE 0 END) OVER ({part}) AS fc, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({part}) AS ow FROM {name}_c),
{name} AS (SELECT {keys}{child}, CASE WHEN w <= 0 THEN 0 WHEN is_full THEN c ELSE w * ((b - fc) / ow) END AS alloc FROM {name}_d)"""


MIX_SQL = (
    f"""
WITH base AS (
  SELECT doc_id, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, (strlen(coalesce(text, '')) + 3) // 4 AS tokens FROM documents),
crc AS (SELECT source, domain FROM ({{crc}})),
dealt AS (SELECT base.*, crc.domain FROM base JOIN crc USING (source)),
leaves AS (SELECT domain, lang, source, sum(tokens)::DOUBLE AS tokens, {float(MIX["epochs"])}::DOUBLE * sum(tokens)::DOUBLE AS c, 1.0::DOUBLE AS w FROM dealt GROUP BY ALL),
mids AS (SELECT domain, lang, w, CASE WHEN w > 0 THEN c ELSE 0 END AS c FROM (
  SELECT domain, lang, sum(c) AS c, (CASE WHEN domain = 'd1' AND lang = 'es' THEN 0 WHEN lang = 'en' THEN 4 ELSE 1 END)::DOUBLE AS w FROM leaves GROUP BY domain, lang)),
tops AS (SELECT domain, sum(c) AS c, substring(domain, 2, 1)::DOUBLE + 1 AS w, (SELECT floor(sum(tokens) * {MIX["share"]}::DOUBLE) FROM leaves) AS b FROM mids GROUP BY ALL),"""
    + _fill("t", "tops", "", "domain")
    + ", mb AS (SELECT mids.*, t.alloc AS b FROM mids JOIN t USING (domain)),"
    + _fill("m", "mb", "domain", "lang")
    + ", lb AS (SELECT leaves.*, m.alloc AS b FROM leaves JOIN m USING (domain, lang)),"
    + _fill("l", "lb", "domain, lang", "source")
    + f""",
plan AS (SELECT leaves.domain, leaves.lang, leaves.source, floor(alloc + 1e-6)::BIGINT AS leaf_budget, tokens AS supply FROM l JOIN leaves USING (domain, lang, source)),
plan2 AS (SELECT *, CASE WHEN supply > 0 THEN floor(leaf_budget / supply)::BIGINT ELSE 0 END AS passes FROM plan),
keyed AS (SELECT dealt.*, leaf_budget, passes, leaf_budget - passes * supply AS rest,
          md5(concat_ws(':', '{MIX["seed"]}', (passes + 1)::VARCHAR, doc_id::VARCHAR)) AS o FROM dealt JOIN plan2 USING (domain, lang, source)),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY o, tokens ROWS UNBOUNDED PRECEDING) AS upto FROM keyed)
SELECT doc_id, domain, lang, source, tokens::BIGINT AS tokens, leaf_budget,
       (passes + CASE WHEN upto <= rest AND passes < {MIX["epochs"]} AND (rest > 0 OR tokens > 0) THEN 1 ELSE 0 END)::BIGINT AS epochs
FROM run
"""
)


def _crc_table() -> str:
    """crc32 of the text table's sources, which DuckDB can't compute: domains of src0..src99 as literal rows."""
    import zlib

    names = ["?", *(f"src{k}" for k in range(100))]
    return "SELECT * FROM (VALUES " + ", ".join(f"('{n}', 'd{zlib.crc32(n.encode()) % 4}')" for n in names) + ") v(source, domain)"


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup_recipes": EXACT_SQL, "op4_warc_salvage": WARC_SQL, "op8_mix_hierarchical": MIX_SQL.replace("{crc}", _crc_table())}
