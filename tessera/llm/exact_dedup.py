"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

1. The text without ASCII white space is cut into chunks whose ends depend on content alone: a chunk of
   `least` to `most` characters ends at the first triple of neighbouring letters from fixed classes, about one in a hundred, so
   equal passages soon give equal chunks wherever they stand.
2. Chunks get identifiers: a 64-bit hash, verified against the dictionary of distinct chunk contents. A hash
   that two different contents share is told apart by the rank of the content.
3. A text is the ordered list of its chunk identifiers. Texts are compared by these short lists; the long text
   itself is never moved again. Equal texts give equal chunks, so equal lists, and verified equal lists give
   equal texts.

Only distinct chunk contents are shuffled (deduplicated on the map side first), once. A group of copies of any
size is one aggregate row; it goes back to the documents by a join that adaptive execution may split.

Edge cases: null text counts as empty, and all empty texts are one group; a null doc_id loses ties to any other;
rows that repeat a doc_id each count in group_size, and `kept` holds for all of them (the doc_id stays), `stays` only for
the one text; keep_one returns one row of each group, also of rows that are the same in all columns; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, cut, keep_rows, row_digest


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def chunks_of(norm: Column, least: int, most: int) -> Column:
    """Content-defined chunks as array<string>; the empty text has none."""
    pattern = rf"(?s).{{{least},{most}}}?(?:[aeinrst][hlmou][aeinrst]|[、。，！？；：])|.{{1,{most}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 128, most: int = 4000) -> DataFrame:
    """key, digest, code_points, text_sha256 and recipe: array of (hash, rank) identifiers, verified on content."""
    base = docs.select(F.col(key).alias("id"), F.col(text).alias("raw"))
    chunked = base.select("id", chunks_of(normalised("raw"), least, most).alias("chunks"))
    contents = chunked.select(F.explode("chunks").alias("chunk")).select(F.xxhash64("chunk").alias("h"), "chunk").groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("uses"))
    shared = contents.groupBy("h").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1")
    clashes = cut(shared.select("h"), "chunk-clashes")
    norm = normalised("raw")
    plain = base.select(
        "id",
        row_digest(F.col("raw")).alias("digest"),
        F.length(F.coalesce("raw", F.lit(""))).cast("long").alias("code_points"),
        F.sha2(norm, 256).alias("text_sha256"),
        F.transform(chunks_of(norm, least, most), lambda c: F.struct(F.xxhash64(c).alias("h"), F.lit("").alias("content"))).alias("recipe"),
    )
    if clashes.isEmpty():
        return plain
    # rare: documents that use a clashing hash name the content of that chunk in full
    rows = base.select("id", F.sha2(norm, 256).alias("text_sha256"), F.posexplode(chunks_of(norm, least, most)).alias("pos", "chunk")).withColumn("h", F.xxhash64("chunk"))
    named = rows.join(clashes, "h").groupBy(F.col("id").alias("id2"), F.col("text_sha256").alias("sha2")).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("pos", "chunk")))).alias("named"))
    joined = plain.join(named, plain.id.eqNullSafe(named.id2) & (plain.text_sha256 == named.sha2), "left")
    full = F.transform("recipe", lambda c, i: F.struct(c.h.alias("h"), F.coalesce(F.col("named")[i], F.lit("")).alias("content")))
    return joined.select("id", "digest", "code_points", "text_sha256", F.when(F.col("named").isNull(), F.col("recipe")).otherwise(full).alias("recipe"))


def exact_rows(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 128, most: int = 4000) -> DataFrame:
    """One row per document: key, digest, keep_id, group_size, kept, text_sha256, n_chunks, stays.

    Of equal texts the row with the most code points in its original text stays, then the smallest key; `stays` marks
    that row alone (and rows that are the same in key and text), `kept` each row with its key.
    """
    listed = cut(recipes(docs, text, key, least, most).withColumn("recipe", F.transform("recipe", lambda c: F.when(c.content == "", c.h.cast("string")).otherwise(F.concat(c.h.cast("string"), F.lit(":"), c.content)))), "recipes")
    best = F.max(F.struct("code_points", F.col("id").isNotNull().alias("known"), (-F.col("id")).alias("less"), "digest")).alias("best")
    heads = listed.groupBy("recipe").agg(F.count(F.lit(1)).alias("n"), best).where("n > 1")
    # a table of its own, so that the join has its own exchanges, which adaptive execution may split at a hot recipe
    heads = cut(heads.select(F.col("recipe").alias("same"), "n", (-F.col("best.less")).alias("head"), F.col("best.digest").alias("head_digest")), "recipe-heads")
    out = listed.join(heads, F.col("recipe") == F.col("same"), "left")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("head"))
    stays = F.col("n").isNull() | (F.col("id").eqNullSafe(keep) & (F.col("digest") == F.col("head_digest")))
    return out.select(F.col("id").alias(key), "digest", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks"), stays.alias("stays"))


def exact_dedup(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256, n_chunks (settings as in exact_rows)."""
    return exact_rows(docs, **settings).drop("digest", "stays")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all its columns."""
    return keep_rows(docs, exact_rows(docs), once=True)
