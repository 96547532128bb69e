"""The registered queries of the engine's operators, each with DuckDB SQL where SQL can express it.

Points are `embeddings` (vec_id, embedding, label) with the payload {"label": ...}; JSON filters also run over
`events` with its `props`. Scores are rounded to six places on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.functions.filters import Condition, Filter, Range, contains_text, parse_conditions
from tessera.operators import ann, compose, explore, search
from tessera.plans.catalog import Catalog
from tessera.plans.collection import Collection, import_collection
from tessera.plans.policy import Compaction, Versioning, compaction_due, pending_after_commit, should_rebuild
from tessera.sources.fs import shared_dir
from tessera.plans.versions import At, Manifest, Refs, Retention, Segment, gc_plan, retained

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


# --- inputs


def points(spark: SparkSession, sf_dir: str, scaled: bool = False) -> DataFrame:
    """id, vector, payload, label; scaled: rows times 1 + id % 3, so that norms differ."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vector = F.col("embedding")
    if scaled:
        vector = F.transform(vector, lambda x: (x * (1 + F.col("vec_id") % 3).cast("float")).cast("float"))
    return rows.select(F.col("vec_id").alias("id"), vector.alias("vector"), F.to_json(F.struct("label")).alias("payload"), "label")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.col("props").alias("payload"), "event_type", "value")


def vector_of(df: DataFrame, point_id: int) -> list[float]:
    return list(df.where(F.col("id") == point_id).select("vector").first()[0])


def rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6) + F.lit(0.0))


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the shared place for collections that a query builds."""
    return f"{shared_dir(spark)}/collections/{label}-{uuid.uuid4().hex}"


#: SQL of the points; D is the double vector.
P = "p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS d, label FROM embeddings)"
S = "p AS (SELECT vec_id AS id, list_transform(embedding, lambda x: (x * (1 + vec_id % 3)::FLOAT)::FLOAT)::DOUBLE[] AS d, label FROM embeddings)"


def _knn(source: str, score: str, ascending: bool = False, where: str = "TRUE", k: int = 10, query: str = "(SELECT d FROM p WHERE id = 0)") -> str:
    return f"""WITH {source}, q AS (SELECT {query} AS v)
SELECT id, round({score}, 6) + 0.0 AS score FROM p, q WHERE {where} ORDER BY {score} {'ASC' if ascending else 'DESC'}, id LIMIT {k}"""


DOT, L2 = "list_dot_product(d, v)", "(list_distance(d, v) * list_distance(d, v))"

# --- exact search


@register(_knn(P, DOT))
def knn_cosine(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(search.top_k(p, vector_of(p, 0), 10, "cosine"))


@register(_knn(S, DOT, query="(SELECT d FROM p WHERE id = 1)"))
def knn_dot(spark, sf_dir):
    p = points(spark, sf_dir, True)
    return rounded(search.top_k(p, vector_of(p, 1), 10, "dot"))


@register(_knn(S, L2, True, query="(SELECT d FROM p WHERE id = 1)"))
def knn_euclidean(spark, sf_dir):
    p = points(spark, sf_dir, True)
    return rounded(search.top_k(p, vector_of(p, 1), 10, "euclidean"))


@register(f"""WITH {P}, t AS (SELECT id, d FROM p UNION ALL SELECT id + 1000000, d FROM p), q AS (SELECT (SELECT d FROM p WHERE id = 3) AS v)
SELECT id, round({DOT}, 6) + 0.0 AS score FROM t, q ORDER BY {DOT} DESC, id LIMIT 7""")
def knn_tie_break(spark, sf_dir):
    p = points(spark, sf_dir)
    twice = p.unionByName(p.withColumn("id", F.col("id") + 1_000_000))
    return rounded(search.top_k(twice, vector_of(p, 3), 7, "dot"))


@register(f"""WITH {P}, q AS (SELECT id AS query_id, d AS v FROM p WHERE id % 50 = 0),
r AS (SELECT query_id, id, {DOT} AS s, row_number() OVER (PARTITION BY query_id ORDER BY {DOT} DESC, id) AS rank FROM p, q)
SELECT query_id, id, round(s, 5) + 0.0 AS score, rank::INT AS rank FROM r WHERE rank <= 5""")
def knn_batch(spark, sf_dir):
    p = points(spark, sf_dir)
    asked = p.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    return search.batch_top_k(p, asked, 5, "cosine").withColumn("score", F.round("score", 5) + F.lit(0.0))


@register(f"""WITH {S}, q AS (SELECT id AS query_id, d AS v FROM p WHERE id % 50 = 0),
r AS (SELECT query_id, id, {L2} AS s, row_number() OVER (PARTITION BY query_id ORDER BY {L2}, id) AS rank FROM p, q WHERE id <> query_id)
SELECT query_id, id, round(s, 5) + 0.0 AS score, rank::INT AS rank FROM r WHERE rank <= 5""")
def knn_batch_euclidean(spark, sf_dir):
    p = points(spark, sf_dir, True)
    asked = p.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    return search.batch_top_k(p, asked, 5, "euclidean", exclude_self=True).withColumn("score", F.round("score", 5) + F.lit(0.0))


def _filtered(spark, sf_dir, where: Filter) -> DataFrame:
    p = points(spark, sf_dir)
    return rounded(search.top_k(p, vector_of(p, 0), 10, "cosine", where))


@register(_knn(P, DOT, where="label = 3"))
def knn_filtered_must(spark, sf_dir):
    return _filtered(spark, sf_dir, Filter(must=[Condition("label", match=3)]))


@register(_knn(P, DOT, where="label = 1 OR label >= 8"))
def knn_filtered_should(spark, sf_dir):
    return _filtered(spark, sf_dir, Filter(should=[Condition("label", match=1), Condition("label", range=Range(gte=8))]))


@register(_knn(P, DOT, where="NOT (label < 5)"))
def knn_filtered_must_not(spark, sf_dir):
    return _filtered(spark, sf_dir, Filter(must_not=[Condition("label", range=Range(lt=5)), Condition("absent", match="x")]))


@register(_knn(P, DOT, where="label > 1 AND label <= 7 AND label <> 4 AND (label = 2 OR label = 6)"))
def knn_filtered_combined(spark, sf_dir):
    return _filtered(spark, sf_dir, Filter.parse({"must": [{"key": "label", "range": {"gt": 1, "lte": 7}}], "must_not": [{"key": "label", "match": 4}], "should": [{"key": "label", "match": 2}, {"key": "label", "match": 6}]}))


@register("SELECT event_id AS id FROM events WHERE json_extract(props, '$.k')::BIGINT = 7")
def filter_match_int(spark, sf_dir):
    return events(spark, sf_dir).where(Filter(must=[Condition("k", match=7)]).column()).select("id")


@register("SELECT event_id AS id FROM events WHERE json_extract(props, '$.k')::BIGINT >= 20 AND json_extract(props, '$.k')::BIGINT < 40")
def filter_range_json(spark, sf_dir):
    return events(spark, sf_dir).where(Filter.parse('{"must": [{"key": "k", "range": {"gte": 20, "lt": 40}}]}').column()).select("id")


@register("SELECT event_id AS id FROM events WHERE json_extract(props, '$.k')::BIGINT = 12 AND json_extract(props, '$.k')::BIGINT <= 50")
def filter_builder(spark, sf_dir):
    return events(spark, sf_dir).where(parse_conditions([("k", "=", "12"), ("k", "lte", "50"), ("k", "gt", "many")]).column()).select("id")


@register("SELECT event_id AS id FROM events WHERE contains(event_id::VARCHAR, '42') OR contains(lower(props), '42')")
def browse_filter(spark, sf_dir):
    return events(spark, sf_dir).where(contains_text(" 42 ")).select("id")


_TYPED = ['{"n":3}', '{"n":3.0}', '{"n":"3"}', '{"n":null}', '{"m":3}', '{"n":true}', None]


@register("""WITH t(id, p) AS (VALUES (0, '{"n":3}'), (1, '{"n":3.0}'), (2, '{"n":"3"}'), (3, '{"n":null}'), (4, '{"m":3}'), (5, '{"n":true}'), (6, NULL))
SELECT id::BIGINT AS id, coalesce(json_type(p, '$.n') IN ('UBIGINT', 'BIGINT') AND json_extract_string(p, '$.n') = '3', FALSE) AS is_int,
  coalesce(json_type(p, '$.n') = 'DOUBLE' AND TRY_CAST(json_extract_string(p, '$.n') AS DOUBLE) = 3, FALSE) AS is_float,
  coalesce(json_type(p, '$.n') = 'VARCHAR' AND json_extract_string(p, '$.n') = '3', FALSE) AS is_text,
  coalesce(json_type(p, '$.n') IN ('UBIGINT', 'BIGINT', 'DOUBLE'), FALSE) AS is_number,
  NOT coalesce(json_type(p, '$.n') IN ('UBIGINT', 'BIGINT') AND json_extract_string(p, '$.n') = '3', FALSE) AS isnt_int FROM t""")
def filter_type_sensitive(spark, sf_dir):
    rows = spark.createDataFrame(list(enumerate(_TYPED)), "id long, payload string")
    must = lambda **c: Filter(must=[Condition("n", **c)]).column()
    return rows.select("id", must(match=3).alias("is_int"), must(match=3.0).alias("is_float"), must(match="3").alias("is_text"), must(range=Range()).alias("is_number"), Filter(must_not=[Condition("n", match=3)]).column().alias("isnt_int"))


@register(_knn(P, DOT, where="id % 7 = 0"))
def knn_id_allowlist(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(search.top_k(search.among(p, p.where("id % 7 = 0").select("id")), vector_of(p, 0), 10, "cosine"))


@register(_knn(P, DOT, where="id % 3 <> 0"))
def knn_tombstoned(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(search.top_k(search.live(p, p.where("id % 3 = 0").select("id")), vector_of(p, 0), 10, "cosine"))


@register(_knn(P, DOT, where="id <> 5", query="(SELECT d FROM p WHERE id = 5)"))
def query_by_point(spark, sf_dir):
    return rounded(search.similar_to(points(spark, sf_dir), 5, 10, "cosine"))


@register(f"""WITH {P}, q AS (SELECT (SELECT d FROM p WHERE id = 2) AS v), a AS (SELECT id, {DOT} AS s FROM p, q),
x AS (SELECT id, s FROM a WHERE id < 300), y AS (SELECT id, s FROM a WHERE id >= 200)
SELECT id, round(max(s), 6) + 0.0 AS score FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY id ORDER BY max(s) DESC, id LIMIT 10""")
def segment_merge(spark, sf_dir):
    p = points(spark, sf_dir)
    v = vector_of(p, 2)
    parts = [search.top_k(x, v, 10, "dot") for x in (p.where("id < 300"), p.where("id >= 200"))]
    return rounded(search.best_per_id(parts[0].unionByName(parts[1]), "dot").orderBy(*V.order("dot")).limit(10))


# --- vector arithmetic


@register(f"WITH {S} SELECT id, round(sqrt(list_dot_product(d, d)), 6) AS norm FROM p")
def l2_norm(spark, sf_dir):
    return points(spark, sf_dir, True).select("id", F.round(V.l2_norm("vector"), 6).alias("norm"))


@register(f"""WITH {S}, n AS (SELECT id, d, sqrt(list_dot_product(d, d)) AS m FROM p)
SELECT id, g.i - 1 AS place, round((d[g.i] / m)::FLOAT::DOUBLE, 5) + 0.0 AS x FROM n, range(1, 65) g(i)""")
def l2_normalize(spark, sf_dir):
    rows = points(spark, sf_dir, True).select("id", F.posexplode(V.l2_normalize("vector")).alias("place", "x"))
    return rows.select("id", F.col("place").cast("long").alias("place"), (F.round(F.col("x").cast("double"), 5) + F.lit(0.0)).alias("x"))


@register(f"""WITH {S} SELECT a.id AS a_id, b.id AS b_id, round(list_dot_product(a.d, b.d), 6) + 0.0 AS dot,
round(list_distance(a.d, b.d) * list_distance(a.d, b.d), 6) + 0.0 AS squared_l2 FROM p a JOIN p b ON b.id = a.id + 1""")
def pairwise_scores(spark, sf_dir):
    p = points(spark, sf_dir, True)
    b = p.select((F.col("id") - 1).alias("a_id"), F.col("id").alias("b_id"), F.col("vector").alias("w"))
    both = p.join(b, F.col("id") == F.col("a_id"))
    return both.select("a_id", "b_id", (F.round(V.dot("vector", F.col("w")), 6) + F.lit(0.0)).alias("dot"), (F.round(V.squared_l2("vector", F.col("w")), 6) + F.lit(0.0)).alias("squared_l2"))


@register("SELECT round(max(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))) / 127, 9) AS scale FROM embeddings")
def q8_scale(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.agg(F.round(V.q8_scale(p), 9).alias("scale"))


Q8 = """s AS (SELECT max(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))) / 127 AS scale FROM embeddings),
c AS (SELECT vec_id AS id, embedding::DOUBLE[] AS d, list_transform(embedding, lambda x: greatest(-127, least(127, round(x::DOUBLE / scale))))::INT[] AS codes FROM embeddings, s)"""


@register(f"WITH {Q8} SELECT id, g.i - 1 AS place, codes[g.i]::INT AS code FROM c, range(1, 65) g(i)")
def q8_encode(spark, sf_dir):
    p = points(spark, sf_dir)
    scale = p.agg(V.q8_scale(p).alias("s")).first()[0]
    rows = p.select("id", F.posexplode(V.q8_encode("vector", scale)).alias("place", "code"))
    return rows.select("id", F.col("place").cast("long").alias("place"), F.col("code").cast("int").alias("code"))


@register(f"""WITH {Q8}, q AS (SELECT d AS v, codes AS qc FROM c WHERE id = 0),
r AS (SELECT id, d, v FROM c, q ORDER BY -list_dot_product(codes::DOUBLE[], qc::DOUBLE[]), id LIMIT 40)
SELECT id, round({DOT}, 6) + 0.0 AS score FROM r ORDER BY {DOT} DESC, id LIMIT 10""")
def q8_rescore_topk(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(search.rescored_top_k(p, vector_of(p, 0), 10, "dot", 4))


@register(f"""WITH {P} SELECT vec_id AS id, round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS max_abs, len(embedding)::INT AS dim FROM embeddings""")
def component_stats(spark, sf_dir):
    return points(spark, sf_dir).select("id", F.round(V.max_abs("vector"), 6).alias("max_abs"), F.size("vector").alias("dim"))


# --- recommendation and fusion


def _recommend_sql(positive: list[int], negative: list[int], k: int = 8) -> str:
    values = lambda ids: ", ".join(f"({i})" for i in ids)
    mean = lambda name, ids: f"{name} AS (SELECT i, avg(d[i]) AS m FROM p JOIN (VALUES {values(ids)}) e(x) ON p.id = e.x, range(1, 65) g(i) GROUP BY i)"
    parts = ([mean("up", positive)] if positive else []) + ([mean("down", negative)] if negative else [])
    value = "up.m - down.m" if positive and negative else "up.m" if positive else "-down.m"
    source = "up JOIN down USING (i)" if positive and negative else "up" if positive else "down"
    return f"""WITH {P}, {', '.join(parts)}, raw AS (SELECT list({value} ORDER BY i) AS r FROM {source}),
q AS (SELECT list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS v FROM raw)
SELECT id, round({DOT}, 5) + 0.0 AS score FROM p, q WHERE id NOT IN ({', '.join(map(str, positive)) or '-1'}) ORDER BY {DOT} DESC, id LIMIT {k}"""


def _recommend(spark, sf_dir, positive, negative):
    hits = compose.recommend(points(spark, sf_dir), positive, negative, 8, "cosine")
    return hits.withColumn("score", F.round("score", 5) + F.lit(0.0))


@register(_recommend_sql([1, 2, 3], []))
def recommend_pos(spark, sf_dir):
    return _recommend(spark, sf_dir, [1, 2, 3], [])


@register(_recommend_sql([1, 2, 2], [7, 9]))
def recommend_pos_neg(spark, sf_dir):
    return _recommend(spark, sf_dir, [1, 2, 2], [7, 9])


@register(_recommend_sql([], [4, 11]))
def recommend_neg_only(spark, sf_dir):
    return _recommend(spark, sf_dir, [], [4, 11])


@register(f"""WITH {P}, l AS (SELECT 1 AS list_id, id, row_number() OVER (ORDER BY list_dot_product(d, (SELECT d FROM p WHERE id = 0)) DESC, id) AS rank FROM p
UNION ALL SELECT 2, id, row_number() OVER (ORDER BY list_dot_product(d, (SELECT d FROM p WHERE id = 1)) DESC, id) FROM p),
f AS (SELECT id, sum(1.0::DOUBLE / (60 + rank))::FLOAT AS s FROM l WHERE rank <= 20 GROUP BY id)
SELECT id, round(s::DOUBLE, 6) + 0.0 AS score FROM f ORDER BY s DESC, id LIMIT 10""")
def rrf_fusion(spark, sf_dir):
    p = points(spark, sf_dir)
    lists = [compose.ranked(search.top_k(p, vector_of(p, i), 20, "dot"), i + 1, "dot") for i in (0, 1)]
    fused = compose.reciprocal_rank_fusion(lists[0].unionByName(lists[1]), 10)
    return fused.withColumn("score", F.round(F.col("score").cast("double"), 6) + F.lit(0.0))


# --- pages, points, counts


@register("SELECT vec_id AS id, label, (SELECT count(*) FROM embeddings WHERE vec_id % 4 <> 1) AS total FROM embeddings WHERE vec_id % 4 <> 1 ORDER BY vec_id LIMIT 25 OFFSET 40")
def scroll_page(spark, sf_dir):
    p = points(spark, sf_dir)
    page, total = search.scroll(search.live(p, p.where("id % 4 = 1").select("id")), 40, 25)
    return page.select("id", "label", F.lit(total).cast("long").alias("total"))


@register("SELECT vec_id AS id, label FROM embeddings WHERE vec_id = 42")
def get_point(spark, sf_dir):
    return search.get_point(points(spark, sf_dir), 42).select("id", "label")


@register("SELECT count(*) AS live, (SELECT count(*) FROM embeddings) AS rows FROM embeddings WHERE vec_id % 5 <> 0")
def live_count(spark, sf_dir):
    p = points(spark, sf_dir)
    alive = search.live(p, p.where("id % 5 = 0").select("id")).agg(F.count(F.lit(1)).alias("live"))
    return alive.join(p.agg(F.count(F.lit(1)).alias("rows")))


@register("SELECT vec_id // 100 AS segment, min(vec_id) AS id_lo, max(vec_id) AS id_hi, count(*) AS n FROM embeddings GROUP BY ALL")
def segment_stats(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.groupBy(F.floor(F.col("id") / 100).alias("segment")).agg(F.min("id").alias("id_lo"), F.max("id").alias("id_hi"), F.count(F.lit(1)).alias("n"))


# --- versions: two batches, deletes, commits, tags, branches


def _versioned(spark: SparkSession, sf_dir: str, label: str) -> Collection:
    """v0: ids below 300 (tag base); v1: the rest added, multiples of 10 deleted (branch work); then odd ids below 20 deleted, uncommitted."""
    c = Collection.create(spark, scratch(spark, label), label, 64, "dot", clock=lambda: 1_700_000_000_000)
    p = points(spark, sf_dir).orderBy("id").select("id", "vector", "payload")
    c.upsert(p.where("id < 300").coalesce(1).sortWithinPartitions("id"))
    c.commit("first", "base")
    rest = p.where("id >= 300").coalesce(1).sortWithinPartitions("id")
    c.write_batch(rest, p.where("id % 10 = 0").select("id"), commit=True, message="second")
    c.branch("work", 1)
    c.write_batch(deletes=p.where("id < 20 AND id % 2 = 1").select("id"))
    return c


def _view(df: DataFrame) -> DataFrame:
    """Rows with every component, as text of its value in millionths."""
    whole = F.array_join(F.transform("vector", lambda x: F.round(x.cast("double") * 1_000_000).cast("long").cast("string")), " ")
    return df.select("id", whole.alias("vector"), F.get_json_object("payload", "$.label").cast("int").alias("label"))


_WHOLE = "array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE * 1000000)::BIGINT::VARCHAR), ' ') AS vector"
_VIEW = f"SELECT vec_id AS id, {_WHOLE}, label FROM embeddings WHERE "


@register(_VIEW + "vec_id < 300")
def as_of_tag(spark, sf_dir):
    return _view(_versioned(spark, sf_dir, "as_of_tag").read(At(tag="base")))


@register(_VIEW + "vec_id < 300")
def as_of_version(spark, sf_dir):
    return _view(_versioned(spark, sf_dir, "as_of_version").read(At(version=0)))


@register(_VIEW + "NOT (vec_id < 300 AND vec_id % 10 = 0)")
def as_of_branch(spark, sf_dir):
    return _view(_versioned(spark, sf_dir, "as_of_branch").read(At(branch="work")))


@register(_VIEW + "NOT (vec_id < 300 AND vec_id % 10 = 0) AND NOT (vec_id < 20 AND vec_id % 2 = 1)")
def live_view(spark, sf_dir):
    return _view(_versioned(spark, sf_dir, "live_view").read())


@register(_knn(P, DOT, where="id < 300"))
def search_as_of(spark, sf_dir):
    c = _versioned(spark, sf_dir, "search_as_of")
    return rounded(c.search(vector_of(points(spark, sf_dir), 0), 10, at=At(version=0)))


@register("SELECT vec_id AS id, CASE WHEN vec_id < 300 THEN 'removed' ELSE 'added' END AS change FROM embeddings WHERE vec_id >= 300 OR vec_id % 10 = 0")
def version_diff(spark, sf_dir):
    return _versioned(spark, sf_dir, "version_diff").diff(0, 1)


@register("SELECT vec_id AS id, 'removed' AS change FROM embeddings WHERE vec_id < 20 AND vec_id % 2 = 1")
def diff_after_compact(spark, sf_dir):
    c = _versioned(spark, sf_dir, "diff_after_compact")
    c.compact()
    c.commit("compacted")
    return c.diff(1, 2)


@register(_VIEW + "vec_id < 300")
def restore_state(spark, sf_dir):
    c = _versioned(spark, sf_dir, "restore_state")
    c.restore(0)
    return _view(c.read())


@register("""SELECT * FROM (VALUES (0::BIGINT, -1::BIGINT, 1700000000000::BIGINT, 'manual', 'first', 1::INT), (1, 0, 1700000000000, 'batch', 'second', 2), (2, 1, 1700000000000, 'restore', 'restore of v0', 1))
v(version, parent, created_at_ms, "trigger", message, n_segments)""")
def version_log(spark, sf_dir):
    c = _versioned(spark, sf_dir, "version_log")
    c.restore(0)
    return c.versions().drop("tags").withColumn("parent", F.coalesce("parent", F.lit(-1).cast("long")))


@register("""SELECT (SELECT min(vec_id) FROM embeddings WHERE vec_id >= 300) AS first_id, (SELECT count(*) FROM embeddings WHERE vec_id >= 300) AS n,
(SELECT count(*) FROM embeddings WHERE vec_id < 300 AND vec_id % 6 = 0) AS deleted, 0::BIGINT AS version""")
def write_batch_result(spark, sf_dir):
    c = Collection.create(spark, scratch(spark, "write_batch_result"), "b", 64, "dot")
    p = points(spark, sf_dir)
    c.upsert(p.where("id < 300").coalesce(1))
    ids = p.where("id % 6 = 0").select("id")  # those not yet inserted don't count, nor do repeats
    r = c.write_batch(p.where("id >= 300"), ids.union(ids), commit=True)
    return spark.createDataFrame([(r.first_id, r.count, r.deleted, r.version)], "first_id long, n long, deleted long, version long")


@register(_VIEW.replace("label FROM", "label, 1::INT AS segments FROM") + "NOT (vec_id < 300 AND vec_id % 10 = 0) AND NOT (vec_id < 20 AND vec_id % 2 = 1)")
def compaction_preserves(spark, sf_dir):
    c = _versioned(spark, sf_dir, "compaction_preserves")
    c.compact()
    return _view(c.read()).withColumn("segments", F.lit(len(c.head().segments)))


@register("SELECT 'embeddings' AS name, 64::INT AS dim, 'dot' AS metric, count(*) AS count, 1::BIGINT AS head_version FROM embeddings WHERE NOT (vec_id < 300 AND vec_id % 10 = 0) AND NOT (vec_id < 20 AND vec_id % 2 = 1)")
def collection_stats(spark, sf_dir):
    s = _versioned(spark, sf_dir, "embeddings").stats()
    return spark.createDataFrame([tuple(s.values())], "name string, dim int, metric string, count long, head_version long")


def _history() -> list[Manifest]:
    a, b, c = (Segment(n, 0, 4, 5) for n in ("a", "b", "c"))
    lists = [(a,), (a, b), (a, b, c), (c,)]
    return [Manifest(i, i - 1 if i else None, 0, "manual", None, s, (), 5) for i, s in enumerate(lists)]


@register("SELECT * FROM (VALUES ('guards', 0::BIGINT), ('guards', 1), ('guards', 3), ('plain', 3), ('last_2', 2), ('last_2', 3), ('all', 0), ('all', 1), ('all', 2), ('all', 3)) v(rule, version)")
def gc_retained(spark, sf_dir):
    refs = Refs({"t": 0}, {"b": 1})
    rules = {"guards": Retention(1), "plain": Retention(1, False, False), "last_2": Retention(2, False, False), "all": Retention()}
    return spark.createDataFrame([(n, v) for n, r in rules.items() for v in sorted(retained(_history(), refs, 3, r))], "rule string, version long")


@register("SELECT * FROM (VALUES ('a'), ('b')) v(segment)")
def orphan_segments(spark, sf_dir):
    return spark.createDataFrame([(s,) for s in gc_plan(_history(), Refs({"t": 0}, {"b": 1}), 3, Retention(1, False, False))[1]], "segment string")


@register("SELECT * FROM (VALUES (120::BIGINT), (210), (300)) v(total)")
def auto_commit_points(spark, sf_dir):
    out, total, pending = [], 0, 0
    for _ in range(10):
        total, pending = total + 30, pending + 30
        if (rest := pending_after_commit(Versioning(every_n_writes=100), pending, 0)) is not None:
            pending = rest
            out.append((total,))
    return spark.createDataFrame(out, "total long")


# --- exploration and figures


@register("SELECT DISTINCT unnest(json_keys(props)) AS key FROM events")
def payload_keys(spark, sf_dir):
    return explore.payload_keys(events(spark, sf_dir))


@register("""WITH k AS (SELECT 'k' AS key, json_extract(props, '$.k') AS v FROM events UNION ALL SELECT 'type', to_json(event_type) FROM events),
s AS (SELECT key, count(DISTINCT v::VARCHAR) AS n_distinct, avg(CASE WHEN json_type(v) = 'VARCHAR' THEN 1.0 ELSE 0.0 END)::DOUBLE AS string_share FROM k GROUP BY key)
SELECT key, n_distinct, string_share, (least(n_distinct, 41) + CASE WHEN least(n_distinct, 41) BETWEEN 2 AND 14 THEN 0 ELSE 50 END + CASE WHEN string_share > 0.5 THEN 0 ELSE 6 END)::BIGINT AS score FROM s""")
def facet_profile(spark, sf_dir):
    e = events(spark, sf_dir).select("id", F.to_json(F.struct(F.get_json_object("payload", "$.k").cast("int").alias("k"), F.col("event_type").alias("type"))).alias("payload"))
    return explore.facet_profile(e)


@register("""WITH f AS (SELECT event_id AS id, json_extract(props, '$.k')::DOUBLE AS n FROM events), s AS (SELECT min(n) AS lo, max(n) AS hi FROM f)
SELECT id, 'ramp' AS kind, round((n - lo) / (hi - lo), 6) AS position FROM f, s""")
def numeric_ramp(spark, sf_dir):
    return explore.colour_codes(events(spark, sf_dir), "k").withColumn("position", F.round("position", 6))


@register("""WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
b AS (SELECT min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS dy FROM p)
SELECT id, round(0.5 + (x - (bx + ax) / 2) / greatest(bx - ax, dy - ay) * 0.88, 6) AS x, round(0.5 + (y - (dy + ay) / 2) / greatest(bx - ax, dy - ay) * 0.88, 6) AS y FROM p, b""")
def layout_bounds(spark, sf_dir):
    p = points(spark, sf_dir).select("id", F.get("vector", F.lit(0)).cast("double").alias("x"), F.get("vector", F.lit(1)).cast("double").alias("y"))
    return explore.layout(p).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register(f"""WITH {P}, h AS (SELECT id, list_dot_product(d, (SELECT d FROM p WHERE id = 0)) AS s FROM p ORDER BY s DESC, id LIMIT 10)
SELECT id, round((s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()), 6) + 0.0 AS bar FROM h""")
def score_bars(spark, sf_dir):
    p = points(spark, sf_dir)
    return explore.score_bars(search.top_k(p, vector_of(p, 0), 10, "dot")).select("id", (F.round("bar", 6) + F.lit(0.0)).alias("bar"))


@register("SELECT 1.0::DOUBLE AS recall")
def recall_at_k(spark, sf_dir):
    """The hits of three segments, merged, against those of the whole table, for every id divisible by 50."""
    p = points(spark, sf_dir)
    asked = p.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    parts = [search.batch_top_k(p.where(f"id % 3 = {k}"), asked, 10, "dot") for k in range(3)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("rank")
    best = merged.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(*V.order("dot")))).where("r <= 10")
    return compose.recall(search.batch_top_k(p, asked, 10, "dot").select("query_id", "id"), best, 10)


@register("""WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events)
SELECT round(avg(value), 4) AS mean, round(count(*) / sum(value), 6) AS qps,
  max(CASE WHEN i = floor(0.5 * (n - 1) + 0.5) THEN value END) AS p50, max(CASE WHEN i = floor(0.99 * (n - 1) + 0.5) THEN value END) AS p99 FROM r""")
def latency_percentiles(spark, sf_dir):
    out = compose.latency_profile(events(spark, sf_dir), "value", (50, 99))
    return out.select(F.round("mean", 4).alias("mean"), F.round("qps", 6).alias("qps"), "p50", "p99")


@register()
def pca_2d(spark, sf_dir):
    return explore.pca_2d(points(spark, sf_dir))


@register()
def ann_ivf(spark, sf_dir):
    """Every id divisible by 50 against all rows, by the fewest probes whose recall, measured on all of these, is 0.95."""
    p = points(spark, sf_dir)
    asked = p.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    index = ann.IvfIndex.build(p, 16, "dot", probes=4).write(f"{scratch(spark, 'ann_ivf')}/rows")
    index.measure(asked, gate=0.95)
    return index.search_many(asked, 10).withColumn("recall", F.lit(index.recall))


@register(_knn(P, DOT))
def collection_index_search(spark, sf_dir):
    """Search by the index of a collection's first half (recall 1 over all its ids divisible by 50) and exactly in the rows written later."""
    p = points(spark, sf_dir).select("id", "vector", "payload")
    half = p.agg(F.max("id")).first()[0] // 2
    c = Collection.create(spark, f"{scratch(spark, 'collection_index')}/c", "indexed", 64, "dot")
    c.insert_with_ids(p.where(F.col("id") <= half))
    c.build_index(16, gate=1.0)
    c.insert_with_ids(p.where(F.col("id") > half))
    return rounded(c.search(vector_of(p, 0), 10, gate=1.0))


@register("SELECT vec_id AS id, label FROM embeddings WHERE vec_id >= 5")
def streaming_ingest(spark, sf_dir):
    """Points as a file stream of upserts (input order by id), then a stream of deletes; each batch applied twice, counted once."""
    from tessera.streaming.ingest import apply_batch, ingest

    root = scratch(spark, "streaming_ingest")
    c = Collection.create(spark, f"{root}/c", "s", 64, "dot")
    p = points(spark, sf_dir)
    p.orderBy("id").coalesce(1).select(F.lit("upsert").alias("op"), "id", "vector", "payload").write.parquet(f"{root}/in")
    schema = "op string, id long, vector array<float>, payload string"
    ingest(spark.readStream.schema(schema).parquet(f"{root}/in"), c, f"{root}/checkpoint").awaitTermination()
    gone = spark.createDataFrame([("delete", i, None, None) for i in range(5)], schema)
    apply_batch(c, gone, 1)
    apply_batch(c, gone, 1)
    return c.read().select("id", F.get_json_object("payload", "$.label").cast("int").alias("label"))


@register("SELECT vec_id AS id, label FROM embeddings")
def jsonl_source(spark, sf_dir):
    from tessera.sources.points import read_jsonl

    root = scratch(spark, "jsonl_source")
    p = points(spark, sf_dir).orderBy("id")
    p.select(F.to_json(F.struct("vector", F.from_json("payload", "label int").alias("payload"))).alias("value")).write.text(f"{root}/in")
    c = Collection.create(spark, f"{root}/c", "j", 64, "cosine")
    c.upsert(read_jsonl(spark, f"{root}/in"))
    return c.read().select("id", F.get_json_object("payload", "$.label").cast("int").alias("label"))


FRAMES = ("{}", "In short: {}", "They said: {}", "{} That is all.")


@register("""WITH f(framing, a, z) AS (VALUES (0, '', ''), (1, 'In short: ', ''), (2, 'They said: ', ''), (3, '', ' That is all.')),
r AS (SELECT framing, a || text || z AS text, source AS category, row_number() OVER (ORDER BY framing, source, text) AS i FROM documents, f WHERE text IS NOT NULL AND source IS NOT NULL)
SELECT category, count(*) AS n, sum(length(text))::BIGINT AS chars FROM r WHERE i <= (SELECT 3 * count(*) FROM documents WHERE text IS NOT NULL AND source IS NOT NULL) GROUP BY category""")
def corpus_expansion(spark, sf_dir):
    from tessera.sources.points import expand_corpus

    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL AND source IS NOT NULL").select("text", F.col("source").alias("category"))
    more = expand_corpus(corpus, FRAMES, 3 * corpus.count())
    return more.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


# --- catalog, copies, maintenance, file sources


@register("SELECT name, dim, metric, n AS count FROM (VALUES ('a', 64, 'dot', (SELECT count(*) FROM embeddings WHERE vec_id < 100)), ('b', 3, 'cosine', 0)) v(name, dim, metric, n)")
def catalog_list(spark, sf_dir):
    """Three collections are made, one of them is dropped."""
    cat = Catalog(spark, scratch(spark, "catalog_list"))
    for name, dim, metric in (("b", 3, "cosine"), ("a", 64, "dot"), ("gone", 2, "dot")):
        cat.create(name, dim, metric)
    cat.open("a").upsert(points(spark, sf_dir).where("id < 100"))
    cat.drop("gone")
    return cat.list().select("name", "dim", "metric", "count")


@register(_VIEW + "vec_id < 300")
def export_import(spark, sf_dir):
    c = _versioned(spark, sf_dir, "export_import")
    path = scratch(spark, "exported")
    c.export(path)
    return _view(import_collection(spark, path, f"{path}-copy").read(At(tag="base")))


@register("SELECT vec_id AS id, label FROM embeddings WHERE vec_id <> 7")
def delete_point(spark, sf_dir):
    """A point is deleted; deleting it again, or one that never was, changes nothing."""
    c = Collection.create(spark, scratch(spark, "delete_point"), "d", 64, "dot")
    c.upsert(points(spark, sf_dir).orderBy("id"))
    if [c.delete(7), c.delete(7), c.delete(1 << 40)] != [True, False, False]:
        raise AssertionError("wrong answers")
    return c.read().select("id", F.get_json_object("payload", "$.label").cast("int").alias("label"))


@register("SELECT vec_id + 1000 AS id, label FROM embeddings UNION ALL SELECT max(vec_id) + 1001, -1 FROM embeddings")
def insert_with_ids(spark, sf_dir):
    """Given ids are kept, and the next free one follows the largest."""
    c = Collection.create(spark, scratch(spark, "insert_with_ids"), "i", 64, "dot")
    c.insert_with_ids(points(spark, sf_dir).select((F.col("id") + 1000).alias("id"), "vector", "payload"))
    c.upsert([([1.0] * 64, {"label": -1})])
    return c.read().select("id", F.get_json_object("payload", "$.label").cast("int").alias("label"))


@register(_VIEW + "NOT (vec_id < 300 AND vec_id % 10 = 0)")
def recover_after_crash(spark, sf_dir):
    """A commit whose process dies before the manifest's file is written, then another commit, then the older one is read."""
    c = _versioned(spark, sf_dir, "recover_after_crash")
    c.log.keep = lambda m: None
    crashed = c.commit("the file of this manifest is never written")
    again = Collection(spark, c.root)
    again.commit("after the crash")
    if [r.version for r in again.versions().collect()] != [0, 1, 2, 3] or again.count(At(version=crashed)) != again.count():
        raise AssertionError("a version is lost")
    return _view(again.read(At(branch="work")))


@register("SELECT * FROM (VALUES ('before', 2::BIGINT), ('after', 0)) v(state, tombstones)")
def purge_tombstones(spark, sf_dir):
    """Compaction with purge leaves tombstones nothing to hide; gc removes their folders."""
    c = _versioned(spark, sf_dir, "purge_tombstones")
    folders = lambda: len(c.files.names(f"{c.root}/tombstones"))
    before = folders()
    c.compact(purge=True)
    c.commit("purged")
    c.gc(Retention(1, False, False))
    return spark.createDataFrame([("before", before), ("after", folders())], "state string, tombstones long")


@register("SELECT * FROM (VALUES ('few', FALSE), ('many', TRUE), ('old', TRUE), ('one', FALSE), ('off', FALSE), ('rebuild', TRUE), ('no_rebuild', FALSE)) v(rule, due)")
def compaction_policy(spark, sf_dir):
    p, off = Compaction(3, 1000), Compaction.from_settings({"max_segments": "0", "interval_seconds": "x"})
    rows = [("few", compaction_due(p, 2, 999)), ("many", compaction_due(p, 3, 0)), ("old", compaction_due(p, 2, 1000)), ("one", compaction_due(p, 1, 9999)), ("off", compaction_due(off, 99, 9999)), ("rebuild", should_rebuild(3, 10)), ("no_rebuild", should_rebuild(2, 10))]
    return spark.createDataFrame(rows, "rule string, due boolean")


@register("""SELECT vec_id AS id, '[' || array_to_string(list_transform(embedding[1:4], lambda x: printf('%.6f', x::DOUBLE)), ', ') || ', …]' AS preview FROM embeddings""")
def vector_preview(spark, sf_dir):
    return points(spark, sf_dir).select("id", V.preview("vector", 4, 6).alias("preview"))


@register("SELECT event_id AS id, 'code' AS kind, (dense_rank() OVER (ORDER BY event_type) - 1)::DOUBLE AS position FROM events")
def colour_categories(spark, sf_dir):
    e = events(spark, sf_dir).select("id", F.to_json(F.struct(F.col("event_type").alias("type"))).alias("payload"))
    return explore.colour_codes(e, "type")


@register("SELECT event_id AS id FROM events")
def empty_filter(spark, sf_dir):
    return events(spark, sf_dir).where(Filter().column()).select("id")


@register(_knn(P, DOT, where="label = 3").replace("SELECT id, round", "SELECT id, label, round"))
def knn_with_payload(spark, sf_dir):
    p = points(spark, sf_dir)
    hits = search.top_k(p, vector_of(p, 0), 10, "cosine", Filter(must=[Condition("label", match=3)]), ("payload",))
    return rounded(hits).select("id", F.get_json_object("payload", "$.label").cast("int").alias("label"), "score")


@register("SELECT * FROM (VALUES ('version', 1::BIGINT), ('tag', 0), ('branch', 1), ('head', 1)) v(selector, version)")
def selector_precedence(spark, sf_dir):
    c = _versioned(spark, sf_dir, "selector_precedence")
    head = c.head()
    asked = {"version": At(version=1, tag="base"), "tag": At(tag="base", branch="work"), "branch": At(branch="work"), "head": At()}
    return spark.createDataFrame([(n, c.log.resolve(a, head.version, head.refs, head.manifest).version) for n, a in asked.items()], "selector string, version long")


@register(f"""WITH {P}, q AS (SELECT id AS query_id, d AS v FROM p WHERE id % 50 = 0),
r AS (SELECT query_id, id, {DOT} AS s, row_number() OVER (PARTITION BY query_id ORDER BY {DOT} DESC, id) AS rank FROM p, q WHERE label >= 5)
SELECT query_id, id, round(s, 5) + 0.0 AS score, rank::INT AS rank FROM r WHERE rank <= 5""")
def ann_exact_fallback(spark, sf_dir):
    """An index that probes every cell, over the rows that a filter leaves, answers exactly."""
    p = points(spark, sf_dir)
    index = ann.IvfIndex.build(p.where("label >= 5"), 8, "dot", probes=8)
    asked = p.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    return index.search_many(asked, 5).withColumn("score", F.round("score", 5) + F.lit(0.0))
