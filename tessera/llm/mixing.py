"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

The tree is domain > language > source. A token budget flows down it: at each node it is divided among the
children by weight, but no child gets more than its subtree can supply (its tokens times `epochs`, those under a
weight of 0 left out). What a child can't use goes to its siblings, by weight again, and only what a whole subtree
lacks reaches the level above: exact water filling, level by level, on aggregated leaf totals.

Each leaf then takes full passes over its documents and, in one more pass, the prefix whose running token count
stays within the rest of its budget. The order of pass e is that of md5(seed:e:doc_id). The running count is
two-level: sums of hash-range buckets (each with at most about 1/(4 P) of all rows, P the shuffle partitions),
then rows inside a bucket, so a hot leaf is spread over many tasks.

Edge cases: null domain, language or source is the node '?'; null or empty text has no tokens and comes along
when its place in the order is inside the budget; a weight missing, null or not above 0 gives the node nothing;
rows that repeat a doc_id are ordered by their tokens, then a digest of their text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, keep_rows, partitions, row_digest, utf8_size


def token_estimate(text: str | Column) -> Column:
    """One token for every four UTF-8 bytes, rounded up."""
    return F.ceil(utf8_size(text) / F.lit(4)).cast("long")


def domain_of(source: str | Column) -> Column:
    """Four domains dealt by source, where the table has none."""
    return F.concat(F.lit("d"), F.pmod(F.crc32(F.coalesce(source, F.lit("?"))), F.lit(4)).cast("string"))


def water_fill(nodes: DataFrame, parent: list[str], cells: int = 256) -> DataFrame:
    """Adds `alloc`: the parent's budget b shared among its children by weight w, none above its usable supply c.

    Children are full up to a level of c / w. They are counted by cells of that ratio (`cells` to an octave); only the
    children of the cell where the budget runs out are put in order, those of equal ratio as one. So no task gets
    the children of a large family: a cell is one row, and a window holds a family's cells, or one cell's ratios.
    """
    ready = nodes.withColumn("r", F.when(F.col("w") > 0, F.col("c") / F.col("w")).otherwise(F.lit(0.0)))
    ready = ready.withColumn("cell", F.when(F.col("r") > 0, F.floor(F.log2("r") * F.lit(float(cells)))).otherwise(F.lit(-(1 << 40))).cast("long"))
    ready = cut(ready, "mix-nodes")
    part = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    keys = [F.col(p).alias(f"p_{p}") for p in parent]
    same = lambda a, b: [a[p].eqNullSafe(b[f"p_{p}"]) for p in parent]

    def join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
        on = same(a, b)
        if not on:
            return a.join(F.broadcast(b), how=how) if how == "inner" else a.join(F.broadcast(b), F.lit(True), how)  # one row
        test = on[0]
        for x in on[1:]:
            test = test & x
        return a.join(b, test, how)

    low = F.when(F.col("cell") > -(1 << 40), F.pow(F.lit(2.0), F.col("cell") / F.lit(float(cells)))).otherwise(F.lit(0.0))
    sums = ready.groupBy(*parent, "cell").agg(F.sum("c").alias("c"), F.sum("w").alias("w"), F.first("b").alias("b"))
    ordered = part.orderBy("cell")
    sums = sums.withColumn("below", F.coalesce(F.sum("c").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    sums = sums.withColumn("above", F.sum("w").over(ordered.rowsBetween(0, Window.unboundedFollowing)))
    reach = F.col("below") + low * F.col("above") * F.lit(1 - 1e-12) <= F.col("b")
    cell = F.struct("cell", "below", "above")
    edge = sums.groupBy(*keys).agg(F.coalesce(F.max(F.when(reach, cell)), F.min(cell)).alias("e"))  # the first cell if the budget reaches none
    edge = cut(edge.select(*[f"p_{p}" for p in parent], F.col("e.cell").alias("edge"), F.col("e.below").alias("below"), F.col("e.above").alias("above")), "mix-edges")
    # inside that cell, one row a ratio
    inside = join(ready, edge).where("cell = edge").groupBy(*parent, "r").agg(F.sum("c").alias("c"), F.sum("w").alias("w"), F.first("b").alias("b"), F.first("below").alias("below"), F.first("above").alias("above"))
    fine = part.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("c0", F.col("below") + F.coalesce(F.sum("c").over(fine), F.lit(0.0))).withColumn("w0", F.col("above") - F.coalesce(F.sum("w").over(fine), F.lit(0.0)))
    full = F.col("c0") + F.col("r") * F.col("w0") <= F.col("b")
    last = inside.groupBy(*keys).agg(
        F.max(F.when(full, F.col("r"))).alias("most"),
        F.max(F.when(full, F.struct("r", (F.col("c0") + F.col("c")).alias("c"), (F.col("w0") - F.col("w")).alias("w")))).alias("done"),
        F.first("below").alias("below2"), F.first("above").alias("above2"), F.first("b").alias("b2"),
    )
    used, open_ = F.coalesce(F.col("done.c"), F.col("below2")), F.coalesce(F.col("done.w"), F.col("above2"))
    level = last.select(*[f"p_{p}" for p in parent], "most", F.when(open_ > 1e-12, (F.col("b2") - used) / open_).otherwise(F.lit(0.0)).alias("level"))
    both = join(join(ready, edge.select(*[f"p_{p}" for p in parent], "edge")).drop(*[f"p_{p}" for p in parent]), level)
    is_full = (F.col("cell") < F.col("edge")) | ((F.col("cell") == F.col("edge")) & (F.col("r") <= F.col("most")))
    return both.withColumn("alloc", F.when(F.col("w") <= 0, F.lit(0.0)).when(F.coalesce(is_full, F.lit(False)), F.col("c")).otherwise(F.col("w") * F.col("level"))).select(*nodes.columns, "alloc")


def leaf_budgets(leaves: DataFrame, budget: Column, epochs: int, weights: dict[str, Column]) -> DataFrame:
    """leaves: domain, lang, source, tokens, rows. Adds `alloc` (long), the tokens each leaf is to give.

    Usable supply is summed from the leaves up, after the weights: what a node of weight 0 holds counts nowhere above
    it, so no budget is sent to a subtree that can't give it.
    """
    plus = lambda c: F.when(c > 0, c.cast("double")).otherwise(F.lit(0.0))
    usable = F.when(F.col("w") > 0, F.col("c")).otherwise(F.lit(0.0))
    leaves = leaves.withColumn("w", plus(weights["source"])).withColumn("c", F.col("tokens").cast("double") * F.lit(float(epochs))).withColumn("c", usable)
    mids = leaves.groupBy("domain", "lang").agg(F.sum("c").alias("c")).withColumn("w", plus(weights["lang"])).withColumn("c", usable)
    tops = mids.groupBy("domain").agg(F.sum("c").alias("c")).withColumn("w", plus(weights["domain"])).withColumn("c", usable)
    total = leaves.agg(F.sum("tokens").alias("all_tokens"))
    tops = tops.join(F.broadcast(total)).withColumn("b", budget).drop("all_tokens")  # total is one row
    given = lambda df, *names: df.select(*[F.col(n).alias(f"g_{n}") for n in names], F.col("alloc").alias("b"))
    tops = given(water_fill(tops, []), "domain")
    mids = given(water_fill(mids.join(tops, F.col("domain") == F.col("g_domain")).drop("g_domain"), ["domain"]), "domain", "lang")
    leaves = water_fill(leaves.join(mids, (F.col("domain") == F.col("g_domain")) & (F.col("lang") == F.col("g_lang"))).drop("g_domain", "g_lang"), ["domain", "lang"])
    return leaves.select("domain", "lang", "source", "tokens", "rows", F.floor(F.col("alloc") + F.lit(1e-6)).cast("long").alias("alloc"))


def mix_rows(docs: DataFrame, share: float, epochs: int = 1, seed: int = 17, weights: dict[str, Column] | None = None, domain: Column | None = None, key: str = "doc_id") -> DataFrame:
    """One row per document: key, digest, domain, lang, source, tokens, leaf_budget and epochs, how often it is taken.

    share: the budget as a share of all tokens. weights: a Column for each of domain, lang, source over the
    columns of that level (default: equal weights).
    """
    weights = {k: F.lit(1.0) for k in ("domain", "lang", "source")} | (weights or {})
    name = lambda c: F.coalesce(F.col(c), F.lit("?"))
    base = docs.select(F.col(key).alias("id"), row_digest("text").alias("digest"), (domain_of("source") if domain is None else F.coalesce(domain, F.lit("?"))).alias("domain"), name("lang").alias("lang"), name("source").alias("source"), token_estimate("text").alias("tokens"))
    base = cut(base, "mix-rows")
    leaves = cut(base.groupBy("domain", "lang", "source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "mix-leaves")
    budget = F.floor(F.col("all_tokens").cast("double") * F.lit(share)).cast("double")
    plan = leaf_budgets(leaves, budget, epochs, weights)
    many = F.broadcast(leaves.agg(F.sum("rows").alias("all_rows")))  # one row
    most = F.greatest(F.lit(1.0), F.col("rows") * F.lit(4.0 * partitions(docs.sparkSession)) / F.col("all_rows"))
    plan = plan.join(many).withColumn("buckets", F.ceil(most).cast("long")).drop("all_rows")
    plan = plan.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("alloc") / F.col("tokens"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.col("alloc") - F.col("passes") * F.col("tokens"))
    plan = cut(plan.withColumnRenamed("tokens", "supply"), "mix-plan")
    node = ["domain", "lang", "source"]
    keyed = base.join(plan.select(*node, "alloc", "buckets", "passes", "rest", "supply"), node)
    keyed = keyed.withColumn("order", F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("passes") + 1).cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    keyed = keyed.withColumn("bucket", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("double") * F.col("buckets") / F.lit(4294967296.0)).cast("long"))
    sums = keyed.groupBy(*node, "bucket").agg(F.sum("tokens").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy(*node).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*node, "bucket", before.alias("before"))
    # only the bucket where the rest runs out needs its rows in order; whole buckets are in or out by their start
    rows = keyed.join(starts, [*node, "bucket"])
    inside = Window.partitionBy(*node, "bucket").orderBy("order", "tokens", "digest").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.col("before") + F.sum("tokens").over(inside))
    taken = F.col("passes") + F.when((F.col("upto") <= F.col("rest")) & (F.col("passes") < epochs) & ((F.col("rest") > 0) | (F.col("tokens") > 0)), 1).otherwise(0)
    return rows.select(F.col("id").alias(key), "digest", *node, "tokens", F.col("alloc").alias("leaf_budget"), taken.cast("long").alias("epochs"))


def mix(docs: DataFrame, share: float, epochs: int = 1, **settings) -> DataFrame:
    """One row per document: key, domain, lang, source, tokens, leaf_budget, epochs (settings as in mix_rows)."""
    return mix_rows(docs, share, epochs, **settings).drop("digest")


def mix_stage(docs: DataFrame, share: float) -> DataFrame:
    """The rows of one epoch that the budget takes, with all their columns."""
    return keep_rows(docs, mix_rows(docs, share).withColumn("stays", F.col("epochs") > 0))
