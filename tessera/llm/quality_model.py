"""Quality classifier with hierarchical empirical Bayes.

A logistic model over surface features gives each document its own evidence. Hosts and paths (here: source, and
source with language) have posteriors of the share of good documents: sums of the evidence, shrunk toward the
host, and hosts toward the global prior, with the prior strengths estimated from the spread between sites
(method of moments). A sparse site therefore stays near its parent. Each document's log odds are shifted by its
path's posterior against the global prior, leaving its own evidence out of that posterior.

Texts are read once, in Arrow batches; sites are grouped aggregates with map-side sums, and go back by a join.
The logistic model is fitted on at most `sample` labelled documents (a documented bound, chosen by hash).

Edge cases: null, empty or blank text is rejected with probability 0; without labels of both kinds the evidence
is the same for all and every text that isn't blank is kept; repeated labels of a document count by their mean;
null host or language is a site of its own; rows that repeat a doc_id are scored each; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, keep_rows, row_digest, text_batches

#: Bytes counted by the features.
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_SYMBOL, _STOP, _BANG = b"#*$%&<>@^_~=+/\\{}[]", b".,;:'\"()-?", b"!"
NAMES = ("log_words", "upper", "digit", "symbol", "bar", "bang", "stop", "word_len", "distinct", "dup_lines", "line_len", "bar_words", "symbol_words", "upper_words", "common")


def features(text: str | None) -> list[float] | None:
    """Surface features of a whole text; None if it has no word."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    if not words:
        return None
    n, m = len(b), len(words)
    share = lambda chars: (n - len(b.translate(None, chars))) / n
    lines = [x for x in b.split(b"\n") if x and not x.isspace()]
    kinds = set(words)
    odd = sum(1 for w in words if w[-1:] in b"#$%&*")
    caps = sum(1 for w in words if w.isupper() and len(w) > 1)
    # the three shortest words, ties by their bytes; only words of at most the third length are put in order
    most = sorted(map(len, kinds))[:3][-1]
    short = sorted((w for w in kinds if len(w) <= most), key=lambda w: (len(w), w))[:3]
    top = max(map(words.count, short)) / m if m > 1 else 0.0
    up, lo = share(_UPPER), share(_LOWER)
    return [np.log1p(m), up / (up + lo + 1e-9), share(_DIGIT), share(_SYMBOL) ** 0.5, share(b"|") ** 0.5, share(_BANG) ** 0.5, share(_STOP), n / m / 10, len(kinds) / m ** 0.8, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), words.count(b"|") / m, odd / m, caps / m, top]


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps on standardised features and their squares."""
    z = np.hstack([x, x**2])
    mean, scale = z.mean(0), z.std(0) + 1e-6
    z = np.hstack([np.ones((len(z), 1)), (z - mean) / scale])
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w, mean, scale


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (F.lit(1.0) - q))


def _strength(sites: DataFrame, total: str) -> DataFrame:
    """One row: global mean and the prior strength that fits the spread between sites of two documents or more."""
    sums = sites.agg(F.sum("n").alias("N"), F.sum("s").alias("S"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("Q"), F.sum("ss").alias("SS"), F.count(F.lit(1)).alias("K"), F.sum(F.col("n") * F.col("n")).alias("N2"))
    mu = F.col("S") / F.col("N")
    within = (F.col("SS") - F.col("Q")) / F.greatest(F.col("N") - F.col("K"), F.lit(1))
    between = F.col("Q") - F.col("S") * F.col("S") / F.col("N") - (F.col("K") - 1) * within
    spread = F.greatest(between, F.lit(0.0)) / F.greatest(F.col("N") - F.col("N2") / F.col("N"), F.lit(1.0))
    kappa = F.least(F.greatest(within / F.greatest(spread, F.lit(1e-9)), F.lit(5.0)), F.lit(1e7))
    return sums.select(mu.alias("mu"), kappa.alias(total))


def score_rows(docs: DataFrame, labels: DataFrame, target: str = "quality", host: Column | None = None, path: Column | None = None, key: str = "doc_id", sample: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """One row per document: key, digest, evidence (own probability), host_posterior, path_posterior, probability, kept."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    blank = "?"
    text_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    base = docs.select(F.col(key).cast("string").alias("id"), row_digest("text").alias("digest"), F.coalesce(host.cast("string"), F.lit(blank)).alias("host"), F.coalesce(path.cast("string"), F.lit(blank)).alias("path"), F.col("text").alias("text"))

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "digest": f["digest"], "host": f["host"], "path": f["path"], "x": [features(t) for t in f["text"]]})

    made = base.mapInPandas(batches, "id string, digest binary, host string, path string, x array<double>")
    rows = cut(made.withColumn("id", F.col("id").cast(kind)), "quality-features")
    known = labels.where(F.col(target).isNotNull()).groupBy(F.col(key).alias("known")).agg(F.avg(F.col(target).cast("double")).alias("y"))
    # thin the labelled rows by hash to about the sample first, so that tasks don't each send `sample` rows
    share = min(1.0, 1.5 * sample / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("known", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)))
    picked = rows.where("x IS NOT NULL").join(known, F.col("id") == F.col("known")).select("x", "y", F.xxhash64("id", F.lit(5)).alias("o")).orderBy("o").limit(sample).toPandas()
    if picked.empty or (picked["y"] > 0.5).nunique() < 2:
        evidence = F.lit(0.5)
    else:
        w, mean, scale = _fit(np.array(picked["x"].tolist()), (picked["y"].to_numpy() > 0.5).astype(float))
        k = len(NAMES)
        terms = F.lit(float(w[0]))
        for i in range(k):
            x = F.col("x")[i]
            terms = terms + (x - float(mean[i])) * float(w[1 + i] / scale[i]) + (x * x - float(mean[k + i])) * float(w[1 + k + i] / scale[k + i])
        evidence = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(terms, F.lit(-30.0)), F.lit(30.0))))
    rows = rows.withColumn("p", F.when(F.col("x").isNull(), F.lit(0.0)).otherwise(evidence)).drop("x")
    voting = F.col("p") > 0
    paths = rows.where(voting).groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss"))
    paths = cut(paths, "quality-sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    priors = F.broadcast(_strength(hosts, "k_host").crossJoin(_strength(paths, "k_path").drop("mu")))  # one row
    hosts = hosts.select(F.col("host").alias("host2"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    sites = paths.join(hosts, F.col("host") == F.col("host2")).select(F.col("host").alias("host2"), F.col("path").alias("path2"), "n", "s", "host_n", "host_s")
    out = rows.join(sites, (F.col("host") == F.col("host2")) & (F.col("path") == F.col("path2")), "left").join(priors, F.lit(True), "left")
    one, own = F.when(voting, F.lit(1.0)).otherwise(F.lit(0.0)), F.col("p")
    mu = F.coalesce("mu", F.lit(0.5))
    host_post = (F.coalesce(F.col("host_s"), F.lit(0.0)) - own + F.col("k_host") * mu) / (F.coalesce(F.col("host_n"), F.lit(0.0)) - one + F.col("k_host"))
    out = out.withColumn("host_posterior", F.coalesce(host_post, mu))
    path_post = (F.coalesce(F.col("s"), F.lit(0.0)) - own + F.col("k_path") * F.col("host_posterior")) / (F.coalesce(F.col("n"), F.lit(0.0)) - one + F.col("k_path"))
    out = out.withColumn("path_posterior", F.coalesce(path_post, mu))
    shifted = _logit(F.col("p")) + _logit(F.col("path_posterior")) - _logit(mu)
    final = F.when(voting, F.lit(1.0) / (F.lit(1.0) + F.exp(-shifted))).otherwise(F.lit(0.0))
    return out.select(F.col("id").alias(key), "digest", F.col("p").alias("evidence"), "host_posterior", "path_posterior", final.alias("probability"), (final >= threshold).alias("kept"))


def score(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """One row per document: key, evidence, host_posterior, path_posterior, probability, kept (settings as in score_rows)."""
    return score_rows(docs, labels, **settings).drop("digest")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier keeps, with all their columns."""
    return keep_rows(docs, score_rows(docs, labels).withColumnRenamed("kept", "stays"))
