"""Quality rules: base text statistics and n-gram perplexity bands per language.

The language model is an interpolated modified Kneser-Ney model of character 5-grams, one per language. Spark counts
the n-grams of all texts, exactly (21 bits a character): each task sums its own texts' 5-grams, aggregates add them up
and give the continuation counts of the lower orders, the counts of counts for the three discounts of each order and
language, and the totals of each context; joins give each seen n-gram its interpolated probability and each context
its back-off weight. No n-gram is left out. The model is stored as one table sorted by 64-bit key, in pieces by
the key's top bits, which workers read as they need them: neither the driver nor a worker holds it whole.

A document's perplexity is over all its characters, lower-cased. Bands are per language: quartiles of log perplexity over
all documents with enough words, widened by `low` and `high` times the quartile range on either side.

Edge cases: null text has no words and fails the base rules; null language is a language of its own; empty texts
have no perplexity and are judged by the base rules alone; rows that repeat a doc_id are judged each, equal texts
of a language alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, slices, text_batches
from tessera.llm.keytable import BITS, KeyTable, before, code_points, key_of, last, mask, pack, write_table
from tessera.llm.wordhash import Words, grams, mix

ORDER = 5
#: A context's back-off weight is stored under the kind of its n-grams' order plus this.
WEIGHT = 8
_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
_SPACES = str.maketrans("", "", " \t\n\x0b\x0c\r")


def _packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed 5-grams that end at each character (a text is preceded by four zeros), and each one's text."""
    pad = "\0" * (ORDER - 1)
    codes = code_points("".join(pad + t for t in texts))
    sizes = np.array([len(t) for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes + ORDER - 1)
    hi, lo = pack(codes)
    starts = np.cumsum(sizes + ORDER - 1) - (sizes + ORDER - 1)
    real = np.arange(len(codes)) - starts[doc] >= ORDER - 1 if len(codes) else np.zeros(0, bool)
    return hi[real], lo[real], doc[real]


def _distinct(hi: np.ndarray, lo: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct packed n-grams, their summed times, and the place of each given one among them."""
    _, first, place = np.unique(mix(lo.astype(np.uint64)) ^ hi.astype(np.uint64), return_index=True, return_inverse=True)
    if (hi[first][place] != hi).any() or (lo[first][place] != lo).any():  # a clash of the sort key
        _, first, place = np.unique(np.stack([hi, lo], 1), axis=0, return_index=True, return_inverse=True)
    return hi[first], lo[first], np.bincount(place, times, len(first)).astype(np.int64), place


def _lower(values: list) -> list[str]:
    return [(t or "").lower() for t in values]


def base_stats(texts: list[str | None]) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each whole text."""
    out = np.zeros((len(texts), 5), np.int64)
    plain = [t or "" for t in texts]
    data = [t.encode("utf-8", "surrogatepass") for t in plain]
    for a, b in slices([len(d) for d in data], 1 << 19):
        words = Words(data[a:b])
        out[a:b, 0] = np.diff(words.first)
        value, doc = grams(words, 3)
        if len(value):
            at = np.flatnonzero(words.doc[:-2] == words.doc[2:])
            order = np.lexsort((value, doc))
            v, d = value[order], doc[order]
            same = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
            twice = np.zeros(len(v), bool)
            twice[1:] |= same
            twice[:-1] |= same
            covered = np.zeros(len(words.hash), bool)
            hit = at[order[twice]]
            for k in range(3):
                covered[hit + k] = True
            out[a:b, 4] = np.bincount(words.doc[covered], minlength=b - a)
    for i, t in enumerate(plain):
        out[i, 1] = len(t.translate(_SPACES)) if not t.isascii() else len(data[i].translate(None, b" \t\n\x0b\x0c\r"))
        out[i, 2] = len(t) - len(t.translate(_SYMBOLS)) if not t.isascii() else len(data[i]) - len(data[i].translate(None, b"#*$%&|<>"))
        lines = [x for x in data[i].split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        out[i, 3] = len(lines) - len(set(lines))
    return out


def count_grams(docs: DataFrame) -> DataFrame:
    """docs: lang, text. lang, hi, lo, n of the highest order, summed per task."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged() -> int:
            for lang, parts in held.items():
                held[lang] = [_distinct(*(np.concatenate(x) for x in zip(*parts, strict=True)))[:3]]
            return sum(len(p[0][0]) for p in held.values())

        def flush() -> Iterator[pd.DataFrame]:
            merged()
            for lang, [(hi, lo, n)] in held.items():
                yield pd.DataFrame({"lang": lang, "hi": hi, "lo": lo, "n": n})
            held.clear()

        for f in frames:
            for lang, part in f.groupby("lang"):
                texts = _lower(part["text"].tolist())
                for a, b in slices([len(t) for t in texts], 1 << 19):
                    hi, lo, _ = _packed(texts[a:b])
                    if len(hi):
                        held.setdefault(lang, []).append(_distinct(hi, lo)[:3])
                        size += len(held[lang][-1][0])
                    if size > 4_000_000:
                        size = merged()
                        if size > 3_000_000:
                            yield from flush()
                            size = 0
        yield from flush()

    return docs.mapInPandas(count, "lang string, hi long, lo long, n long")


class Model:
    """Looks up a stored model: probabilities of n-grams by order, back-off weights of contexts, a floor for each language."""

    def __init__(self, table: KeyTable | None):
        self.table = table

    def _prob(self, hi: np.ndarray, lo: np.ndarray, lang: str, order: int) -> np.ndarray:
        if order == 0:
            floor = self.table.value(key_of(np.zeros(1, np.int64), np.zeros(1, np.int64), 0, lang))[0]
            return np.full(len(hi), 1.0 if np.isnan(floor) else floor)
        out = self.table.value(key_of(*last(hi, lo, order), order, lang))
        rest = np.flatnonzero(np.isnan(out))
        if len(rest):
            weight = self.table.value(key_of(*before(*last(hi[rest], lo[rest], order)), order + WEIGHT, lang))
            out[rest] = np.where(np.isnan(weight), 1.0, weight) * self._prob(hi[rest], lo[rest], lang, order - 1)
        return out

    def log_probs(self, texts: list[str], lang: str) -> np.ndarray:
        """Summed log probabilities of the characters of each lower-cased text; every distinct n-gram is looked up once."""
        parts = []
        for a, b in slices([len(t) for t in texts], 1 << 19):
            hi, lo, doc = _packed(texts[a:b])
            h, w, _, place = _distinct(hi, lo) if len(hi) else (hi, lo, None, doc)
            parts.append((a, b, doc, place.astype(np.int32), h, w))
        if not parts:
            return np.zeros(0)
        hi, lo, _, every = _distinct(np.concatenate([p[4] for p in parts]), np.concatenate([p[5] for p in parts]))
        logs = np.log(self._prob(hi, lo, lang, ORDER)) if len(hi) else np.zeros(0)
        out, at = np.zeros(len(texts)), 0
        for a, b, doc, place, h, _ in parts:
            own = logs[every[at : at + len(h)]]
            at += len(h)
            out[a:b] = np.bincount(doc, own[place], b - a) if len(h) else 0
        return out


def _discounts(n: list[Column]) -> list[Column]:
    """The three discounts of modified Kneser-Ney from the counts of counts 1 to 4; moderate fixed ones where these don't allow it."""
    n1, n2, n3, n4 = n
    whole = (n1 > 0) & (n2 > 0) & (n3 > 0) & (n4 > 0)
    y = n1 / (n1 + 2 * n2)
    made = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return [F.when(whole, F.greatest(F.least(d, F.lit(high)), F.lit(low))).otherwise(F.lit(else_)) for d, low, high, else_ in zip(made, (0.05, 0.1, 0.15), (0.95, 1.9, 2.85), (0.5, 0.75, 0.9), strict=True)]


def train(counts: DataFrame) -> Model:
    """counts: lang, hi, lo, n of the highest order over all texts."""
    short = lambda chars: ((F.col("hi").bitwiseAND(F.lit(mask(chars - 3))) if chars > 3 else F.lit(0).cast("long")).alias("hi"), F.col("lo").bitwiseAND(F.lit(mask(min(chars, 3)))).alias("lo"))
    tables: dict[int, DataFrame] = {ORDER: cut(counts.groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n")), "grams-5")}
    for order in range(ORDER - 1, 0, -1):
        tables[order] = cut(tables[order + 1].groupBy("lang", *short(order)).agg(F.count(F.lit(1)).alias("n")), f"grams-{order}")
    floors = tables[1].groupBy("lang").agg((F.lit(1.0) / (F.count(F.lit(1)) + 1)).alias("p"))
    made = [floors.select("lang", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"), F.col("p").alias("value"))]
    lower = None
    for order in range(1, ORDER + 1):
        t = tables[order]
        per = t.groupBy("lang").agg(*[F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4)])
        per = cut(per.select(F.col("lang").alias("lang2"), *[d.alias(f"d{k + 1}") for k, d in enumerate(_discounts([F.col(f"n{k}") for k in (1, 2, 3, 4)]))]), "discounts")  # one row a language
        cost = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        c_hi, c_lo = F.shiftright("hi", BITS), F.shiftright("lo", BITS).bitwiseOR(F.shiftleft(F.col("hi").bitwiseAND(F.lit(mask(1))), 2 * BITS))
        t = t.join(per, F.col("lang") == F.col("lang2")).select("lang", "hi", "lo", "n", cost.alias("cost"), c_hi.alias("c_hi"), c_lo.alias("c_lo"))
        contexts = cut(t.groupBy(F.col("lang").alias("lang3"), F.col("c_hi").alias("x_hi"), F.col("c_lo").alias("x_lo")).agg(F.sum("n").alias("whole"), (F.sum("cost") / F.sum("n")).alias("weight")), f"contexts-{order}")
        t = t.join(contexts, (F.col("lang") == F.col("lang3")) & (F.col("c_hi") == F.col("x_hi")) & (F.col("c_lo") == F.col("x_lo")))
        t = t.select("lang", "hi", "lo", ((F.col("n") - F.col("cost")) / F.col("whole")).alias("own"), "weight", *[c.alias(f"s_{n}") for c, n in zip(short(order - 1) if order > 1 else (), ("hi", "lo"), strict=False)])
        if order == 1:
            t = t.join(floors.withColumnRenamed("lang", "lang4"), F.col("lang") == F.col("lang4"))
        else:
            below = lower.select(F.col("lang").alias("lang4"), F.col("hi").alias("b_hi"), F.col("lo").alias("b_lo"), "p")
            t = t.join(below, (F.col("lang") == F.col("lang4")) & (F.col("s_hi") == F.col("b_hi")) & (F.col("s_lo") == F.col("b_lo")))
        lower = cut(t.select("lang", "hi", "lo", (F.col("own") + F.col("weight") * F.col("p")).alias("p")), f"probs-{order}")
        made.append(lower.select("lang", F.lit(order).alias("kind"), "hi", "lo", F.col("p").alias("value")))
        made.append(contexts.select(F.col("lang3").alias("lang"), F.lit(order + WEIGHT).alias("kind"), F.col("x_hi").alias("hi"), F.col("x_lo").alias("lo"), F.col("weight").alias("value")))

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            key = np.zeros(len(f), np.int64)
            for (lang, kind), at in f.groupby(["lang", "kind"]).indices.items():
                key[at] = key_of(f["hi"].to_numpy()[at], f["lo"].to_numpy()[at], int(kind), lang).view(np.int64)
            yield pd.DataFrame({"key": key, "value": f["value"].astype("float32")})

    rows = made[0]
    for m in made[1:]:
        rows = rows.unionByName(m)
    size = sum(t.count() for t in tables.values())
    return Model(KeyTable(*write_table(rows.mapInPandas(keyed, "key long, value float"), "perplexity-model", 2 * size), ("value",)))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", low: float = 3.0, high: float = 6.0, least_words: int = 50) -> DataFrame:
    """One row per document: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_perplexity."""
    text_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    base = docs.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("?")).alias("lang"))
    model = train(count_grams(base.where("text IS NOT NULL").select("lang", "text")))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            stats = base_stats(f["text"].tolist())
            logs = np.full(len(f), np.nan)
            langs = f["lang"].to_numpy()
            for name in sorted(set(langs.tolist())):
                rows = np.flatnonzero(langs == name)
                texts = _lower([f["text"].iloc[k] for k in rows])
                size = np.array([len(t) for t in texts])
                for a, b in slices(size.tolist(), 1 << 23):
                    total, full = model.log_probs(texts[a:b], name), size[a:b] > 0
                    logs[rows[a:b][full]] = -total[full] / size[a:b][full]
            yield pd.DataFrame({"id": f["id"], "lang": langs, **{n: stats[:, k] for k, n in enumerate(names)}, "logp": logs})

    schema = f"id string, lang string, {', '.join(f'{n} long' for n in names)}, logp double"
    rows = cut(base.mapInPandas(measure, schema).withColumn("logp", F.nanvl("logp", F.lit(None).cast("double"))), "rules")
    bands = rows.where((F.col("n_words") >= least_words) & F.col("logp").isNotNull()).groupBy(F.col("lang").alias("lang2"))
    bands = bands.agg(F.percentile_approx("logp", [0.25, 0.5, 0.75], 10_000).alias("q"))
    spread = F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(0.02))
    bands = bands.select("lang2", (F.col("q")[0] - F.lit(low) * spread).alias("lower"), (F.col("q")[2] + F.lit(high) * spread).alias("upper"))
    bands = cut(bands, "rule-bands")  # one row a language: a table of its own, so that the join doesn't deal all rows by language
    judged = rows.join(bands, F.col("lang") == F.col("lang2"), "left")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.coalesce(F.col("logp").between(F.col("lower"), F.col("upper")), F.lit(True))
    return judged.select(F.col("id").cast(kind).alias(key), *names, failed.alias("base_failed"), (~failed & inside).alias("kept"), F.col("logp").alias("log_perplexity"))
