"""Language identification: word-first backoff.

Known words are scored by their log frequency in each language. For an unseen word, each place takes the longest known
character n-gram that ends there, from five characters down to one, by log frequency again, divided by its
length, since each of its characters is counted in as many n-grams.

Counting is distributed: each task sums words and n-grams of its own texts (64-bit keys), Spark adds them up. The model keeps
every word and n-gram of the training texts; it is a table sorted by key, which workers read piece by piece.
Gathered on the driver are totals alone, a few numbers for each language.

Edge cases: null text or text without a letter is 'und' with score 0; without training rows every text is 'und';
ties go to the first language by name; rows that repeat a doc_id are scored each; a null doc_id is never held out
(its remainder isn't 2) and isn't learned from; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, slices, text_batches
from tessera.llm.keytable import LONGEST, KeyTable, code_points, key_of, last, pack, write_table
from tessera.llm.wordhash import span_hash

_letter, _seen = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
START = 1  # stands before each word in its n-grams


def letters(codes: np.ndarray) -> np.ndarray:
    """Whether each character is a letter or a mark that belongs to one."""
    new = codes[~_seen[codes]]
    if len(new):
        for c in np.unique(new).tolist():
            _letter[c] = chr(c).isalpha() or unicodedata.category(chr(c))[0] == "M"
            _seen[c] = True
    return _letter[codes]


class LetterWords:
    """Runs of letters of lower-cased texts: codes, start and end of each run, hash, doc (the text's index)."""

    def __init__(self, texts: list[str]):
        self.codes = codes = code_points("\n".join(texts) + "\n")
        edge = np.flatnonzero(np.diff(letters(codes).view(np.int8), prepend=0))
        self.start, self.end = edge[::2], edge[1::2]
        self.hash = span_hash(codes.view(np.uint8), 4 * self.start, 4 * self.end)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.doc = np.searchsorted(ends, self.start, side="right")

    def grams(self, which: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For n = 1 to 5: keys of the n-grams that end at each character of the given words, and whether they lie in the word (a mark before it counts); the word of each place."""
        start, size = self.start[which], self.end[which] - self.start[which]
        place = np.repeat(np.arange(len(which)), size + 1)
        at = np.arange(int((size + 1).sum())) - np.repeat(np.cumsum(size + 1) - (size + 1), size + 1)
        codes = np.where(at == 0, START, self.codes[np.clip(np.repeat(start, size + 1) + at - 1, 0, None)])
        hi, lo = pack(codes)
        keep = at > 0
        hi, lo, at = hi[keep], lo[keep], at[keep]
        return [key_of(*last(hi, lo, n), n) for n in range(1, LONGEST + 1)], [at >= n - 1 for n in range(1, LONGEST + 1)], place[keep]


def _texts(values: list) -> list[str]:
    return [(t or "").lower() for t in values]


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, place = np.unique(keys, return_inverse=True)
    return kinds, np.bincount(place, counts, len(kinds)).astype(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """docs: text, lang. kind (0 word, n for n-grams), key, lang, n: sums over texts of a task."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, str], tuple[list, list]] = {}
        size = 0

        def merged() -> int:
            for x, (keys, counts) in held.items():
                k, c = _sums(np.concatenate(keys), np.concatenate(counts))
                held[x] = ([k], [c])
            return sum(len(k[0]) for k, _ in held.values())

        def flush() -> Iterator[pd.DataFrame]:
            merged()
            for (kind, lang), (keys, counts) in held.items():
                yield pd.DataFrame({"kind": kind, "key": keys[0].view(np.int64), "lang": lang, "n": counts[0]})
            held.clear()

        for f in frames:
            for lang, part in f.groupby("lang"):
                texts = _texts(part["text"].tolist())
                for a, b in slices([len(t) for t in texts], 1 << 19):
                    words = LetterWords(texts[a:b])
                    if not len(words.hash):
                        continue
                    kinds, first, place = np.unique(words.hash, return_index=True, return_inverse=True)
                    times = np.bincount(place)
                    grams, inside, word = words.grams(first)
                    found = [(0, kinds, times), *((n + 1, *_sums(grams[n][inside[n]], times[word[inside[n]]])) for n in range(LONGEST))]
                    for kind, k, n in found:
                        keys, counts = held.setdefault((kind, lang), ([], []))
                        keys.append(k)
                        counts.append(n)
                        size += len(k)
                    if size > 3_000_000:
                        size = merged()
                        if size > 2_000_000:
                            yield from flush()
                            size = 0
        yield from flush()

    return docs.mapInPandas(count, "kind int, key long, lang string, n long")


class Model:
    """Languages, log frequencies of what a language lacks (by kind), and the table of the others."""

    def __init__(self, languages: list[str], table: KeyTable | None, lacking: np.ndarray):
        self.languages, self.table, self.lacking = languages, table, lacking

    def logs(self, keys: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Log frequencies of sorted distinct keys, a column for each language, and which of them are known at all."""
        out = np.tile(self.lacking[kind], (len(keys), 1))
        known = np.zeros(len(keys), bool)
        for part, (_, lang, value), a, b in self.table.runs(keys):
            known[part] = b > a
            own = out[part]
            for j in range(int((b - a).max(initial=0))):
                hit = np.flatnonzero(a + j < b)
                own[hit, lang[a[hit] + j]] = value[a[hit] + j]
        return out, known

    def score(self, texts: list[str]) -> np.ndarray:
        """Summed log scores, one row per lower-cased text."""
        words = LetterWords(texts)
        out = np.zeros((len(texts), len(self.languages)))
        if not len(words.hash):
            return out
        kinds, first, place = np.unique(words.hash, return_index=True, return_inverse=True)
        value, known = self.logs(kinds, 0)
        unseen = np.flatnonzero(~known)
        if len(unseen):
            grams, inside, word = words.grams(first[unseen])
            logs = np.zeros((len(word), len(self.languages)))
            open_ = np.arange(len(word))
            for n in range(LONGEST, 0, -1):
                rows = open_[inside[n - 1][open_]]
                wanted, back = np.unique(grams[n - 1][rows], return_inverse=True)
                found, hit = self.logs(wanted, n)
                hit = hit[back]
                logs[rows[hit]] = found[back[hit]] / n
                open_ = np.setdiff1d(open_, rows[hit], assume_unique=True)
            logs[open_] = self.lacking[1]  # a character that no language has
            sums = np.zeros((len(unseen), len(self.languages)))
            np.add.at(sums, word, logs)
            value[unseen] = sums
        np.add.at(out, words.doc, value[place])
        return out


def train(docs: DataFrame) -> Model:
    """docs: text, lang (none null). The table has a row for each key and language that has it: its smoothed log frequency."""
    counts = cut(count_words(docs).groupBy("kind", "key", "lang").agg(F.sum("n").alias("n")), "language-counts")
    totals = counts.groupBy("kind", "lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).toPandas()  # six rows a language
    languages = sorted(totals["lang"].unique())
    if not languages:
        return Model([], None, np.zeros((LONGEST + 1, 0)))
    kinds = dict(counts.groupBy("kind").agg(F.count_distinct("key").alias("k")).collect())  # six rows
    mass = np.zeros((LONGEST + 1, len(languages)))
    for r in totals.itertuples():
        mass[r.kind, languages.index(r.lang)] = r.n
    spread = mass + 0.2 * np.array([[kinds.get(k, 1)] for k in range(LONGEST + 1)])
    spark = docs.sparkSession
    small = [(k, name, j, float(spread[k, j])) for k in range(LONGEST + 1) for j, name in enumerate(languages)]
    per = F.broadcast(spark.createDataFrame(small, "kind int, lang string, number int, mass double"))  # six rows a language
    rows = counts.join(per, ["kind", "lang"]).select("key", F.col("number").cast("short").alias("number"), F.log((F.col("n") + 0.2) / F.col("mass")).cast("float").alias("log"))
    uri, bits = write_table(rows, "language-model", int(totals["rows"].sum()))
    return Model(languages, KeyTable(uri, bits, ("number", "log")), np.log(0.2 / spread))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """One row per document: key, held_out, lang_pred, score."""
    text_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    base = docs.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"), (F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2).alias("held_out"))
    model = train(base.where("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL").select("text", "lang"))

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = _texts(f["text"].tolist())
            pred, prob = np.full(len(f), "und", object), np.zeros(len(f))
            if model.languages:
                for a, b in slices([len(t) for t in texts], 1 << 20):
                    s = model.score(texts[a:b])
                    s -= s.max(1, keepdims=True)
                    p = np.exp(s)
                    p /= p.sum(1, keepdims=True)
                    pred[a:b], prob[a:b] = np.array(model.languages, object)[p.argmax(1)], p.max(1)
                for k, t in enumerate(f["text"]):
                    if not t or not any(map(str.isalpha, t)):
                        pred[k], prob[k] = "und", 0.0
            yield pd.DataFrame({"id": f["id"], "held_out": f["held_out"], "lang_pred": pred, "score": prob})

    out = base.select("id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out")).mapInPandas(predict, "id string, held_out boolean, lang_pred string, score double")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", key)


def held_out(doc_id: int) -> bool:
    """The rule of the query, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
