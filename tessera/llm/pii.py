"""Personal data: exact base patterns, and a skip-chain conditional random field over each document.

Base spans come from the four patterns, in linear time, and always stay. The field's variables are, in every document,
the base spans and the other spans that look alike: long digit groups, dotted numbers, spelled-out addresses, values that
are assigned to a token, key, secret or password, and long mixed runs of letters and digits. Labels are none, the four
base kinds and secret. Potentials, in log units:

- node: log share of each label among spans of that shape in the whole corpus, clipped to -`clip`. Base patterns never
  label secrets, so those two shapes have fixed ones: an assigned value is one, as surely as a base span is of its
  kind; a bare run is none (3 over secret);
- chain: log share of label pairs of neighbouring spans against chance, clipped likewise;
- skip: for equal labels, on edges between a span and the next one, however distant, that repeats it or is similar
  (same last digits, same name before the at sign, same run), and between each such repetition and a base span of
  every kind that has its likeness, wherever in the document that stands. It is learned: the log odds that two base
  spans of one document with the same likeness have the same label, from all documents, with a prior of
  `prior` agreeing pairs to one (so 4 at the start, more as the corpus bears it out, less where likeness misleads).

Loopy sum-product passes with damping, until the messages settle, give marginals; a span whose marginal of one kind
is above one half is added. Base spans and assigned values are clamped, so they may have any number of edges: a span has at most one to
its predecessor and one a kind to a base span, so edges grow in proportion to spans. The clamp outweighs the messages of any number of them.

The text is read once; fitting sums small tables of shapes of all documents (at most a few hundred rows by
construction) and inference runs over the slim span rows.

Edge cases: null and empty texts have no spans; a very long run of matching characters is scanned once; rows that
repeat a doc_id are searched each; a null doc_id comes out null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, text_batches

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
LABELS = ("none", *ALL_KINDS)
#: Log potentials of the shape of bare runs, by label (assigned values are clamped).
SECRET_SHAPES = {"secret/bare": {"none": 0.0, "secret": -3.0}}
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_QUAD = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"\(?[0-9](?:[ ().-]?[0-9]){6,18}(?![0-9])")
_SPELLED = re.compile(r" ?[(\[ ](?:at|AT)[)\] ] ?[A-Za-z0-9-]+(?: ?(?:\.|[(\[ ](?:dot|DOT)[)\] ]) ?[A-Za-z0-9-]+)+")
_ASSIGNED = re.compile(r"(?i)(?<![a-z0-9])(?:token|secret|password|passwd|key)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?([A-Za-z0-9+/_-]{12,})")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
_LOCAL_BYTES = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each contains one at sign; its local part reaches back to the last match or a foreign character."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_BYTES:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", max(at + 1, free))


def _spelled(text: str) -> Iterator[tuple[int, int]]:
    """Spelled-out addresses, searched from their at, so that a long run of name characters is scanned once."""
    free = place = 0
    while m := _SPELLED.search(text, place):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL_BYTES:
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = place = m.end()
        else:
            place = m.start() + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base matches, by kind as listed, then start; ends are exclusive code points."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _QUAD.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return out


def _describe(kind: str, text: str) -> tuple[str, str]:
    """Shape (one of a few hundred) and likeness key of a span."""
    digits = re.sub("[^0-9]", "", text)
    if kind == "secret/assigned" or kind == "secret/bare":
        return kind, f"s:{text}"
    if "@" in text or (not digits[6:] and re.search("(?i)[(\\[ ]at[)\\] ]", text)):
        name = re.split("(?i)@| ?[(\\[ ]at[)\\] ]", text)[0].lower()
        return ("email/sign" if "@" in text else "email/spelled"), f"e:{name}"
    if kind == "ip" or re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", text):
        return f"ip/{'plain' if kind == 'ip' else 'odd'}", f"i:{text}"
    form = "plus" if text[0] == "+" else "bare" if text.isdigit() else "split"
    return f"{form}/{min(len(digits), 20)}/{int(kind == 'card')}", f"d:{digits[-8:]}"


def candidates(text: str) -> list[tuple[str, int, int, str, str]]:
    """(label, start, end, shape, key) of all variables by start; label 'none' for spans that aren't base ones."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken])
    ends = np.maximum.accumulate(np.array([b for _, b in taken])) if taken else np.zeros(0, int)
    out = [(k, a, b) for k, a, b in base]
    more = [(*m.span(1), "secret/assigned") for m in _ASSIGNED.finditer(text)]
    more += [(*m.span(), "secret/bare") for m in _RUN.finditer(text) if _mixed(m.group())]
    more += [(m.start(), m.end(), "") for m in _DIGITS.finditer(text)]
    more += [(a, b, "") for a, b in _spelled(text)]
    last = -1
    for a, b, form in sorted(more, key=lambda x: (x[0], x[2] != "secret/assigned", -x[1])):
        near = int(np.searchsorted(starts, b)) - 1
        if a >= last and not (near >= 0 and ends[near] > a):
            out.append((form or "none", a, b))
            last = b
    made = [(k if k in KINDS else "none", a, b, *_describe(k, text[a:b])) for k, a, b in out]
    return sorted(made, key=lambda x: (x[1], x[2], x[0]))


def _mixed(run: str) -> bool:
    """Four digits and four letters at least."""
    digits = sum(c in "0123456789" for c in run)
    return digits >= 4 and sum(c.isalpha() for c in run) >= 4


def agreement(found: list[tuple[str, int, int, str, str]]) -> tuple[int, int]:
    """Pairs of base spans with the same likeness: with the same label, with different ones."""
    by: dict[str, dict[str, int]] = {}
    for label, _, _, _, key in found:
        if label != "none":
            own = by.setdefault(key, {})
            own[label] = own.get(label, 0) + 1
    same = sum(c * (c - 1) // 2 for own in by.values() for c in own.values())
    every = sum(n * (n - 1) // 2 for n in (sum(own.values()) for own in by.values()))
    return same, every - same


def propagate(node: np.ndarray, pairs: np.ndarray, tables: np.ndarray, rounds: int | None = None, damping: float = 0.3, settled: float = 1e-8) -> np.ndarray:
    """Marginals by loopy sum-product: node (n, L) log potentials; pairs (m, 2); tables (m, L, L) log potentials.

    Passes end when no message moves by more than `settled`; unless stated, they are enough to cross all nodes.
    """
    n, size = node.shape
    m = len(pairs)
    to, fro = np.concatenate([pairs[:, 1], pairs[:, 0]]), np.concatenate([pairs[:, 0], pairs[:, 1]])
    both = np.concatenate([tables, tables.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    messages = np.zeros((2 * m, size))
    for _ in range((2 * n + 100 if rounds is None else rounds) if m else 0):
        belief = node.copy()
        np.add.at(belief, to, messages)
        out = belief[fro] - messages[back]
        new = np.logaddexp.reduce(out[:, :, None] + both, axis=1)
        new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
        new = damping * messages + (1 - damping) * new
        moved = np.abs(new - messages).max()
        messages = new
        if moved <= settled:
            break
    belief = node.copy()
    np.add.at(belief, to, messages)
    return np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True))


def field_of(spans: list, node_of: dict[str, np.ndarray], chain: np.ndarray, skip: float, clamp: float = 1e9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node potentials, edges and edge potentials of a document's field."""
    labels = ["secret" if s["shape"] == "secret/assigned" else s["label"] for s in spans]
    flat = node_of.get("", np.zeros(len(LABELS)))
    node = np.array([node_of.get(s["shape"], flat) for s in spans], float)
    for k, x in enumerate(labels):
        if x != "none":
            node[k] = -clamp
            node[k, LABELS.index(x)] = 0
    pairs, tables, seen = [], [], {}
    sure: dict[str, dict[str, int]] = {}  # by likeness, the first base span of each kind
    for k, (s, x) in enumerate(zip(spans, labels, strict=True)):
        if x != "none":
            sure.setdefault(s["key"], {}).setdefault(x, k)
    alike = np.eye(len(LABELS)) * skip
    for k, s in enumerate(spans):
        if k and s["start"] - spans[k - 1]["end"] <= 80:
            pairs.append((k - 1, k))
            tables.append(chain)
        near = seen.get(s["key"])
        linked = set() if near is None else {near}
        if labels[k] == "none":
            linked.update(sure.get(s["key"], {}).values())
            if near is not None and labels[near] != "none":  # the base span of its kind that is already linked
                linked.discard(sure[s["key"]][labels[near]])
                linked.add(near)
        pairs += [(j, k) for j in sorted(linked)]
        tables += [alike] * len(linked)
        seen[s["key"]] = k
    size = len(LABELS)
    return node, np.array(pairs, np.int64).reshape(-1, 2), np.array(tables, float).reshape(-1, size, size)


def _infer(spans: list, node_of: dict[str, np.ndarray], chain: np.ndarray, skip: float) -> list[tuple[str, int, int]]:
    if all(s["label"] != "none" for s in spans):
        return []
    p = propagate(*field_of(spans, node_of, chain, skip))
    best = p.argmax(1)
    return [(LABELS[b], s["start"], s["end"]) for s, b, q in zip(spans, best, p, strict=True) if s["label"] == "none" and b and q[b] > 0.5]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (ALL_KINDS.index(x[0]), x[1], x[2])))


def find_pii(docs: DataFrame, text: str = "text", key: str = "doc_id", prior: float = 54.6, clip: float = 3.0) -> DataFrame:
    """One row per document: key, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added, n_secret, n_spans."""
    text_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    base = docs.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"))  # as text, nulls don't make numbers floats
    item = "array<struct<label:string,start:int,end:int,shape:string,key:string>>"

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [candidates(t) if t else [] for t in f["text"]]
            pairs = [agreement(c) for c in found]
            rows = [[dict(zip(("label", "start", "end", "shape", "key"), c, strict=True)) for c in own] for own in found]
            yield pd.DataFrame({"id": f["id"], "vars": rows, "agree": [a for a, _ in pairs], "differ": [b for _, b in pairs]})

    rows = cut(base.mapInPandas(read, f"id string, vars {item}, agree long, differ long"), "pii-spans")
    alike = rows.agg(F.sum("agree"), F.sum("differ")).first()
    skip = float(np.clip(np.log(((alike[0] or 0) + prior) / ((alike[1] or 0) + 1)), 0, 6))
    spans = rows.where("size(vars) > 0").select(F.explode("vars").alias("v"))
    shapes = spans.groupBy("v.shape", "v.label").agg(F.count(F.lit(1)).alias("n")).toPandas()  # shapes are a few hundred
    ahead = F.expr("transform(sequence(1, size(vars) - 1), k -> named_struct('a', vars[k - 1].label, 'b', vars[k].label, 'gap', vars[k].start - vars[k - 1].end))")
    follow = rows.where("size(vars) > 1").select(F.explode(ahead).alias("p")).where("p.gap <= 80").groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).toPandas()
    node_of: dict[str, np.ndarray] = {}
    for shape, g in shapes.groupby("shape"):
        counts = np.array([g.loc[g["label"] == x, "n"].sum() for x in LABELS], float) + 0.5
        node_of[shape] = np.clip(np.log(counts / counts.max()), -clip, 0)
        node_of[shape][LABELS.index("secret")] = -2 * clip
    for shape, own in SECRET_SHAPES.items():
        node_of[shape] = np.array([own.get(x, -2 * clip) for x in LABELS])
    table = np.full((len(LABELS), len(LABELS)), 0.5)
    for a, b, n in follow.itertuples(index=False):
        table[LABELS.index(a), LABELS.index(b)] += n
    share = table / table.sum()
    chain = np.clip(np.log(share / (share.sum(1, keepdims=True) * share.sum(0, keepdims=True))), -clip, clip) / 4

    def infer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, found in zip(f["id"], f["vars"], strict=True):
                found = list(found)
                own = [(s["label"], s["start"], s["end"]) for s in found if s["label"] != "none"]
                added = _infer(found, node_of, chain, skip)
                held = [x[0] for x in own]
                out.append((i, *(held.count(k) for k in KINDS), hashlib.sha256(_joined(own).encode()).hexdigest(), _joined(own + added), len(added), sum(k == "secret" for k, _, _ in added), len(own) + len(added)))
            yield pd.DataFrame(out, columns=["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_secret", "n_spans"])

    schema = "id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secret long, n_spans long"
    return rows.mapInPandas(infer, schema).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", key)
