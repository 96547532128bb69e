"""Payload filters: must / should / must_not of match and range conditions over JSON payloads, as one Column.

Matching is by JSON type and value (3 isn't 3.0, "3" isn't 3); a range needs a number; a key names a top-level
field. A missing field or payload fails every positive condition and passes must_not.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_ABSENT = object()


@dataclass(frozen=True)
class Range:
    gt: float | None = None
    gte: float | None = None
    lt: float | None = None
    lte: float | None = None


@dataclass(frozen=True)
class Condition:
    key: str
    match: Any = None
    range: Range | None = None


@dataclass(frozen=True)
class Filter:
    must: Sequence[Condition] = field(default_factory=tuple)
    should: Sequence[Condition] = field(default_factory=tuple)
    must_not: Sequence[Condition] = field(default_factory=tuple)

    @classmethod
    def parse(cls, given: str | Mapping | Filter | None) -> Filter:
        """From JSON text or a mapping; ValueError for anything malformed."""
        if given is None or isinstance(given, Filter):
            return given or cls()
        try:
            data = json.loads(given) if isinstance(given, str) else dict(given)
            if not isinstance(data, dict):
                raise TypeError("a filter is an object")
            return cls(*(tuple(_condition(c) for c in data.get(k) or ()) for k in ("must", "should", "must_not")))
        except (TypeError, KeyError, AttributeError, json.JSONDecodeError) as e:
            raise ValueError(f"invalid filter: {e}") from e

    @property
    def empty(self) -> bool:
        return not (self.must or self.should or self.must_not)

    def column(self, payload: str | Column = "payload") -> Column:
        """True where the payload passes; never null."""
        parsed = F.try_parse_json(F.col(payload) if isinstance(payload, str) else payload)
        out = F.lit(True)
        for c in self.must:
            out = out & _leaf(c, parsed)
        for c in self.must_not:
            out = out & ~_leaf(c, parsed)
        if self.should:
            some = F.lit(False)
            for c in self.should:
                some = some | _leaf(c, parsed)
            out = out & some
        return out


def _condition(c: Mapping) -> Condition:
    bounds = c.get("range")
    if bounds is not None:
        bounds = Range(**{k: None if bounds.get(k) is None else float(bounds[k]) for k in ("gt", "gte", "lt", "lte")})
    return Condition(str(c["key"]), c.get("match"), bounds)


def json_path(key: str) -> str:
    """The path of a top-level key; Spark's paths can't escape, so a key with both kinds of quotes is refused."""
    if '"' not in key:
        return f'$["{key}"]'
    if "'" not in key:
        return f"$['{key}']"
    raise ValueError("a path can't name a key with both kinds of quotes; use field_of")


def field_of(parsed: Column, key: str) -> Column:
    """A top-level field of a variant object; null where it is missing. Any key can be asked for."""
    if '"' in key and "'" in key:  # paths have no escapes
        return F.get(F.transform(F.filter(F.map_entries(F.try_variant_get(parsed, "$", "map<string,variant>")), lambda e: e["key"] == key), lambda e: e["value"]), F.lit(0))
    return F.try_variant_get(parsed, json_path(key), "variant")


def type_class(value: Column) -> Column:
    """int, float, string, boolean, null, array or object; null where the field is missing."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.isin("BIGINT", "DECIMAL(20,0)"), "int")
        .when((kind == "DOUBLE") | kind.startswith("DECIMAL"), "float")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
    )


def _leaf(c: Condition, parsed: Column) -> Column:
    if c.match is None and c.range is None:
        return F.lit(True)
    value = field_of(parsed, c.key)
    kind, out = type_class(value), F.lit(True)
    if c.match is not None:
        out = out & _matches(c.match, value, kind)
    if c.range is not None:
        number = F.when(kind.isin("int", "float"), F.try_variant_get(value, "$", "double"))
        out = out & number.isNotNull()
        for bound, test in (("gt", lambda n, b: n > b), ("gte", lambda n, b: n >= b), ("lt", lambda n, b: n < b), ("lte", lambda n, b: n <= b)):
            if (b := getattr(c.range, bound)) is not None:
                out = out & test(number, F.lit(b))
    return F.coalesce(out, F.lit(False))


def _matches(want: Any, value: Column, kind: Column) -> Column:
    if isinstance(want, bool):
        return (kind == "boolean") & (F.try_variant_get(value, "$", "boolean") == want)
    if isinstance(want, int):
        if not -(1 << 63) <= want < 1 << 64:  # stored numbers beyond 64 bits are floats, which no integer matches
            return F.lit(False)
        return (kind == "int") & (F.try_variant_get(value, "$", "decimal(20,0)") == F.lit(str(want)).cast("decimal(20,0)"))
    if isinstance(want, float):
        return (kind == "float") & (F.try_variant_get(value, "$", "double") == want)
    if isinstance(want, str):
        return (kind == "string") & (F.try_variant_get(value, "$", "string") == want)
    return kind.isin("array", "object") & _same_json(want, value)


def _same_json(want: Any, value: Column) -> Column:
    """Equality of nested values, numbers by type: 3 isn't 3.0 at any depth. Object keys may come in any order."""
    given = F.parse_json(F.lit(json.dumps(want)))
    if isinstance(want, Mapping):
        parts = F.try_variant_get(value, "$", "map<string,variant>")
        out = F.coalesce(F.size(F.map_keys(parts)) == len(want), F.lit(False))
        for key, part in want.items():
            out = out & F.coalesce(_same_part(part, field_of(value, str(key))), F.lit(False))
        return out
    if isinstance(want, list | tuple):
        parts = F.try_variant_get(value, "$", "array<variant>")
        out = F.coalesce(F.size(parts) == len(want), F.lit(False))
        for k, part in enumerate(want):
            out = out & F.coalesce(_same_part(part, F.get(parts, F.lit(k))), F.lit(False))
        return out
    return F.to_json(value) == F.to_json(given)


def _same_part(want: Any, value: Column) -> Column:
    kind = type_class(value)
    return kind == "null" if want is None else _matches(want, value, kind)


def parse_conditions(rows: Sequence[tuple[str, str, str]]) -> Filter:
    """A must filter from (key, operator, text) rows: '=' with numeric text as a number; a comparison with text that isn't a number is left out."""
    made = []
    for key, op, text in rows:
        try:
            number: float | int | None = int(text)
        except ValueError:
            try:
                number = float(text)
            except ValueError:
                number = None
        if op == "=":
            made.append(Condition(key, match=text if number is None else number))
        elif number is not None and op in ("gt", "gte", "lt", "lte"):
            made.append(Condition(key, range=Range(**{op: float(number)})))
    return Filter(must=tuple(made))


def contains_text(term: str, id_name: str = "id", payload: str = "payload") -> Column:
    """Case-insensitive substring of the id or of the payload's text."""
    wanted = term.strip().lower()
    return F.contains(F.col(id_name).cast("string"), F.lit(wanted)) | F.coalesce(F.contains(F.lower(payload), F.lit(wanted)), F.lit(False))
