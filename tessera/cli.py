"""Command line: create, upsert, batch, query, recommend, commit, versions, diff, restore, tag, branch, compact, list, drop, export, import.

    python -m tessera.cli --root DIR create NAME --dim 64 --metric cosine
    python -m tessera.cli --root DIR upsert NAME points.jsonl
    python -m tessera.cli --root DIR query NAME "[0.1, ...]" -k 5 --filter '{"must": [...]}' --tag base
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.catalog import Catalog
from tessera.plans.collection import import_collection
from tessera.plans.versions import At, Retention
from tessera.sources.points import read_jsonl


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--root", required=True, help="catalog folder (a URI that Spark reaches)")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple, named: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        if named:
            c.add_argument("name")
        for names, kw in args:
            c.add_argument(*names, **kw)
        return c

    number, many = {"type": int}, {"type": int, "nargs": "*", "default": []}
    at = [(("--version",), number), (("--tag",), {}), (("--branch",), {})]
    k = (("-k",), {"type": int, "default": 10})
    command("create", (("--dim",), {"type": int, "required": True}), (("--metric",), {"default": "cosine"}))
    command("list", named=False)
    command("drop")
    command("upsert", (("file",), {}))
    command("batch", (("--file",), {}), (("--delete",), many), (("--commit",), {"action": "store_true"}), (("--message",), {}), (("--tag",), {}))
    command("query", (("vector",), {}), k, (("--filter",), {}), *at)
    command("recommend", (("--positive",), many), (("--negative",), many), k, (("--filter",), {}))
    command("scroll", (("--offset",), {"type": int, "default": 0}), (("--limit",), {"type": int, "default": 2000}), *at)
    command("get", (("id",), number))
    command("delete", (("id",), number))
    command("commit", (("--message",), {}), (("--tag",), {}))
    command("versions")
    command("diff", (("a",), number), (("b",), number))
    command("restore", (("version",), number))
    for kind in ("tag", "branch"):
        command(kind, (("ref",), {}), (("version",), number))
    command("compact")
    command("gc", (("--keep-last",), number))
    command("export", (("file",), {}))
    command("import", (("file",), {}))
    return p


def _show(df: DataFrame) -> list[str]:
    """Rows of a small result as JSON lines."""
    return [json.dumps(r.asDict(recursive=True)) for r in df.collect()]


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Run one command; prints and returns its lines."""
    a = _parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    out = _run(a, spark, Catalog(spark, a.root))
    print("\n".join(out))
    return out


def _run(a: argparse.Namespace, spark: SparkSession, catalog: Catalog) -> list[str]:
    at = At(getattr(a, "version", None), getattr(a, "tag", None), getattr(a, "branch", None))
    at = None if at == At() else at
    if a.command == "list":
        return _show(catalog.list())
    if a.command == "create":
        catalog.create(a.name, a.dim, a.metric)
        return [json.dumps({"created": a.name})]
    if a.command == "drop":
        catalog.drop(a.name)
        return [json.dumps({"dropped": a.name})]
    if a.command == "import":
        return [json.dumps(import_collection(spark, a.file, f"{catalog.root}/{a.name}").stats())]
    c = catalog.open(a.name)
    if a.command in ("upsert", "batch"):
        points = read_jsonl(spark, a.file) if a.file else None
        r = c.upsert(points) if a.command == "upsert" else c.write_batch(points, a.delete, a.commit, a.message, a.tag)
        return [json.dumps({"first_id": r.first_id, "count": r.count, "deleted": r.deleted, "version": r.version})]
    if a.command == "query":
        return _show(c.search(json.loads(a.vector), a.k, a.filter, at, True))
    if a.command == "recommend":
        return _show(c.recommend(a.positive, a.negative, a.k, a.filter, True))
    if a.command == "scroll":
        page, total = c.scroll(a.offset, a.limit, at)
        return [*_show(page), json.dumps({"total": total})]
    if a.command == "get":
        return [json.dumps(c.get(a.id))]
    if a.command == "delete":
        return [json.dumps({"deleted": c.delete(a.id)})]
    if a.command == "commit":
        return [json.dumps({"version": c.commit(a.message, a.tag)})]
    if a.command == "versions":
        return _show(c.versions())
    if a.command == "diff":
        return _show(c.diff(a.a, a.b).orderBy("change", "id"))
    if a.command == "restore":
        return [json.dumps({"version": c.restore(a.version)})]
    if a.command in ("tag", "branch"):
        (c.tag if a.command == "tag" else c.branch)(a.ref, a.version)
        return [json.dumps({a.command: a.ref, "version": a.version})]
    if a.command == "compact":
        merged = c.compact()
        return [json.dumps({"segment": merged.name if merged else None})]
    if a.command == "gc":
        versions, segments = c.gc(Retention(a.keep_last))
        return [json.dumps({"versions": versions, "segments": segments})]
    c.export(a.file)
    return [json.dumps({"exported": a.file})]


if __name__ == "__main__":
    main()
