"""A versioned collection of points: immutable Parquet segments, tombstones, a manifest log and one head pointer.

    <root>/config.json                        name, dim, metric, policies (written once)
    <root>/segments/<name>/part-*.parquet     id, vector, payload, sorted by id
    <root>/tombstones/<name>/part-*.parquet   id
    <root>/_heads/<number>.json               the state: working segments and tombstones, next id, tags, branches, newest manifest
    <root>/_manifests/<version>.json          one per commit

The state is the head of the highest number. A write becomes visible when the next number is created, which only one
writer can do: a batch is all or nothing, a commit and its tag too, and a writer that was overtaken starts again on
the new state (`retries` times, then Conflict). A crash at any step leaves the last head in force; a manifest whose file
was not written yet stands in the head, and the next writer writes it. Folders that no head names are never read.
Row data moves as DataFrames only; the driver handles names and numbers.
"""

from __future__ import annotations

import copy
import json
import tarfile
import threading
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.filters import Filter
from tessera.functions.vectors import Metric, finite, l2_normalize
from tessera.operators import compose, search
from tessera.operators.ann import IvfIndex
from tessera.plans.policy import Clock, Compaction, Versioning, compaction_due, pending_after_commit, system_clock
from tessera.plans.versions import At, Manifest, Refs, Retention, Segment, VersionLog, gc_plan
from tessera.sources.fs import Files

SCHEMA = "id long, vector array<float>, payload string"


class DimensionMismatch(ValueError):
    """A vector of another size than the collection's."""


class AlreadyExists(ValueError):
    """A collection of that name exists."""


class NotFound(LookupError):
    """No such collection."""


class Conflict(RuntimeError):
    """Another writer published a head first."""


#: Heads that stay behind the newest one, for readers that have listed them.
OLD_HEADS = 20


@dataclass(frozen=True)
class Config:
    name: str
    dim: int
    metric: Metric
    versioning: Versioning = Versioning()
    compaction: Compaction = Compaction()


@dataclass
class Head:
    version: int | None = None
    segments: list[Segment] = field(default_factory=list)
    staged: list[Segment] = field(default_factory=list)
    tombstones: list[str] = field(default_factory=list)
    next_id: int = 0
    next_version: int = 0
    last_batch: int | None = None
    pending: int = 0
    last_commit_ms: int = -1
    last_compact_ms: int = -1
    number: int = 0
    tags: dict[str, int] = field(default_factory=dict)
    branches: dict[str, int] = field(default_factory=dict)
    manifest: Manifest | None = None
    dropped: list[str] = field(default_factory=list)  # folders that no working state needs; old versions may
    index: dict[str, Any] | None = None  # name, segments it covers, probes, measured recall

    @property
    def refs(self) -> Refs:
        return Refs(self.tags, self.branches)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Head:
        d = json.loads(text)
        manifest = d["manifest"] and Manifest.from_json(json.dumps(d["manifest"]))
        return cls(**d | {k: [Segment(**s) for s in d[k]] for k in ("segments", "staged")} | {"manifest": manifest})


@dataclass(frozen=True)
class WriteResult:
    """first_id and count of the new points (ids are contiguous, in input order), newly deleted ids, version if committed."""

    first_id: int
    count: int
    deleted: int
    version: int | None

    @property
    def ids(self) -> range:
        return range(self.first_id, self.first_id + self.count)


class Collection:
    def __init__(self, spark: SparkSession, root: str, clock: Clock = system_clock, retries: int = 3):
        self.spark, self.root, self.clock, self.retries = spark, root.rstrip("/"), clock, retries
        self.files = Files(spark)
        if not self.files.exists(f"{self.root}/config.json"):
            raise NotFound(root)
        d = json.loads(self.files.read(f"{self.root}/config.json"))
        self.config = Config(d["name"], d["dim"], Metric.parse(d["metric"]), Versioning(**d["versioning"]), Compaction(**d["compaction"]))
        self.log = VersionLog(self.files, self.root)

    @classmethod
    def create(cls, spark: SparkSession, root: str, name: str, dim: int, metric: Metric | str = "cosine", versioning: Versioning | None = None, compaction: Compaction | None = None, clock: Clock = system_clock) -> Collection:
        if dim < 1:
            raise DimensionMismatch("a collection needs at least one dimension")
        config = Config(name, int(dim), Metric.parse(metric), versioning or Versioning(), compaction or Compaction())
        files = Files(spark)
        try:
            files.create(f"{root.rstrip('/')}/config.json", json.dumps(asdict(config) | {"metric": config.metric.value}))
        except FileExistsError:
            raise AlreadyExists(name) from None
        return cls(spark, root, clock)

    # --- state

    def _head_file(self, number: int) -> str:
        return f"{self.root}/_heads/{number:020d}.json"

    def head(self) -> Head:
        names = [n for n in self.files.names(f"{self.root}/_heads") if n.endswith(".json")]
        if names:
            return Head.from_json(self.files.read(f"{self.root}/_heads/{names[-1]}"))
        created = self.files.modified(f"{self.root}/config.json") if self.clock is system_clock else self.clock()
        return Head(last_commit_ms=created, last_compact_ms=created)

    def _change(self, change: Callable[[Head], Any]) -> Any:
        """Apply a change to the newest head and publish it; anew on the new head when another writer was first."""
        for left in range(self.retries, -1, -1):
            before = self.head()
            self.log.keep(before.manifest)
            head = copy.deepcopy(before)
            out = change(head)
            if head == before:
                return out
            head.number = before.number + 1
            try:
                self.files.create(self._head_file(head.number), head.to_json())
            except FileExistsError:
                names = lambda h: {f"segments/{s.name}" for s in h.segments + h.staged} | {f"tombstones/{t}" for t in h.tombstones} | set(_index_files(h))
                for name in names(head) - names(before):
                    self.files.delete(f"{self.root}/{name}")
                if not left:
                    raise Conflict(f"another writer published head {head.number} of {self.config.name}") from None
                continue
            self.log.keep(head.manifest)
            self.files.delete(self._head_file(head.number - OLD_HEADS))
            return out
        raise AssertionError("unreachable")

    @property
    def head_version(self) -> int | None:
        return self.head().version

    # --- reading

    def _rows(self, segments: Iterable[Segment]) -> DataFrame:
        paths = [f"{self.root}/segments/{s.name}" for s in segments]
        missing = [p for p in paths if not self.files.exists(p)]
        if missing:
            raise FileNotFoundError(f"segments are missing: {missing}")
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def _deleted(self, names: Sequence[str]) -> DataFrame:
        paths = [f"{self.root}/tombstones/{n}" for n in names]
        return self.spark.read.schema("id long").parquet(*paths) if paths else self.spark.createDataFrame([], "id long")

    def _live(self, segments: Sequence[Segment], tombstones: Sequence[str]) -> DataFrame:
        rows = self._rows(segments)
        return search.live(rows, self._deleted(tombstones)) if tombstones else rows

    def read(self, at: At | None = None) -> DataFrame:
        """(id, vector, payload): the live view with staged writes, or exactly a committed version."""
        _, segments, tombstones = self._state(at)
        return self._live(segments, tombstones)

    def count(self, at: At | None = None) -> int:
        return self.read(at).count()

    def stats(self) -> dict[str, Any]:
        return {"name": self.config.name, "dim": self.config.dim, "metric": self.config.metric.value, "count": self.count(), "head_version": self.head_version}

    def _check(self, vector: Sequence[float]) -> None:
        if len(vector) != self.config.dim:
            raise DimensionMismatch(f"expected {self.config.dim} components, got {len(vector)}")

    def _state(self, at: At | None) -> tuple[Head, Sequence[Segment], Sequence[str]]:
        head = self.head()
        if at is None:
            return head, head.segments + head.staged, head.tombstones
        m = self.log.resolve(at, head.version, head.refs, head.manifest)
        return head, m.segments, m.tombstones

    def search(self, query: Sequence[float], k: int = 10, where: Filter | Column | str | Mapping | None = None, at: At | None = None, payloads: bool = False, exact: bool = False, gate: float = 0.95) -> DataFrame:
        """(id, score[, payload]), best first. The query is used as given; cosine scores scale with its length.

        Exact, unless an index was built (`build_index`) whose measured recall reaches the gate.
        """
        self._check(query)
        where = where if isinstance(where, Column) else Filter.parse(where)
        keep = ("payload",) if payloads else ()
        hits = None if exact else self._indexed(query, k, where, at, keep, gate)
        return search.top_k(self.read(at), query, k, self.config.metric, where, keep) if hits is None else hits

    def _indexed(self, query: Sequence[float], k: int, where: Filter | Column | None, at: At | None, keep: Sequence[str], gate: float) -> DataFrame | None:
        """Hits among the probed cells and all rows of the segments that the index doesn't cover; None where the exact search is to answer.

        That is: no index, one below the gate, one that covers segments outside the version asked for, or fewer than k hits.
        """
        head, segments, tombstones = self._state(at)
        index = head.index
        if index is None or index["recall"] is None or index["recall"] < gate or not set(index["segments"]) <= {s.name for s in segments}:
            return None
        path = f"{self.root}/indexes/{index['name']}"
        stored = IvfIndex.read(self.spark, path, SCHEMA, json.loads(self.files.read(f"{path}.json")), self.config.metric, index["probes"])
        rows = stored.near_rows(query).select("id", "vector", "payload")
        later = [s for s in segments if s.name not in index["segments"]]
        if later:
            rows = rows.unionByName(self._rows(later))
        if tombstones:
            rows = search.live(rows, self._deleted(tombstones))
        hits = search.top_k(rows, query, k, self.config.metric, where, keep)
        found = hits.collect()  # k rows at most
        return self.spark.createDataFrame(found, hits.schema) if len(found) == k else None

    def build_index(self, cells: int, k: int = 10, gate: float = 0.95, fit_rows: int = 100_000) -> float | None:
        """Index the working segments and return the recall@k over every id divisible by 50, by the fewest probes that reach the gate.

        Deleted rows of these segments are in the index too, since older versions may show them. Rows written later are searched
        exactly beside it; a compaction drops it. With no such id there is no recall (None) and searches stay exact.
        """

        def change(head: Head) -> float | None:
            working = head.segments + head.staged
            rows = self._rows(working)
            asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
            head.dropped += _index_files(head)
            head.index = None
            if asked.isEmpty():
                return None
            name = f"index-{uuid.uuid4().hex}"
            built = IvfIndex.build(rows, cells, self.config.metric, fit_rows=fit_rows).write(f"{self.root}/indexes/{name}")
            recall = built.measure(asked, k, gate)
            self.files.create(f"{self.root}/indexes/{name}.json", json.dumps(built.centres.tolist()))
            head.index = {"name": name, "segments": [s.name for s in working], "probes": built.probes, "recall": recall}
            return recall

        return self._change(change)

    def search_many(self, queries: DataFrame, k: int = 10, at: At | None = None, where: Filter | Column | str | Mapping | None = None) -> DataFrame:
        where = where if isinstance(where, Column) else Filter.parse(where)
        return search.batch_top_k(search.admit(self.read(at), where), queries, k, self.config.metric)

    def recommend(self, positive: Sequence[int], negative: Sequence[int] = (), k: int = 10, where: Filter | str | Mapping | None = None, payloads: bool = False, deleted_examples: bool = True) -> DataFrame:
        """Deleted points still serve as examples unless told otherwise."""
        head = self.head()
        source = self._rows(head.segments + head.staged) if deleted_examples else None
        return compose.recommend(self.read(), positive, negative, k, self.config.metric, Filter.parse(where), source, ("payload",) if payloads else ())

    def similar_to(self, point_id: int, k: int = 10) -> DataFrame:
        return search.similar_to(self.read(), point_id, k, self.config.metric)

    def scroll(self, offset: int = 0, limit: int = 2000, at: At | None = None) -> tuple[DataFrame, int]:
        return search.scroll(self.read(at), offset, limit)

    def get(self, point_id: int) -> dict[str, Any] | None:
        row = search.get_point(self.read(), point_id).first()
        return row.asDict() if row else None

    # --- writing

    def _ready(self, points: DataFrame) -> DataFrame:
        payload = F.col("payload").cast("string") if "payload" in points.columns else F.lit(None).cast("string")
        vector = F.col("vector").cast("array<float>")
        return points.select(F.monotonically_increasing_id().alias("place"), vector.alias("vector"), payload.alias("payload"))

    def _stage(self, points: DataFrame, first: int) -> Segment | None:
        """Write points as a segment, ids contiguous from `first` in the frame's order."""
        name = f"seg-{uuid.uuid4().hex}"
        raw = f"{self.root}/segments/.{name}"
        self._ready(points).write.parquet(raw)
        rows = self.spark.read.parquet(raw)
        part = F.shiftright("place", 33)
        wrong = F.sum(F.when((F.size("vector") == self.config.dim) & finite("vector"), 0).otherwise(1)).alias("wrong")
        parts = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), wrong).orderBy("part").collect()  # one row a task
        try:
            if any(p["wrong"] for p in parts):
                raise DimensionMismatch(f"vectors must have {self.config.dim} finite components")
            total = sum(p["n"] for p in parts)
            if not total:
                return None
            starts, at = [], first
            for p in parts:
                starts.append((p["part"], at))
                at += p["n"]
            offsets = F.broadcast(self.spark.createDataFrame(starts, "part long, at long"))
            vector = l2_normalize("vector") if self.config.metric.normalises else F.col("vector")
            place = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
            out = rows.withColumn("part", part).join(offsets, "part").select((F.col("at") + place).alias("id"), vector.alias("vector"), "payload")
            out.sortWithinPartitions("id").write.parquet(f"{self.root}/segments/{name}")
            return Segment(name, first, first + total - 1, total)
        finally:
            self.files.delete(raw)

    def _delete(self, head: Head, ids: DataFrame) -> int:
        """Add tombstones for those ids that exist and are live; how many that are."""
        low, high = ids.agg(F.min(F.col("id").cast("long")), F.max(F.col("id").cast("long"))).first()
        if low is None:
            return 0
        # only segments that can hold such ids, and of them only row groups that do (rows are in order of id)
        near = [s for s in head.segments + head.staged if s.id_lo <= high and s.id_hi >= low]
        existing = self._live(near, head.tombstones).where(F.col("id").between(low, high)).select("id")
        fresh = existing.join(ids.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi")
        name = f"del-{uuid.uuid4().hex}"
        path = f"{self.root}/tombstones/{name}"
        fresh.write.parquet(path)
        n = self.spark.read.schema("id long").parquet(path).count()
        if n:
            head.tombstones.append(name)
        else:
            self.files.delete(path)
        return n

    def points(self, rows: Iterable[tuple[Sequence[float], Any]]) -> DataFrame:
        """A frame of (vector, payload) from Python values; payloads are objects or None."""
        listed = [([float(x) for x in v], None if p is None else json.dumps(p)) for v, p in rows]
        for v, _ in listed:
            self._check(v)
        return self.spark.createDataFrame(listed, "vector array<float>, payload string").coalesce(1)

    def upsert(self, points: DataFrame | Iterable[tuple[Sequence[float], Any]]) -> WriteResult:
        """Insert points (an update is a delete and an insert: ids are never reused)."""
        return self.write_batch(points)

    def write_batch(self, points: DataFrame | Iterable | None = None, deletes: DataFrame | Iterable[int] = (), commit: bool = False, message: str | None = None, tag: str | None = None, batch_id: int | None = None) -> WriteResult:
        """Deletes, then inserts, visible at once; optionally committed. A batch_id not above the last one is skipped."""
        if not isinstance(deletes, DataFrame):
            deletes = list(deletes)
        frame = points if points is None or isinstance(points, DataFrame) else self.points(points)

        def change(head: Head) -> WriteResult:
            if batch_id is not None and head.last_batch is not None and batch_id <= head.last_batch:
                return WriteResult(head.next_id, 0, 0, None)
            deleted = 0
            if isinstance(deletes, DataFrame) or deletes:
                deleted = self._delete(head, deletes if isinstance(deletes, DataFrame) else self.spark.createDataFrame([(int(i),) for i in deletes], "id long"))
            first = head.next_id
            segment = self._stage(frame, first) if frame is not None else None
            return self._written(head, first, segment, deleted, commit, message, tag, batch_id)

        return self._change(change)

    def _written(self, head: Head, first: int, segment: Segment | None, deleted: int, commit: bool, message: str | None, tag: str | None, batch_id: int | None) -> WriteResult:
        """Take a staged segment into the head; commit if asked to or due."""
        n = segment.count if segment else 0
        if segment:
            head.staged.append(segment)
            head.next_id = max(head.next_id, segment.id_hi + 1)
        head.last_batch = batch_id if batch_id is not None else head.last_batch
        head.pending += n
        rest = pending_after_commit(self.config.versioning, head.pending, self.clock() - head.last_commit_ms) if n or deleted else None
        version = None
        if commit or rest is not None:
            quota = self.config.versioning.every_n_writes
            head.pending = head.pending - quota if quota is not None and head.pending >= quota else 0
            head.last_commit_ms = self.clock()
            version = self._commit(head, "batch" if commit else "auto", message if commit else None)
            if tag:
                head.tags[tag] = version
        return WriteResult(first, n, deleted, version)

    def insert_with_ids(self, points: DataFrame) -> WriteResult:
        """Insert rows (id, vector[, payload]) under given ids, none below the next free one; later ids follow the largest."""
        payload = F.col("payload").cast("string") if "payload" in points.columns else F.lit(None).cast("string")
        vector = F.col("vector").cast("array<float>")
        stored = l2_normalize("vector") if self.config.metric.normalises else F.col("vector")
        rows = points.select(F.col("id").cast("long").alias("id"), vector.alias("vector"), payload.alias("payload"))

        def change(head: Head) -> WriteResult:
            name = f"seg-{uuid.uuid4().hex}"
            path = f"{self.root}/segments/{name}"
            good = F.when((F.size("vector") == self.config.dim) & finite("vector"), stored)
            rows.select("id", good.alias("vector"), "payload").repartitionByRange("id").sortWithinPartitions("id").write.parquet(path)
            made = self.spark.read.schema(SCHEMA).parquet(path)
            lo, hi, n, kinds, whole = made.agg(F.min("id"), F.max("id"), F.count(F.lit(1)), F.count_distinct("id"), F.count("vector")).first()
            fault = "ids must be given once each" if kinds < n else f"ids below {head.next_id} are taken" if n and lo < head.next_id else ""
            if fault or not n or whole < n:
                self.files.delete(path)
            if n and whole < n:
                raise DimensionMismatch(f"vectors must have {self.config.dim} finite components")
            if fault:
                raise ValueError(fault)
            return self._written(head, lo or 0, Segment(name, lo, hi, n) if n else None, 0, False, None, None, None)

        return self._change(change)

    def delete(self, point_id: int) -> bool:
        """False if unknown or already deleted."""
        return self.write_batch(deletes=[point_id]).deleted > 0

    # --- versions

    def _commit(self, head: Head, trigger: str, message: str | None) -> int:
        head.segments += head.staged
        head.staged = []
        version = head.next_version
        head.manifest = Manifest(version, head.version, self.clock(), trigger, message, tuple(head.segments), tuple(head.tombstones), head.next_id)
        head.version, head.next_version = version, version + 1
        return version

    def commit(self, message: str | None = None, tag: str | None = None, trigger: str = "manual") -> int:
        def change(head: Head) -> int:
            version = self._commit(head, trigger, message)
            if tag:
                head.tags[tag] = version
            return version

        return self._change(change)

    def restore(self, version: int) -> int:
        """A new version with an old one's rows; uncommitted writes are dropped."""

        def change(head: Head) -> int:
            m = self.log.get(version, head.manifest)
            head.segments, head.staged, head.tombstones = list(m.segments), [], list(m.tombstones)
            return self._commit(head, "restore", f"restore of v{version}")

        return self._change(change)

    def tag(self, name: str, version: int) -> None:
        self._change(lambda head: head.tags.update({name: self.log.get(version, head.manifest).version}))

    def branch(self, name: str, version: int) -> None:
        """A named pointer; commits never move it."""
        self._change(lambda head: head.branches.update({name: self.log.get(version, head.manifest).version}))

    def versions(self) -> DataFrame:
        """Oldest first: version, parent, created_at_ms, trigger, message, n_segments, tags."""
        head = self.head()
        tags: dict[int, list[str]] = {}
        for name, v in head.tags.items():
            tags.setdefault(v, []).append(name)
        rows = [(m.version, m.parent, m.created_at_ms, m.trigger, m.message, len(m.segments), sorted(tags.get(m.version, []))) for m in self.log.list(head.manifest)]
        return self.spark.createDataFrame(rows, "version long, parent long, created_at_ms long, trigger string, message string, n_segments int, tags array<string>").orderBy("version")

    def diff(self, from_version: int, to_version: int) -> DataFrame:
        """(id, change): ids added or removed. Segments in both versions are read only for what the tombstones differ in."""
        newest = self.head().manifest
        a, b = self.log.get(from_version, newest), self.log.get(to_version, newest)
        shared = {s.name for s in a.segments} & {s.name for s in b.segments}
        own = lambda m: self._live([s for s in m.segments if s.name not in shared], m.tombstones).select("id")
        both = self._rows([s for s in a.segments if s.name in shared]).select("id")
        gone_a, gone_b = self._deleted(a.tombstones).select("id"), self._deleted(b.tombstones).select("id")
        moved = lambda x, y: both.join(x, "id", "left_semi").join(y, "id", "left_anti")
        before, after = own(a).union(moved(gone_b, gone_a)), own(b).union(moved(gone_a, gone_b))
        added = after.join(before, "id", "left_anti").select("id", F.lit("added").alias("change"))
        removed = before.join(after, "id", "left_anti").select("id", F.lit("removed").alias("change"))
        return added.union(removed)

    # --- maintenance

    def compact(self, purge: bool = False) -> Segment | None:
        """Merge the working segments into one, sorted by id; None with fewer than two. Old versions keep theirs.

        purge: leave out tombstoned rows; the working tombstones then hide nothing and are dropped too.
        """

        def change(head: Head) -> Segment | None:
            working = head.segments + head.staged
            if len(working) < 2:
                return None
            name = f"seg-{uuid.uuid4().hex}"
            rows = self._live(working, head.tombstones) if purge else self._rows(working)
            # no fixed count: adaptive execution merges small ranges, and a large collection isn't squeezed into few tasks
            rows.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{self.root}/segments/{name}")
            lo, hi, n = self._rows([Segment(name, 0, 0, 0)]).agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
            merged = Segment(name, lo if lo is not None else 0, hi if hi is not None else 0, n)
            head.dropped += _index_files(head)
            head.index = None
            head.dropped += [f"segments/{s.name}" for s in working] + ([f"tombstones/{t}" for t in head.tombstones] if purge else [])
            head.segments, head.staged, head.tombstones = [merged], [], [] if purge else head.tombstones
            head.last_compact_ms = self.clock()
            return merged

        return self._change(change)

    def maintain(self) -> Segment | None:
        """Compact if the policy says so."""
        head = self.head()
        return self.compact() if compaction_due(self.config.compaction, len(head.segments) + len(head.staged), self.clock() - head.last_compact_ms) else None

    def maintenance_loop(self, seconds: float, stop: threading.Event) -> threading.Thread:
        """A thread that calls maintain every so many seconds until `stop` is set; a conflict waits for the next turn."""

        def run() -> None:
            while not stop.wait(seconds):
                try:
                    self.maintain()
                except Conflict:
                    continue

        thread = threading.Thread(target=run, name=f"maintain-{self.config.name}", daemon=True)
        thread.start()
        return thread

    def gc(self, rules: Retention) -> tuple[list[int], list[str]]:
        """Remove versions the rules don't retain, and the segments and tombstones that nothing else needs.

        What is to go is named in a head first, so that a crash on the way leaves the rest to the next call.
        """

        def plan(head: Head) -> tuple[list[int], list[str]]:
            history = self.log.list(head.manifest)
            versions, orphans = gc_plan(history, head.refs, head.version, rules, {s.name for s in head.segments + head.staged})
            gone = [m for m in history if m.version in versions]
            held = {f for m in history if m.version not in versions for f in _folders(m.segments, m.tombstones)} | set(_folders(head.segments + head.staged, head.tombstones))
            named = {*head.dropped, *(f for m in gone for f in _folders(m.segments, m.tombstones))}
            head.dropped = sorted(named)
            self._doomed = sorted(named - held)
            return versions, orphans

        versions, orphans = self._change(plan)
        for v in versions:
            self.log.remove(v)
        doomed = self._doomed
        for f in doomed:
            self.files.delete(f"{self.root}/{f}")
        self._change(lambda head: setattr(head, "dropped", [f for f in head.dropped if f not in set(doomed)]))
        return versions, orphans

    def export(self, path: str) -> None:
        """A copy of the collection: a folder on any file system, or, for a path that ends in .tar, a tar file (both on local disk)."""
        if path.endswith(".tar"):
            with tarfile.open(path, "w") as t:
                t.add(self.root.removeprefix("file://"), arcname=".")
            return
        head = self.head()
        _copy(self.spark, self.files, self.root, path.rstrip("/"), head, self.log.list(head.manifest))


def _folders(segments: Iterable[Segment], tombstones: Iterable[str]) -> list[str]:
    return [*(f"segments/{s.name}" for s in segments), *(f"tombstones/{t}" for t in tombstones)]


def _index_files(head: Head) -> list[str]:
    return [f"indexes/{head.index['name']}", f"indexes/{head.index['name']}.json"] if head.index else []


def _copy(spark: SparkSession, files: Files, source: str, target: str, head: Head, history: Sequence[Manifest]) -> None:
    """Rows are copied by Spark jobs, folder by folder; the head comes last, so an interrupted copy is no collection. An index isn't copied."""
    if files.exists(f"{target}/config.json"):
        raise AlreadyExists(target)
    folders = {f for m in history for f in _folders(m.segments, m.tombstones)} | set(_folders(head.segments + head.staged, head.tombstones))
    for f in sorted(folders):
        schema = SCHEMA if f.startswith("segments/") else "id long"
        spark.read.schema(schema).parquet(f"{source}/{f}").write.mode("overwrite").parquet(f"{target}/{f}")
    log = VersionLog(files, target)
    for m in history:
        log.keep(m)
    files.create(f"{target}/_heads/{head.number:020d}.json", replace(head, index=None).to_json())
    files.create(f"{target}/config.json", files.read(f"{source}/config.json"))


def import_collection(spark: SparkSession, path: str, root: str) -> Collection:
    """Copy an exported folder, or unpack an exported tar, into a new folder and open it."""
    files = Files(spark)
    if files.exists(f"{root.rstrip('/')}/config.json"):
        raise AlreadyExists(root)
    if path.endswith(".tar"):
        with tarfile.open(path) as t:
            t.extractall(root.removeprefix("file://"), filter="data")
    else:
        other = Collection(spark, path)
        head = other.head()
        _copy(spark, files, other.root, root.rstrip("/"), head, other.log.list(head.manifest))
    return Collection(spark, root)
