"""A graph's store: versions of Parquet tables, a pointer to the current one, a lock, snapshots, an episode log, and JSON sidecars.

A publication writes a new version's tables and metadata, and then renames a pointer to it, which is the moment it counts.
Readers resolve the pointer once. The store's small files (pointer, lock, log, metadata) are the driver's; tables are written
and read by executors, so the root must be a folder that all share.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import socket
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlegraph.errors import GraphError
from spindlegraph.plans.retrieval import Graph

SCHEMA_VERSION, ENGINE_VERSION = 1, "0.2"
STALE_SECONDS = 15 * 60
NODES = "id string, type string, label string, description string, aliases array<string>, ord struct<phase: int, path: string, n: bigint>"
EVIDENCE = "s string, p string, o string, source_path string, extractor string, content_hash string, confidence string, start_line int, end_line int, first_seen string, last_seen string, score double, supersedes array<string>, superseded_by array<string>, ord struct<phase: int, path: string, n: bigint>"
ENTRY = "struct<source_path: string, extractor: string, content_hash: string, confidence: string, start_line: int, end_line: int, first_seen: string, last_seen: string>"
TRIPLES = f"id string, s string, p string, o string, r int, confidence string, score double, supersedes array<string>, superseded_by array<string>, sources int, provenance array<{ENTRY}>, ord struct<phase: int, path: string, n: bigint>"
TABLES = {"nodes": NODES, "evidence": EVIDENCE, "triples": TRIPLES}

_migrations: dict[int, Callable[[dict], dict]] = {}


def register_migration(from_version: int, step: Callable[[dict], dict]) -> None:
    """step turns the metadata of from_version into that of the next one; it may rewrite tables."""
    _migrations[from_version] = step


def now_text() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


def confined(root: str, relative: str) -> str:
    """A path under root; none that leads out of it, by .. or by links."""
    if os.path.isabs(relative) or ".." in re.split(r"[/\\]", relative):
        raise GraphError("path_escape", f"not under the store: {relative}", path=relative)
    base = os.path.realpath(root)
    whole = os.path.realpath(os.path.join(base, relative))
    if whole != base and not whole.startswith(base + os.sep):
        raise GraphError("path_escape", f"a link leads out of the store: {relative}", path=relative)
    return whole


def _written(path: str, data) -> None:
    """JSON, whole or not at all."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def _read(path: str, default=None):
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return default


def validated(nodes: DataFrame, triples: DataFrame) -> dict[str, int]:
    """How many rows break each rule of the store's schema."""
    bad = lambda **rules: [F.count(F.when(~F.coalesce(c, F.lit(False)), 1)).alias(k) for k, c in rules.items()]
    some = lambda c: F.coalesce(F.length(c), F.lit(0)) > 0
    a = nodes.agg(*bad(node_id=some("id"), node_type=some("type"), node_label=F.col("label").isNotNull())).first().asDict()
    tier = F.col("confidence").isin("EXTRACTED", "INFERRED", "AMBIGUOUS")
    b = triples.agg(*bad(triple_id=F.col("id").rlike("^t_[0-9a-f]{16}$"), triple_ends=some("s") & some("p") & some("o"), confidence=tier, provenance=F.size("provenance") > 0, score=F.col("score").isNull() | F.col("score").between(0, 1))).first().asDict()
    return {k: v for k, v in (a | b).items() if v}


@dataclass
class Version:
    meta: dict
    nodes: DataFrame
    evidence: DataFrame
    triples: DataFrame

    @property
    def graph(self) -> Graph:
        return Graph(self.nodes, self.triples)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, os.path.abspath(root)
        self._cached: dict[str, Version] = {}

    def path(self, relative: str) -> str:
        return confined(self.root, relative)

    # --- the lock

    def _lock_is_stale(self, path: str, held: dict) -> bool:
        if time.time() - held.get("at", 0) > STALE_SECONDS:
            return True
        if held.get("host") != socket.gethostname():
            return False
        try:
            os.kill(held.get("pid", 0), 0)
        except ProcessLookupError:
            return True
        except OSError:
            pass
        return False

    @contextmanager
    def lock(self, wait: float = 0.0):
        """Held by one writer at a time; taken over from one that died or that is older than STALE_SECONDS."""
        os.makedirs(self.root, exist_ok=True)
        path, until, mine = self.path(".lock"), time.time() + wait, uuid.uuid4().hex
        while True:
            try:
                fd = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
                os.write(fd, json.dumps({"pid": os.getpid(), "host": socket.gethostname(), "at": time.time(), "key": mine}).encode())
                os.close(fd)
                break
            except FileExistsError:
                try:
                    held = _read(path, {})
                except ValueError:  # just being written
                    held = {"at": time.time(), "host": ""}
                if held and self._lock_is_stale(path, held):
                    taken = f"{path}.{mine}"
                    try:
                        os.rename(path, taken)  # one of those who try succeeds
                        os.unlink(taken)
                    except FileNotFoundError:
                        pass
                    continue
                if time.time() >= until:
                    raise GraphError("build_locked", "another writer has the store", **held) from None
                time.sleep(0.05)
        try:
            yield
        finally:
            try:
                if _read(path, {}).get("key") == mine:
                    os.unlink(path)
            except (FileNotFoundError, ValueError):
                pass

    def locked(self) -> bool:
        return os.path.exists(self.path(".lock"))

    # --- versions

    def current(self) -> str | None:
        return (_read(self.path("current.json")) or {}).get("version")

    def exists(self) -> bool:
        return os.path.isdir(self.root) and self.current() is not None

    def load(self, version: str | None = None) -> Version:
        """The current version, or another; its metadata are migrated, and a newer schema is refused."""
        version = version or self.current()
        if version is None:
            raise GraphError("store_not_found", f"no graph in {self.root}", path=self.root)
        if version not in self._cached:
            folder = self.path(f"versions/{version}")
            try:
                meta = _read(f"{folder}/meta.json")
            except ValueError as why:
                raise GraphError("schema_invalid", f"metadata aren't JSON: {why}", path=folder) from why
            if meta is None:
                raise GraphError("store_not_found", f"no version {version}", path=folder)
            while meta.get("schema_version") in _migrations and meta["schema_version"] < SCHEMA_VERSION:
                meta = _migrations[meta["schema_version"]](meta)
            if meta.get("schema_version") != SCHEMA_VERSION:
                raise GraphError("schema_invalid", f"schema {meta.get('schema_version')} isn't {SCHEMA_VERSION}", path=folder)
            read = lambda t: self.spark.read.schema(TABLES[t]).parquet(f"file://{folder}/{t}")
            self._cached[version] = Version(meta, *(read(t) for t in TABLES))
        return self._cached[version]

    def publish(self, nodes: DataFrame, evidence: DataFrame, triples: DataFrame, meta: dict, caps: tuple[int, int] | None = None, base: bool = True) -> Version:
        """Writes a version and makes it the current one, unless it breaks the schema or the caps (nodes, triples). base: also what the next diff starts from."""
        version = f"v{time.time_ns():020d}"
        folder = self.path(f"versions/{version}")
        tables = dict(zip(TABLES, (nodes, evidence, triples)))
        try:
            for name, df in tables.items():
                columns = [c.split()[0] for c in re.split(r", (?![^<]*>)", TABLES[name])]
                df.select(*columns).write.parquet(f"file://{folder}/{name}")
            read = {t: self.spark.read.schema(TABLES[t]).parquet(f"file://{folder}/{t}") for t in TABLES}
            counts = {"node_count": read["nodes"].count(), "triple_count": read["triples"].count()}
            if caps and (counts["node_count"] > caps[0] or counts["triple_count"] > caps[1]):
                raise GraphError("limit_exceeded", f"{counts} is over {caps}", **counts)
            wrong = validated(read["nodes"], read["triples"])
            if wrong:
                raise GraphError("schema_invalid", f"rows that break the schema: {wrong}", **wrong)
            meta = meta | {"schema_version": SCHEMA_VERSION, "engine": "spindlegraph", "engine_version": ENGINE_VERSION, "stats": counts, "version": version}
            _written(f"{folder}/meta.json", meta)
        except BaseException:
            shutil.rmtree(folder, ignore_errors=True)
            raise
        _written(self.path("current.json"), {"version": version})
        if base:
            _written(self.path("snapshots/.base.json"), {"version": version})
        self._status(True, None)
        self._swept()
        return self.load(version)

    def _status(self, ok: bool, reason: str | None) -> None:
        _written(self.path("last-build.json"), {"ok": ok, "reason": reason, "finished_at": now_text()})

    def _swept(self) -> None:
        """Versions that neither the pointer, the base nor a snapshot names are deleted, but for the last one before, which a reader may be reading."""
        named = {self.current(), (_read(self.path("snapshots/.base.json")) or {}).get("version"), *(s["version"] for s in self.snapshots())}
        others = sorted(v for v in os.listdir(self.path("versions")) if v not in named)
        for v in others[:-1]:
            shutil.rmtree(self.path(f"versions/{v}"), ignore_errors=True)
            self._cached.pop(v, None)

    # --- sidecars

    def sidecar(self, name: str, default=None):
        return _read(self.path(name), default)

    def write_sidecar(self, name: str, data) -> None:
        _written(self.path(name), data)

    # --- snapshots

    def save_snapshot(self, name: str | None = None, at: str | None = None) -> dict:
        at = at or now_text()
        name = name or at.replace(":", "-").replace(".", "-")
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name):
            raise GraphError("path_escape", f"no name for a snapshot: {name}", name=name)
        current = self.load()
        if validated(current.nodes, current.triples):
            raise GraphError("schema_invalid", "the current graph breaks the schema")
        snapshot = {"name": name, "version": current.meta["version"], "at": at}
        _written(self.path(f"snapshots/{name}.json"), snapshot)
        return snapshot

    def snapshots(self) -> list[dict]:
        """The newest first."""
        folder = self.path("snapshots")
        names = [n for n in os.listdir(folder) if n.endswith(".json") and not n.startswith(".")] if os.path.isdir(folder) else []
        return sorted((_read(f"{folder}/{n}") for n in names), key=lambda s: (s["at"], s["name"]), reverse=True)

    def snapshot(self, name: str) -> dict:
        found = next((s for s in self.snapshots() if s["name"] == name), None)
        if found is None:
            raise GraphError("no_baseline", f"no snapshot {name}", name=name)
        return found

    def restore(self, name: str) -> Version:
        """The snapshot's graph becomes the current one again; sidecars stay as they are."""
        with self.lock():
            version = self.load(self.snapshot(name)["version"])
            if validated(version.nodes, version.triples):
                raise GraphError("schema_invalid", "the snapshot breaks the schema", name=name)
            _written(self.path("current.json"), {"version": version.meta["version"]})
            return version

    def baseline(self, snapshot: str | None = None) -> tuple[str, Version]:
        if snapshot:
            return snapshot, self.load(self.snapshot(snapshot)["version"])
        version = (_read(self.path("snapshots/.base.json")) or {}).get("version")
        if version is None:
            raise GraphError("no_baseline", "name a snapshot, or build first")
        return version, self.load(version)

    # --- the episode log

    def append_episode(self, episode: dict) -> None:
        with open(self.path("episodes.jsonl"), "a", encoding="utf-8") as f:
            f.write(json.dumps(episode, ensure_ascii=False) + "\n")


NODE_PAYLOAD = ("type", "label", "description", "aliases")
TRIPLE_PAYLOAD = ("s", "p", "o", "confidence", "score", "provenance")


def changes(before: Version, after: Version) -> tuple[DataFrame, DataFrame]:
    """(id, change) of nodes and of triples: added, removed, or changed in what describes them; links of supersession don't count."""
    from spindlegraph.operators.graph import difference

    return difference(before.nodes, after.nodes, NODE_PAYLOAD), difference(before.triples, after.triples, TRIPLE_PAYLOAD)


def diff(store: Store, snapshot: str | None = None) -> dict:
    """Ids in their order, and counts, against a snapshot or the last build."""
    label, before = store.baseline(snapshot)
    out: dict = {"baseline": label, "counts": {}}
    for name, df in zip(("nodes", "triples"), changes(before, store.load())):
        rows = df.orderBy("id").collect()
        out[name] = {kind: [r.id for r in rows if r.change == kind] for kind in ("added", "removed", "changed")}
        out["counts"] |= {f"{name}_{kind}": len(out[name][kind]) for kind in ("added", "removed")}
    return out


def projection(version: Version) -> tuple[DataFrame, DataFrame]:
    """Nodes, and edges (source, target, relation, label, confidence, id)."""
    edges = version.triples.select(F.col("s").alias("source"), F.col("o").alias("target"), F.col("p").alias("relation"), F.col("p").alias("label"), "confidence", "id")
    return version.nodes.select("id", "type", "label", "description", "aliases"), edges


def repair(store: Store) -> str:
    """Writes the projection anew from the store's tables."""
    with store.lock():
        nodes, edges = projection(store.load())
        folder = store.path("projection")
        nodes.write.mode("overwrite").json(f"file://{folder}/nodes")
        edges.write.mode("overwrite").json(f"file://{folder}/edges")
        return folder


def status(store: Store, fresh: Callable[[dict], bool] | None = None) -> dict:
    """What a reader may want to know. fresh: whether the manifest's sources are as they were; by default, whether all are there."""
    out: dict = {"exists": store.exists(), "store": store.root, "build_in_progress": os.path.isdir(store.root) and store.locked()}
    if not out["exists"]:
        return out | {"reason": "no graph"}
    meta, manifest = store.load().meta, store.sidecar("manifest.json", {})
    stale = not fresh(manifest) if fresh else any(not os.path.exists(p) for p in manifest)
    pending = sum(i["status"] == "pending" for i in store.sidecar("review.json", {"items": []})["items"])
    built = datetime.fromisoformat(meta["built_at"].replace("Z", "+00:00"))
    last = store.sidecar("last-build.json", {})
    return out | meta["stats"] | {"ontology": meta.get("ontology"), "built_at": meta["built_at"], "age_hours": (datetime.now(UTC) - built).total_seconds() / 3600, "stale": stale, "review_pending": pending, "projection_stale": not os.path.exists(store.path("projection/edges")), "last_build": last.get("finished_at", meta["built_at"]), "reason": last.get("reason")}
