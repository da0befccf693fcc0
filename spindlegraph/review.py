"""The review queue: what normalisation won't decide, and what becomes of a graph when someone does.

The queue is a JSON document of the store, with items and decisions. Decisions change the driver's small state one after
another (a map of merged ids, lists of accepted types and predicates); the graph's tables are rewritten once for all of them.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlegraph.components import written
from spindlegraph.errors import GraphError
from spindlegraph.functions import plain
from spindlegraph.operators.normalize import EVIDENCE_KEY, triples_of
from spindlegraph.store import EVIDENCE, NODES, Store, now_text

KINDS = ("entity_merge", "predicate_unknown", "type_unknown", "schema_drift", "conflict")


def empty() -> dict:
    return {"schema_version": 1, "items": [], "decisions": []}


def merged(queue: dict, found: Sequence[tuple[str, str, dict]], now: str) -> dict:
    """The queue with new items; an item that it has, decided or not, stays as it is. Ids are short, so another item of the same id is new, unless all that is left of the one decided is its id."""
    known = {(i["id"], plain.canonical(i["payload"])) for i in queue["items"]}
    past = {d["id"] for d in queue["decisions"]} - {i["id"] for i in queue["items"]}
    new = [{"id": i, "kind": kind, "status": "pending", "created_at": now, "updated_at": None, "payload": payload, "decision": None} for i, kind, payload in found if i not in past and (i, plain.canonical(payload)) not in known]
    return queue | {"items": queue["items"] + new}


def merged_tables(queue: DataFrame, decided: DataFrame, found: DataFrame) -> DataFrame:
    """The same over tables (id, kind, payload)."""
    known = queue.select("id", "kind", "payload").union(decided.select("id", "kind", "payload"))
    return queue.unionByName(found.join(known, ["id", "kind", "payload"], "left_anti"))


def pending(store: Store) -> int:
    return sum(i["status"] == "pending" for i in store.sidecar("review.json", empty())["items"])


def listed(store: Store, kind: str | None = None, limit: int | None = None) -> list[dict]:
    items = [i for i in store.sidecar("review.json", empty())["items"] if i["status"] == "pending" and kind in (None, i["kind"])]
    return items if limit is None else items[:limit]


def summary(store: Store) -> dict:
    """Pending items by kind, and the predicates that most of them propose."""
    items = listed(store)
    proposed = Counter(i["payload"].get("proposed_p", "") for i in items if i["kind"] == "predicate_unknown")
    return {"pending": len(items), "by_kind": dict(sorted(Counter(i["kind"] for i in items).items())), "top_predicates": sorted(proposed.items(), key=lambda x: (-x[1], x[0]))[:10]}


def summarised(items: DataFrame, most: int = 10) -> DataFrame:
    """(what, name, n) over a table of items (kind, payload): counts of kinds, and of the predicates proposed most."""
    kinds = items.groupBy(F.lit("kind").alias("what"), F.col("kind").alias("name")).agg(F.count("*").alias("n"))
    names = items.where("kind = 'predicate_unknown'").groupBy(F.get_json_object("payload", "$.proposed_p").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(most)
    return kinds.unionByName(names.select(F.lit("predicate").alias("what"), "name", "n"))


def selected(items: Sequence[dict], ids: Sequence[str] | None = None, kind: str | None = None, predicate: str | None = None, everything: bool = False) -> list[dict]:
    """Pending items that meet all that is given; a predicate means proposals of it. Nothing given selects nothing, unless everything does."""
    if ids is None and kind is None and predicate is None and not everything:
        return []
    return [i for i in items if i["status"] == "pending" and (ids is None or i["id"] in ids) and kind in (None, i["kind"]) and (predicate is None or i["kind"] == "predicate_unknown" and i["payload"].get("proposed_p") == predicate)]


class _Changes:
    """What accepted items do to a graph."""

    def __init__(self, spark: SparkSession, nodes: DataFrame, extend: bool, extensions: dict):
        self.spark, self.nodes, self.extend = spark, nodes, extend
        self.types, self.predicates = list(extensions.get("types", [])), list(extensions.get("predicates", []))
        self.moved: dict[str, str] = {}
        self.merges: list[tuple[str, str]] = []
        self.new_nodes: list[tuple] = []
        self.new_evidence: list[tuple] = []

    def _known(self, id_: str) -> bool:
        return id_ not in self.moved and (any(n[0] == id_ for n in self.new_nodes) or not self.nodes.where(F.col("id") == id_).isEmpty())

    def accept(self, item: dict) -> None:
        payload = item["payload"]
        if item["kind"] == "entity_merge":
            keep, drop = payload.get("keep_id") or payload.get("keep"), payload.get("drop_id") or payload.get("drop")
            if not keep or not drop or keep == drop or not self._known(keep) or not self._known(drop):
                raise GraphError("schema_invalid", f"not two nodes to merge: {keep}, {drop}", id=item["id"])
            self.moved = {old: keep if new == drop else new for old, new in self.moved.items()} | {drop: keep}
            self.merges.append((keep, drop))
        elif item["kind"] == "predicate_unknown":
            t = payload.get("triple") or {}
            if not t.get("s") or not t.get("o"):
                raise GraphError("schema_invalid", "the item has no triple", id=item["id"])
            p = payload.get("proposed_p") or t.get("p") or "related_to"
            if self.extend and p not in self.predicates:
                self.predicates.append(p)
            for n, e in enumerate(t.get("provenance") or []):
                span = e.get("span") or {}
                self.new_evidence.append((t["s"], p if self.extend else "related_to", t["o"], e.get("source_path"), e.get("extractor"), e.get("content_hash"), e.get("confidence", "AMBIGUOUS"), span.get("start_line"), span.get("end_line"), e.get("first_seen"), e.get("last_seen"), t.get("score"), None, None, (8, item["id"], n)))
        elif item["kind"] == "type_unknown":
            n = payload.get("node") or {}
            if not n.get("label"):
                raise GraphError("schema_invalid", "the item has no node", id=item["id"])
            kind = payload.get("proposed_type") or n.get("type") or "Concept"
            if self.extend and kind not in self.types:
                self.types.append(kind)
            kind = kind if self.extend else "Concept"
            id_ = n.get("id") or plain.node_id(kind, n["label"])
            if not self._known(id_):
                self.new_nodes.append((id_, kind, n["label"], n.get("description"), n.get("aliases"), (8, item["id"], 0)))
        elif item["kind"] not in KINDS:
            raise GraphError("schema_invalid", f"no such kind: {item['kind']}", id=item["id"])

    def graph(self, evidence: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
        nodes = self.nodes.unionByName(self.spark.createDataFrame(self.new_nodes, NODES))
        evidence = evidence.unionByName(self.spark.createDataFrame(self.new_evidence, EVIDENCE))
        if self.merges:
            # as many rows as decisions
            pairs = F.broadcast(self.spark.createDataFrame([(new, old, k) for k, (old, new) in enumerate(self.moved.items())], "keep string, drop string, k int"))
            gone = nodes.join(pairs, nodes["id"] == pairs["drop"]).groupBy("keep").agg(F.sort_array(F.collect_list(F.struct("k", "label", "aliases", "description"))).alias("g"))
            more = F.flatten(F.transform("g", lambda x: F.concat(F.array(x["label"]), F.coalesce(x["aliases"], F.array().cast("array<string>")))))
            described = F.filter(F.transform("g", lambda x: x["description"]), lambda d: F.coalesce(F.length(d), F.lit(0)) > 0)
            kept = nodes.join(pairs.select(F.col("drop").alias("id")), "id", "left_anti").join(gone, F.col("id") == F.col("keep"), "left")
            nodes = kept.select("id", "type", "label", F.when(F.coalesce(F.length("description"), F.lit(0)) > 0, F.col("description")).otherwise(F.coalesce(F.get(described, F.lit(0)), "description")).alias("description"), F.when(F.col("g").isNull(), F.col("aliases")).otherwise(F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), more))).alias("aliases"), "ord")
            for end in ("s", "o"):
                evidence = evidence.join(pairs.select(F.col("drop").alias("__d"), F.col("keep").alias("__k")), F.col(end) == F.col("__d"), "left").withColumn(end, F.coalesce("__k", end)).drop("__d", "__k")
        # of evidence that has become the same the first stays
        rest = [c for c in evidence.columns if c not in ("s", "p", "o", *EVIDENCE_KEY)]
        evidence = evidence.groupBy("s", "p", "o", *EVIDENCE_KEY).agg(*(F.min_by(c, "ord").alias(c) for c in rest))
        evidence = evidence.withColumn("first_seen", F.coalesce("first_seen", F.lit(now))).withColumn("last_seen", F.coalesce("last_seen", "first_seen"))
        return nodes, evidence


def resolve(spark: SparkSession, root: str, action: str, ids: Sequence[str] | None = None, kind: str | None = None, predicate: str | None = None, everything: bool = False, extend_ontology: bool = False, now: str | None = None) -> dict:
    """Accepts or rejects pending items under one lock and one publication; items that can't be applied are skipped with the reason.

    An accepted merge leads all triples of the dropped node to the kept one, which takes its names as aliases. A predicate or
    type is written as proposed and joins the ontology, or without extend_ontology as related_to or Concept. Conflicts and
    drifts are recorded alone."""
    if action not in ("accept", "reject"):
        raise ValueError("action is accept or reject")
    store, now = Store(spark, root), now or now_text()
    with store.lock():
        queue = store.sidecar("review.json", empty())
        chosen = selected(queue["items"], ids, kind, predicate, everything)
        if not chosen:
            return {"resolved": [], "skipped": []}
        current = store.load()
        extensions = store.sidecar("ontology-extensions.json", {})
        changes = _Changes(spark, current.nodes, extend_ontology, extensions)
        done, skipped = [], []
        for item in chosen:
            try:
                if action == "accept":
                    changes.accept(item)
            except GraphError as why:
                skipped.append({"id": item["id"], "reason": str(why)})
                continue
            decision = {"action": action, "at": now} | ({"extend_ontology": True} if action == "accept" and extend_ontology else {})
            item |= {"status": f"{action}ed", "updated_at": now, "decision": decision}
            queue["decisions"].append({"id": item["id"]} | decision)
            done.append(item["id"])
        if changes.merges or changes.new_nodes or changes.new_evidence:
            nodes, evidence = changes.graph(current.evidence, now)
            evidence = written(evidence)
            meta = {k: v for k, v in current.meta.items() if k not in ("version", "stats")}
            store.publish(nodes, evidence, triples_of(evidence), meta, base=False)
        if extend_ontology:
            store.write_sidecar("ontology-extensions.json", {"types": changes.types, "predicates": changes.predicates})
            lock = store.sidecar("ontology-lock.json", {"node_types": [], "predicates": []})
            lock["node_types"] = list(dict.fromkeys([*lock["node_types"], *changes.types]))
            known = {p["id"] for p in lock["predicates"]}
            lock["predicates"] += [{"id": p, "domain": ["*"], "range": ["*"]} for p in changes.predicates if p not in known]
            store.write_sidecar("ontology-lock.json", lock)
        store.write_sidecar("review.json", queue)
        return {"resolved": done, "skipped": skipped}


def payload_id(kind: str, payload: dict) -> str:
    return plain.review_id(kind, json.loads(json.dumps(payload)))
