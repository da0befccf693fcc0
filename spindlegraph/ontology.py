"""Ontology packs: the node types and predicates that a graph may have, and what becomes of others."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindlegraph.errors import GraphError

POLICIES = ("review", "coerce", "drop")
COERCED = {"type": "Concept", "predicate": "related_to"}


@dataclass(frozen=True)
class Ontology:
    """domain and range of predicates are carried along and not enforced."""

    id: str
    version: str
    title: str
    types: tuple[str, ...]
    predicates: tuple[str, ...]
    strict: bool = True
    unknown_type: str | None = None
    unknown_predicate: str | None = None
    hash: str = ""
    ends: dict = field(default_factory=dict, compare=False)

    def policy(self, kind: str) -> str:
        given = self.unknown_type if kind == "type" else self.unknown_predicate
        return given if given in POLICIES else "review" if self.strict else "coerce"

    def action(self, kind: str, value: Column) -> Column:
        """allow, or the policy for what isn't known; null where value is."""
        known = self.types if kind == "type" else self.predicates
        return F.when(value.isNull(), None).when(value.isin(*known), "allow").otherwise(self.policy(kind))

    def coerced(self, kind: str, value: Column) -> Column:
        return F.when(self.action(kind, value) == "coerce", COERCED[kind]).otherwise(value)

    def extended(self, types=(), predicates=()) -> Ontology:
        """With types and predicates that reviews have accepted."""
        more = lambda a, b: tuple(dict.fromkeys([*a, *b]))
        return Ontology(self.id, self.version, self.title, more(self.types, types), more(self.predicates, predicates), self.strict, self.unknown_type, self.unknown_predicate, self.hash, self.ends)

    def lock(self) -> dict:
        return {"pack_id": self.id, "pack_version": self.version, "pack_hash": self.hash, "node_types": list(self.types), "predicates": [{"id": p, **self.ends.get(p, {"domain": ["*"], "range": ["*"]})} for p in self.predicates]}


def _built_in(id_: str, title: str, types: str, predicates: str) -> Ontology:
    return Ontology(id_, "1", title, tuple(types.split()), tuple(predicates.split()), True, "review", "review", hashlib.sha256(f"{types}\0{predicates}".encode()).hexdigest())


BUILT_IN = {
    o.id: o
    for o in (
        _built_in("general", "General knowledge", "Claim Community Concept Document Entity Event Organization Person Place Topic", "about authored causes contradicts derived_from located_in member_of mentions part_of precedes related_to same_as supports works_for"),
        _built_in("engineering", "Engineering systems", "API Change Concept Decision Document Entity Event Incident Organization Person Service Topic", "about blocked_by causes delivers depends_on deploys implements mentions mitigates owns part_of precedes related_to requires same_as supports uses"),
        _built_in("research", "Research literature", "Author Claim Concept Dataset Document Entity Method Organization Paper Person Topic", "about authored cites contradicts evaluates related_to same_as supports uses_method"),
    )
}


def _read(path: str) -> tuple[dict, str]:
    try:
        with open(path, "rb") as f:
            data = f.read()
        pack = json.loads(data)
    except (OSError, ValueError) as why:
        raise GraphError("ontology_invalid", f"the pack can't be read: {why}", path=path) from why
    return pack, hashlib.sha256(data).hexdigest()


def _checked(pack, path: str) -> dict:
    """The pack, if it has the right fields."""
    texts = lambda x: isinstance(x, list) and all(isinstance(t, str) and t for t in x)
    known = {"id", "version", "title", "description", "node_types", "predicates", "strict", "unknown_predicate_policy", "unknown_type_policy", "extends"}
    if not isinstance(pack, dict):
        raise GraphError("ontology_invalid", "a pack must be a JSON object", path=path)
    wrong = [k for k in pack if k not in known]
    wrong += [k for k in ("id", "version", "title") if not isinstance(pack.get(k), str) or not pack[k]]
    wrong += [] if texts(pack.get("node_types")) else ["node_types"]
    predicates = pack.get("predicates")
    wrong += [] if isinstance(predicates, list) and all(isinstance(p, dict) and isinstance(p.get("id"), str) and p["id"] and texts(p.get("domain", ["*"])) and texts(p.get("range", ["*"])) for p in predicates) else ["predicates"]
    wrong += [k for k in ("unknown_predicate_policy", "unknown_type_policy") if pack.get(k, "review") not in POLICIES]
    wrong += ["strict"] if not isinstance(pack.get("strict", True), bool) else []
    if wrong:
        raise GraphError("ontology_invalid", f"wrong fields: {', '.join(wrong)}", path=path)
    return pack


def _of(pack: dict, hash_: str) -> Ontology:
    ends = {p["id"]: {"domain": p.get("domain", ["*"]), "range": p.get("range", ["*"])} for p in pack["predicates"]}
    return Ontology(pack["id"], pack["version"], pack["title"], tuple(dict.fromkeys(pack["node_types"])), tuple(ends), pack.get("strict", True), pack.get("unknown_type_policy"), pack.get("unknown_predicate_policy"), hash_, ends)


def load(id_or_path: str = "general", base_dir: str = ".") -> Ontology:
    """A built-in pack, a pack <base_dir>/ontology-packs/<id>/ontology.json, or a file. A pack may extend one that doesn't extend itself; a predicate of both is an error."""

    def found(name: str) -> str | None:
        for path in (os.path.join(base_dir, "ontology-packs", name, "ontology.json"), os.path.join(base_dir, name)):
            if os.path.isfile(path):
                return path
        return None

    path = found(id_or_path)
    if path is None:
        if id_or_path in BUILT_IN:
            return BUILT_IN[id_or_path]
        raise GraphError("ontology_invalid", f"no such pack: {id_or_path}", path=id_or_path)
    pack, hash_ = _read(path)
    _checked(pack, path)
    if "extends" not in pack:
        return _of(pack, hash_)
    base_name = pack["extends"]
    if not isinstance(base_name, str) or not base_name:
        raise GraphError("ontology_invalid", "extends must name one pack", path=path)
    base_path = found(base_name)
    if base_path is None and base_name in BUILT_IN:
        base, base_hash = BUILT_IN[base_name], BUILT_IN[base_name].hash
    elif base_path is not None:
        raw, base_hash = _read(base_path)
        if "extends" in _checked(raw, base_path):
            raise GraphError("ontology_invalid", "the pack that is extended extends another", path=base_path)
        base = _of(raw, base_hash)
    else:
        raise GraphError("ontology_invalid", f"no such pack: {base_name}", path=path)
    child = _of(pack, hash_)
    both = set(base.predicates) & set(child.predicates)
    if both:
        raise GraphError("ontology_invalid", f"both packs define {', '.join(sorted(both))}", path=path)
    return Ontology(child.id, child.version, child.title, tuple(dict.fromkeys([*base.types, *child.types])), base.predicates + child.predicates, child.strict, child.unknown_type, child.unknown_predicate, hashlib.sha256((hash_ + base_hash).encode()).hexdigest(), base.ends | child.ends)


def ejected(ontology: Ontology, lock: dict | None, pack_id: str) -> dict:
    """A pack of one's own: ontology with what the lock has beyond it."""
    lock = lock or {}
    names = [p["id"] if isinstance(p, dict) else p for p in lock.get("predicates", [])]
    whole = ontology.extended(lock.get("node_types", []), names)
    return {"id": pack_id, "version": ontology.version, "title": ontology.title, "node_types": list(whole.types), "predicates": whole.lock()["predicates"], "strict": ontology.strict, "unknown_predicate_policy": ontology.policy("predicate"), "unknown_type_policy": ontology.policy("type")}
