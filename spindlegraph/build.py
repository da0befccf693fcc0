"""The write path: builds from a corpus, whole or of what changed, merges of candidates, asserted and retracted facts, supersession."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlegraph import ontology as packs
from spindlegraph import review
from spindlegraph.components import written
from spindlegraph.errors import GraphError
from spindlegraph.functions import plain, text
from spindlegraph.operators.normalize import Normalized, normalize, triples_of
from spindlegraph.plans.retrieval import resolved
from spindlegraph.sources import discover as sources
from spindlegraph.store import EVIDENCE, NODES, Store, Version, now_text

EPISODES = "episodes.jsonl"
EPISODE = "at string, actor string, action string, s string, p string, o string, s_label string, o_label string, s_type string, o_type string, confidence string, note string, supersedes string"
MOST_DIAGNOSTICS = 40


def without_paths(evidence: DataFrame, gone: DataFrame) -> DataFrame:
    """Evidence but for that of these source_paths; triples left without any are gone with it, nodes aren't."""
    return evidence.join(gone.select("source_path").distinct(), "source_path", "left_anti")


def delta(listed: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, state) of paths listed now or before: fresh, changed or removed, by content_hash."""
    both = listed.select("path", F.col("content_hash").alias("now")).join(manifest.select("path", F.col("content_hash").alias("then")), "path", "full_outer")
    state = F.when(F.col("now").isNull(), "removed").when(F.col("then").eqNullSafe(F.col("now")), "fresh").otherwise("changed")
    return both.select("path", state.alias("state"))


def episode_hash(episode: dict) -> str:
    return hashlib.sha256(json.dumps(episode, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    """The log's episodes with their line; lines that were torn or say nothing are left out."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value")
    parsed = lines.select("line", "value", F.from_json("value", EPISODE).alias("e")).select("line", "value", "e.*")
    said = lambda c: F.coalesce(F.length(c), F.lit(0)) > 0
    return parsed.where(said("s") & said("p") & said("o") & said("action"))


def replayed(episodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes that assertions made, evidence of triples whose last episode asserts them, and (s, p, o) of those whose last retracts them."""
    whole = F.struct(*[c for c in episodes.columns if c not in ("s", "p", "o")])
    last = episodes.groupBy("s", "p", "o").agg(F.max_by(whole, "line").alias("e")).select("s", "p", "o", "e.*")
    gone = last.where("action = 'retract'").select("s", "p", "o")
    order = F.struct(F.lit(2).alias("phase"), F.lit(EPISODES).alias("path"), F.col("line").alias("n")).alias("ord")
    none = lambda kind: F.lit(None).cast(kind)
    evidence = last.where("action <> 'retract'").select("s", "p", "o", F.lit(EPISODES).alias("source_path"), F.col("actor").alias("extractor"), F.sha2(F.col("value").cast("binary"), 256).alias("content_hash"), F.coalesce("confidence", F.lit("INFERRED")).alias("confidence"), none("int").alias("start_line"), none("int").alias("end_line"), F.col("at").alias("first_seen"), F.col("at").alias("last_seen"), none("double").alias("score"), F.when(F.col("supersedes").isNotNull(), F.array("supersedes")).alias("supersedes"), none("array<string>").alias("superseded_by"), order)
    end = lambda e: F.struct(F.col(e).alias("id"), F.coalesce(f"{e}_type", F.lit("Concept")).alias("type"), F.col(f"{e}_label").alias("label"))
    made = episodes.where("action = 'assert'").select("line", F.explode(F.array(end("s"), end("o"))).alias("n")).where("n.label is not null")
    nodes = made.groupBy("n.id").agg(F.max_by("n", "line").alias("n"), F.min("line").alias("line")).select("n.id", "n.type", "n.label", none("string").alias("description"), none("array<string>").alias("aliases"), order)
    return nodes, evidence, gone


def retracted(evidence: DataFrame, gone: DataFrame) -> DataFrame:
    return evidence.join(gone, ["s", "p", "o"], "left_anti")


def capped(diagnostics: DataFrame, most: int = MOST_DIAGNOSTICS) -> list[tuple[str, str, str]]:
    """The first of each order of path, and one row that says how many more there are."""
    rows = [tuple(r) for r in diagnostics.orderBy("path", "code", "message").limit(most + 1).collect()]
    return rows if len(rows) <= most else rows[:most] + [("(all)", "DIAGNOSTICS_TRUNCATED", f"{diagnostics.count() - most} more diagnostics")]


def _commit(root: str) -> str | None:
    try:
        out = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10)
        return out.stdout.strip() or None if out.returncode == 0 else None
    except (OSError, subprocess.SubprocessError):
        return None


def _ontology(store: Store, given: packs.Ontology | str | None) -> packs.Ontology:
    """What is given or configured, with what reviews have added to it."""
    if not isinstance(given, packs.Ontology):
        given = packs.load(given or (store.sidecar("config.json", {}) or {}).get("ontology", "general"), store.root)
    more = store.sidecar("ontology-extensions.json", {})
    return given.extended(more.get("types", ()), more.get("predicates", ()))


def _publish(store: Store, done: Normalized, evidence: DataFrame, ontology: packs.Ontology, now: str, caps, commit: str | None = None) -> Version:
    reviews = [(r.id, r.kind, json.loads(r.payload)) for r in done.reviews.orderBy("id").collect()]
    triples = done.triples if evidence is done.evidence else triples_of(evidence)
    version = store.publish(done.nodes, evidence, triples, {"built_at": now, "built_at_commit": commit, "ontology": ontology.id, "ontology_version": ontology.version}, caps)
    store.write_sidecar("review.json", review.merged(store.sidecar("review.json", review.empty()), reviews, now))
    store.write_sidecar("ontology-lock.json", ontology.lock())
    return version


def build(spark: SparkSession, root: str, corpus: str | Sequence[str], full: bool = False, ontology: packs.Ontology | str | None = None, globs: Sequence[str] | None = None, now: str | None = None, caps: tuple[int, int] | None = None, wait: float = 0.0) -> dict:
    """Extracts the corpus, or without `full` what changed since the last build, into the store at root. caps: most nodes and triples; none by default."""
    store, now = Store(spark, root), now or now_text()
    with store.lock(wait):
        onto = _ontology(store, ontology)
        found = sources.discover(spark, corpus, globs)
        prior = store.load() if store.exists() and not full else None
        manifest = store.sidecar("manifest.json", {}) if prior else {}
        # files of the size and time they had are what they were; others are read, and compared by their hash
        listed = [r.asDict() for r in found.files.select("path", "length", "modified").collect()]
        stamp = lambda r: [r["length"], r["modified"].timestamp()]
        name = lambda p: sources._local(p) or p
        doubtful = [r["path"] for r in listed if (m := manifest.get(name(r["path"]))) is None or m["stamp"] != stamp(r)]
        extracted = sources.extract(spark, found, None if prior is None else doubtful) if doubtful or prior is None else None
        hashes = {r.path: r.content_hash for r in extracted.files.collect()} if extracted else {}
        changed = {p for p, h in hashes.items() if manifest.get(p, {}).get("content_hash") != h} if prior else set(hashes)
        removed = set(manifest) - {name(r["path"]) for r in listed}
        diagnostics = found.diagnostics.unionByName(extracted.diagnostics) if extracted else found.diagnostics
        paths = lambda ps: spark.createDataFrame([(p,) for p in sorted(ps)], "source_path string")
        nodes, evidence = spark.createDataFrame([], NODES), spark.createDataFrame([], EVIDENCE)
        phase = lambda df: df.withColumn("ord", F.struct(F.lit(0).alias("phase"), F.concat(F.lpad(F.col("ord.phase").cast("string"), 2, "0"), F.lit("/"), F.coalesce("ord.path", F.lit(""))).alias("path"), F.col("ord.n").alias("n")))
        if prior:
            nodes, evidence = phase(prior.nodes), without_paths(phase(prior.evidence), paths(changed | removed))
        if extracted:
            keep = paths(changed)
            at = F.transform(F.array("ord"), lambda x: x)[0]["path"]
            nodes = nodes.unionByName(extracted.nodes.withColumn("__path", F.regexp_replace(at, "^file:/*", "/")).join(keep, F.col("__path") == F.col("source_path"), "left_semi").drop("__path"))
            evidence = evidence.unionByName(extracted.evidence.join(keep, "source_path", "left_semi"))
        log = store.path(EPISODES)
        gone = spark.createDataFrame([], "s string, p string, o string")
        if os.path.exists(log):
            more_nodes, more, gone = replayed(read_episodes(spark, f"file://{log}"))
            nodes, evidence = nodes.unionByName(more_nodes), evidence.unionByName(more)
        done = normalize(nodes, evidence, onto, now)
        kept = written(retracted(done.evidence, gone))
        version = _publish(store, done, kept, onto, now, caps, _commit(store.root))
        fresh = {name(r["path"]): stamp(r) for r in listed}
        entry = lambda p, s: {"content_hash": hashes.get(p) or manifest[p]["content_hash"], "stamp": s, "last_extracted_at": now if p in changed else manifest[p]["last_extracted_at"], "extractor": sources.registered().get(os.path.splitext(p)[1].lower())}
        # a file that couldn't be parsed isn't in the manifest, so that it is tried again
        store.write_sidecar("manifest.json", {p: entry(p, s) for p, s in fresh.items() if p in hashes or p in manifest})
        return version.meta["stats"] | {"store": store.root, "built_at": now, "sources_total": len(listed), "sources_extracted": len(changed), "sources_fresh": len(listed) - len(changed), "sources_removed": len(removed), "review_pending": review.pending(store), "diagnostics": capped(diagnostics)}


def maintain(spark: SparkSession, root: str, corpus: str | Sequence[str], **options) -> dict:
    return build(spark, root, corpus, full=False, **options)


def merge_candidates(spark: SparkSession, root: str, nodes: DataFrame, evidence: DataFrame, ontology: packs.Ontology | str | None = None, now: str | None = None, caps: tuple[int, int] | None = None) -> dict:
    """Candidates (without ord) beside what the store has; the manifest stays as it is."""
    store, now = Store(spark, root), now or now_text()
    with store.lock():
        onto = _ontology(store, ontology)
        order = F.struct(F.lit(9).alias("phase"), F.lit("candidates").alias("path"), F.monotonically_increasing_id().alias("n"))
        nodes, evidence = written(nodes.withColumn("ord", order)), written(evidence.withColumn("ord", order))
        if store.exists():
            prior = store.load()
            nodes, evidence = prior.nodes.unionByName(nodes), prior.evidence.unionByName(evidence)
        done = normalize(nodes, evidence, onto, now)
        version = _publish(store, done, done.evidence, onto, now, caps)
        return version.meta["stats"] | {"store": store.root, "review_pending": review.pending(store)}


def assert_fact(spark: SparkSession, root: str, s: str, p: str, o: str, s_type: str = "Concept", o_type: str = "Concept", actor: str = "user/assert", confidence: str | None = None, note: str | None = None, supersedes: str | None = None, now: str | None = None, ontology: packs.Ontology | str | None = None) -> dict:
    """Adds a triple between two terms, which are resolved or made; the episode is logged even where the ontology holds the triple back."""
    if not (s and p and o):
        raise GraphError("schema_invalid", "a fact needs s, p and o")
    store, now = Store(spark, root), now or now_text()
    episode: dict = {"at": now, "actor": actor, "action": "assert"}
    made = []
    for end, term, kind in (("s", s, s_type), ("o", o, o_type)):
        id_ = resolved(store.load().nodes, term) if store.exists() else None
        if id_ is None:
            id_ = plain.node_id(kind, term)
            made.append((id_, kind, term))
            episode |= {f"{end}_label": term, f"{end}_type": kind}
        episode[end] = id_
    episode |= {"p": p} | {k: v for k, v in (("confidence", confidence), ("note", note), ("supersedes", supersedes)) if v is not None}
    nodes = spark.createDataFrame([(*m, None, None) for m in made], "id string, type string, label string, description string, aliases array<string>")
    line = json.dumps(episode, ensure_ascii=False)
    # the hash is of the logged line, as replays see it
    row = (episode["s"], p, episode["o"], EPISODES, actor, hashlib.sha256(line.encode()).hexdigest(), confidence or "INFERRED", None, None, now, now, None, None, None)
    evidence = spark.createDataFrame([row], EVIDENCE.rpartition(", ord ")[0])
    merged = merge_candidates(spark, root, nodes, evidence, ontology, now)
    store.append_episode(episode)
    id_ = plain.triple_id(episode["s"], p, episode["o"])
    published = not store.load().triples.where(F.col("id") == id_).isEmpty()
    replaced = None
    if published and supersedes is not None:
        try:
            supersede(spark, root, id_, supersedes, now)
            replaced = supersedes
        except GraphError:  # an unknown loser; the log has the intent
            pass
    return {"triple_id": id_, "s": episode["s"], "p": p, "o": episode["o"], "created": [m[0] for m in made], "gated": not published, "superseded": replaced, "review_pending": merged["review_pending"]}


def _republished(store: Store, evidence: DataFrame, now: str) -> Version:
    current = store.load()
    evidence = written(evidence)
    meta = {k: v for k, v in current.meta.items() if k not in ("version", "stats")} | {"built_at": now}
    return store.publish(current.nodes, evidence, triples_of(evidence), meta, base=False)


def _triple(version: Version, id_: str):
    row = version.triples.where(F.col("id") == id_).select("s", "p", "o").first()
    if row is None:
        raise GraphError("schema_invalid", f"no triple {id_}", id=id_)
    return row


def retract_fact(spark: SparkSession, root: str, triple_id: str, actor: str = "user/retract", note: str | None = None, now: str | None = None) -> dict:
    """Takes a triple out of the graph; builds will leave it out as long as the log's last word is that."""
    store, now = Store(spark, root), now or now_text()
    with store.lock():
        current = store.load()
        t = _triple(current, triple_id)
        _republished(store, current.evidence.where(~((F.col("s") == t.s) & (F.col("p") == t.p) & (F.col("o") == t.o))), now)
        store.append_episode({"at": now, "actor": actor, "action": "retract", "s": t.s, "p": t.p, "o": t.o} | ({"note": note} if note else {}))
        return {"triple_id": triple_id, "removed": True}


def supersede(spark: SparkSession, root: str, winner: str, loser: str, now: str | None = None) -> dict:
    """Links two triples; the loser stays, as history. Links are kept with the evidence, and so by builds of what changed."""
    if winner == loser:
        raise GraphError("schema_invalid", "a triple can't supersede itself", id=winner)
    store, now = Store(spark, root), now or now_text()
    with store.lock():
        current = store.load()
        for id_ in (winner, loser):
            _triple(current, id_)
        id_ = text.triple_id(F.col("s"), F.col("p"), F.col("o"))
        add = lambda c, other: F.array_union(F.coalesce(c, F.array().cast("array<string>")), F.array(F.lit(other)))
        evidence = current.evidence.withColumn("__id", id_)
        evidence = evidence.withColumn("supersedes", F.when(F.col("__id") == winner, add("supersedes", loser)).otherwise(F.col("supersedes"))).withColumn("superseded_by", F.when(F.col("__id") == loser, add("superseded_by", winner)).otherwise(F.col("superseded_by"))).drop("__id")
        _republished(store, evidence, now)
        return {"winner": winner, "loser": loser}
