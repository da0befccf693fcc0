"""Candidates to a graph: ids, merges of aliases, the ontology's gate, union of evidence, and conflicts for review.

nodes: (id, type, label, description, aliases, ord); evidence: one row for each source of a triple, (s, p, o, source_path,
extractor, content_hash, confidence, start_line, end_line, first_seen, last_seen, score, supersedes, superseded_by, ord). ord is
a struct that orders candidates as they were seen. Aggregations are by id or by triple and combine before the shuffle; only the
sweep of nodes whose names may be the same goes through a task for each component of such nodes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlegraph.components import connected_components, written
from spindlegraph.functions import plain, text
from spindlegraph.ontology import Ontology

#: Predicates of which both directions at once are worth a look.
DIRECTIONAL = tuple("authored blocked_by blocks causes cites delivers depends_on deploys derived_from evaluates implements located_in member_of mitigates owns part_of precedes requires uses uses_method works_for".split())
EVIDENCE_KEY = ("source_path", "extractor", "content_hash", "confidence")
PAYLOAD = ("source_path", "extractor", "content_hash", "confidence", "start_line", "end_line")


@dataclass
class Normalized:
    """nodes: (id, type, label, description, aliases, ord); evidence: as given, under final ids, one row for each key; triples; rewrites: (old, new) ids; reviews: (id, kind, payload)."""

    nodes: DataFrame
    evidence: DataFrame
    triples: DataFrame
    rewrites: DataFrame
    reviews: DataFrame


def review_ids(items: DataFrame) -> DataFrame:
    """(id, kind, payload) of distinct (kind, payload); payload: JSON with sorted keys. An id is 32 bits of hash, so among many items two may share one; both stay."""
    return items.select("kind", "payload").distinct().select(text.review_id(F.col("kind"), F.col("payload")).alias("id"), "kind", "payload")


def pair_review(reason: str, keep: Column, drop: Column) -> Column:
    return F.to_json(F.struct(drop.alias("drop"), drop.alias("drop_id"), keep.alias("keep"), keep.alias("keep_id"), F.lit(reason).alias("reason")))


def with_ids(nodes: DataFrame) -> DataFrame:
    """Nodes without an id get that of type and label; where an earlier node has it, with -2, -3, ... after it."""
    made = text.node_id(F.col("type"), F.col("label"))
    given = F.coalesce(F.col("id"), F.lit("")) != ""
    nodes = nodes.withColumn("__made", ~given).withColumn("id", F.when(given, F.col("id")).otherwise(made))
    late = nodes.where("__made")
    if late.isEmpty():
        return nodes.drop("__made")
    # of one id only rows in the order of generated ones matter
    first = nodes.groupBy("id").agg(F.min("ord").alias("__first"))
    again = late.join(first, "id").withColumn("__nth", F.expr("row_number() over (partition by id order by ord)") - F.when(F.expr("min(ord) over (partition by id)") == F.col("__first"), 1).otherwise(0))
    return nodes.where("not __made").drop("__made").unionByName(again.withColumn("id", F.when(F.col("__nth") > 0, F.concat("id", F.lit("-"), F.col("__nth") + 1)).otherwise(F.col("id"))).drop("__made", "__first", "__nth"))


def by_id(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One node for each id and type; ids that a further type takes over get -2, -3, ..., and the id leads to the one seen last. Returns nodes, rewrites (old, new) and reviews (kind, payload)."""
    n = nodes.withColumn("__empty", F.coalesce(F.col("label"), F.lit("")) == "").withColumn("__described", F.when(F.coalesce(F.col("description"), F.lit("")) != "", F.col("description")))
    kept = n.groupBy("id", "type").agg(
        F.min("ord").alias("ord"), F.max("ord").alias("__last"), F.count("*").alias("__many"), F.min_by("label", F.struct("__empty", "ord")).alias("label"),
        F.min_by("__described", F.when(F.col("__described").isNotNull(), F.col("ord"))).alias("description"), F.min_by("aliases", "ord").alias("aliases"),
    )
    # each further row of a node adds its names as aliases
    further = n.join(kept.where("__many > 1").select(F.col("id").alias("__i"), F.col("type").alias("__t"), F.col("ord").alias("__o")), (F.col("id") == F.col("__i")) & (F.col("type") == F.col("__t"))).where(F.col("ord") > F.col("__o"))
    names = further.select("id", "type", "ord", F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).where("name is not null")
    added = names.groupBy("id", "type", text.slug(text.nfkc(F.col("name"))).alias("slug")).agg(F.min("ord").alias("at"))
    added = added.groupBy(F.col("id").alias("__i"), F.col("type").alias("__t")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "slug"))), lambda x: x["slug"]).alias("__more"))
    kept = kept.join(added, (F.col("id") == F.col("__i")) & (F.col("type") == F.col("__t")), "left").drop("__i", "__t")
    kept = kept.withColumn("aliases", F.when(F.col("__more").isNull(), F.col("aliases")).otherwise(F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), "__more")))).drop("__more")
    kept = written(kept.withColumn("__nth", F.expr("row_number() over (partition by id order by ord)")))
    clash = kept.where("__nth > 1").withColumn("__new", F.concat("id", F.lit("-"), "__nth"))
    rewrites = clash.groupBy(F.col("id").alias("old")).agg(F.max_by("__new", "__last").alias("new"))
    reviews = clash.select(F.lit("entity_merge").alias("kind"), pair_review("cross_type_id_collision", F.col("id"), F.col("id")).alias("payload"))
    renamed = kept.withColumn("id", F.when(F.col("__nth") > 1, F.concat("id", F.lit("-"), "__nth")).otherwise(F.col("id")))
    return renamed.select("id", "type", "label", "description", "aliases", "ord"), rewrites, reviews


def _slugs(label: str | None, id_: str, aliases) -> list[str]:
    """Names a node goes by, distinct: its label's slug, what its id has after the type, and its aliases' slugs."""
    return list(dict.fromkeys([plain.slug(label or ""), plain.local_part(id_), *(plain.slug(a) for a in (aliases if aliases is not None else ()))]))


def acronym(slug: str) -> str | None:
    words = [w for w in slug.split("-") if w]
    return "".join(w[0] for w in words) if len(words) > 1 else None


def _blocking(slug: str) -> set[str]:
    """Two slugs that are equal, plural of one another, or acronym of one another, share a key."""
    out = {slug}
    if len(slug) > 2 and slug.endswith("s"):
        out.add(slug[:-1])
    if (a := acronym(slug)) is not None and len(a) > 1:
        out.add(a)
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels, aliases = (batch.column(k).to_pylist() for k in range(3))
        pairs = [(i, k) for i, label, a in zip(ids, labels, aliases) for k in {k for s in _slugs(label, i, a) for k in _blocking(s)}]
        yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in pairs], pa.string()) for j in range(2)], names=["id", "key"])


class _Name:
    """A node of the sweep; index: place in the order; slugs: those that later nodes are compared with."""

    def __init__(self, row):
        self.id, self.type, self.label, self.description = row.id, row.type, row.label, row.description
        self.aliases = None if row.aliases is None else list(row.aliases)
        self.own = _slugs(self.label, self.id, self.aliases)
        self.live = True

    def absorb(self, other: _Name) -> None:
        self.aliases = list(dict.fromkeys([*(self.aliases or ()), plain.slug(other.label or ""), *(plain.slug(a) for a in other.aliases or ())]))
        self.description = self.description or other.description
        self.label = self.label or other.label
        self.own = _slugs(self.label, self.id, self.aliases)


def near(a: list[str], b: list[str]) -> bool:
    """Whether a slug is another's plural or acronym."""
    for x in a:
        for y in b:
            if len(x) > 1 and len(y) > 1 and (x == y + "s" or y == x + "s" or acronym(x) == y or acronym(y) == x):
                return True
    return False


def swept(rows: list) -> tuple[list[_Name], list[tuple[str, str]], list[tuple[str, str, str]]]:
    """Nodes in order after each has absorbed the later ones of its type that go by one of its names, as it has them by then; (old, new) ids; (reason, keep, drop) for review."""
    names = [_Name(r) for r in rows]
    known: dict[str, set[int]] = {}
    for i, n in enumerate(names):
        for s in n.own:
            for k in _blocking(s):
                known.setdefault(k, set()).add(i)
    moved: dict[str, str] = {}
    asked: list[tuple[str, str, str]] = []
    for i, a in enumerate(names):
        if not a.live:
            continue
        todo = sorted({j for s in a.own for k in _blocking(s) for j in known.get(k, ()) if j > i})
        at = 0
        while at < len(todo):
            b = names[todo[at]]
            at += 1
            if not b.live:
                continue
            same = not set(a.own).isdisjoint(b.own)
            if a.type != b.type:
                if same:
                    asked.append(("cross_type_label_clash", a.id, b.id))
            elif same:
                before = set(a.own)
                a.absorb(b)
                b.live = False
                moved[b.id] = a.id
                fresh = {j for s in set(a.own) - before for k in _blocking(s) for j in known.get(k, ()) if j > todo[at - 1]}
                if fresh - set(todo[at:]):
                    todo[at:] = sorted(fresh | set(todo[at:]))
            elif near(a.own, b.own):
                asked.append(("alias_suggestion", a.id, b.id))
    return [n for n in names if n.live], list(moved.items()), asked


_SWEPT = "what string, id string, type string, label string, description string, aliases array<string>, other string"


def _sweep(group: pd.DataFrame) -> pd.DataFrame:
    # the order is kept as JSON text of (phase, path, n)
    group = group.iloc[sorted(range(len(group)), key=lambda i: json.loads(group["at"].iloc[i]))]
    live, moved, asked = swept(list(group.itertuples(index=False)))
    out = [("node", n.id, n.type, n.label, n.description, n.aliases, None) for n in live]
    out += [("rewrite", old, None, None, None, None, new) for old, new in moved]
    out += [(reason, keep, None, None, None, None, drop) for reason, keep, drop in asked]
    return pd.DataFrame(out, columns=["what", "id", "type", "label", "description", "aliases", "other"])


def by_name(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sweep over nodes of distinct ids: nodes, rewrites (old, new), reviews (kind, payload). Nodes that share no name or near name with another aren't touched."""
    keys = written(nodes.select("id", "label", "aliases").mapInArrow(_keys, "id string, key string"))
    lead = keys.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1")
    links = keys.join(lead, "key").where("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b"))
    groups = written(connected_components(links))
    inside = nodes.join(groups, "id").select("component", "id", "type", "label", "description", "aliases", F.concat(F.lit("["), F.col("ord.phase"), F.lit(","), F.to_json(F.array(F.coalesce("ord.path", F.lit("")))), F.lit(","), F.coalesce("ord.n", F.lit(0)), F.lit("]")).alias("at"))
    done = written(inside.groupBy("component").applyInPandas(lambda g: _sweep(g), _SWEPT))
    merged = done.where("what = 'node'").join(nodes.select("id", "ord"), "id").select("id", "type", "label", "description", "aliases", "ord")
    alone = nodes.join(groups, "id", "left_anti").select("id", "type", "label", "description", "aliases", "ord")
    rewrites = done.where("what = 'rewrite'").select(F.col("id").alias("old"), F.col("other").alias("new"))
    asked = done.where("what not in ('node', 'rewrite')")
    reviews = asked.select(F.lit("entity_merge").alias("kind"), F.to_json(F.struct(F.col("other").alias("drop"), F.col("other").alias("drop_id"), F.col("id").alias("keep"), F.col("id").alias("keep_id"), F.col("what").alias("reason"))).alias("payload"))
    return alone.unionByName(merged), rewrites, reviews


def rewritten(evidence: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Both ends under their new ids."""
    for end in ("s", "o"):
        new = rewrites.select(F.col("old").alias("__old"), F.col("new").alias("__new"))
        evidence = evidence.join(new, F.col(end) == F.col("__old"), "left").withColumn(end, F.coalesce("__new", end)).drop("__old", "__new")
    return evidence


def gated(evidence: DataFrame, nodes: DataFrame, ontology: Ontology) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evidence that the ontology lets through, with coerced predicates; nodes with coerced types where a triple came to that; reviews (kind, payload). Subject, object and predicate are asked in turn; ends that are no node aren't. Nodes of known types stop nothing, so they aren't joined; where types are coerced none does, and evidence isn't joined at all."""
    if ontology.policy("type") == "coerce":
        return _coerced(evidence, nodes, ontology)
    types = nodes.where(ontology.action("type", F.col("type")) != "allow").select("id", "type", "label")
    s, o = (types.toDF(f"__{e}", f"__{e}_type", f"__{e}_label") for e in "so")
    asked = evidence.join(s, F.col("s") == F.col("__s"), "left").join(o, F.col("o") == F.col("__o"), "left")
    does = {e: F.coalesce(ontology.action("type", F.col(f"__{e}_type")), F.lit("allow")) for e in "so"} | {"p": ontology.action("predicate", F.col("p"))}
    stops = lambda c: c.isin("review", "drop")
    outcome = F.when(stops(does["s"]), F.concat(F.lit("s_"), does["s"])).when(stops(does["o"]), F.concat(F.lit("o_"), does["o"])).when(stops(does["p"]), F.concat(F.lit("p_"), does["p"])).otherwise("pass")
    asked = asked.withColumn("__outcome", outcome)
    type_item = lambda e: F.to_json(F.struct(F.struct(F.col(f"__{e}").alias("id"), F.col(f"__{e}_label").alias("label"), F.col(f"__{e}_type").alias("type")).alias("node"), F.col(f"__{e}_type").alias("proposed_type")))
    of_types = asked.where("__outcome in ('s_review', 'o_review')").select(F.lit("type_unknown").alias("kind"), F.when(F.col("__outcome") == "s_review", type_item("s")).otherwise(type_item("o")).alias("payload"))
    of_predicates = _unknown_predicates(asked.where("__outcome = 'p_review'"))
    passed = asked.where("__outcome = 'pass'").withColumn("p", ontology.coerced("predicate", F.col("p"))).select(*evidence.columns)
    return passed, nodes, of_types.unionByName(of_predicates)


def _unknown_predicates(evidence: DataFrame) -> DataFrame:
    """Reviews of triples whose predicate isn't known, with their evidence."""
    entry = F.struct("confidence", "content_hash", "extractor", "first_seen", "last_seen", "source_path", F.when(F.col("start_line").isNotNull(), F.struct("end_line", "start_line")).alias("span"))
    held = evidence.groupBy("s", "p", "o").agg(F.sort_array(F.collect_list(F.struct("ord", entry.alias("e")))).alias("es"))
    return held.select(F.lit("predicate_unknown").alias("kind"), F.to_json(F.struct(F.col("p").alias("proposed_p"), F.struct("o", "p", F.transform("es", lambda x: x["e"]).alias("provenance"), "s").alias("triple"))).alias("payload"))


def _coerced(evidence: DataFrame, nodes: DataFrame, ontology: Ontology) -> tuple[DataFrame, DataFrame, DataFrame]:
    """gated() where unknown types are coerced: predicates alone are asked, and nodes that evidence meets take the type."""
    does = F.coalesce(ontology.action("predicate", F.col("p")), F.lit("allow"))
    passed = evidence.where(~does.isin("review", "drop")).withColumn("p", ontology.coerced("predicate", F.col("p")))
    strange = F.coalesce(ontology.action("type", F.col("type")) == "coerce", F.lit(False))
    met = evidence.select(F.explode(F.array("s", "o")).alias("id")).where("id is not null").distinct().withColumn("__met", F.lit(True))
    changed = nodes.where(strange).join(met, "id", "left").withColumn("type", F.when(F.col("__met"), ontology.coerced("type", F.col("type"))).otherwise(F.col("type")))
    return passed, nodes.where(~strange).unionByName(changed.select(*nodes.columns)), _unknown_predicates(evidence.where(does == "review"))


def unioned(evidence: DataFrame, now: str) -> DataFrame:
    """One row for each (s, p, o) and evidence key, the first seen; first_seen the least; last_seen the greatest, or now where unstamped evidence came again."""
    first = F.coalesce("first_seen", F.lit(now))
    last = F.when(F.col("first_seen").isNull(), F.lit(now)).otherwise(F.coalesce("last_seen", "first_seen"))
    links = lambda c: F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.size(c) > 0, F.struct("ord", c)))), lambda x: x[c]))).alias(c)
    return evidence.groupBy("s", "p", "o", *EVIDENCE_KEY).agg(*(F.min_by(c, "ord").alias(c) for c in ("start_line", "end_line")), F.min(first).alias("first_seen"), F.max(last).alias("last_seen"), F.max("score").alias("score"), links("supersedes"), links("superseded_by"), F.min("ord").alias("ord"))


def triples_of(evidence: DataFrame) -> DataFrame:
    """(id, s, p, o, r, confidence, score, supersedes, superseded_by, sources, provenance, ord) of unioned evidence; provenance in the order it was seen."""
    entry = F.struct("ord", *PAYLOAD, "first_seen", "last_seen")
    links = lambda c: F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", c))), lambda x: x[c]))).alias(c)
    place = F.when(F.coalesce("source_path", F.lit("")) != "", F.struct("source_path", "start_line", "end_line"))
    found = evidence.groupBy("s", "p", "o").agg(F.max(text.rank(F.col("confidence"))).alias("r"), F.max("score").alias("score"), links("supersedes"), links("superseded_by"), F.size(F.collect_set(place)).alias("sources"), F.sort_array(F.collect_list(entry)).alias("provenance"), F.min("ord").alias("ord"))
    return found.select(text.triple_id(F.col("s"), F.col("p"), F.col("o")).alias("id"), "s", "p", "o", "r", text.tier(F.col("r")).alias("confidence"), "score", "supersedes", "superseded_by", "sources", F.transform("provenance", lambda x: x.dropFields("ord")).alias("provenance"), "ord")


def conflicts(triples: DataFrame) -> DataFrame:
    """(kind, payload) of triples of directional predicates that hold both ways, once for each pair, and of supports against contradicts between the same ends."""
    t = triples.select("id", "s", "p", "o")
    back = t.select(F.col("o").alias("s"), "p", F.col("s").alias("o"), F.col("id").alias("other"))
    both = t.where(F.col("p").isin(*DIRECTIONAL) & (F.col("s") < F.col("o"))).join(back.where(F.col("s") < F.col("o")), ["s", "p", "o"])
    cycle = both.select(F.lit("conflict").alias("kind"), F.to_json(F.struct(F.col("s").alias("a"), F.col("o").alias("b"), "p", F.lit("reciprocal_cycle").alias("reason"), F.array("id", "other").alias("triples"))).alias("payload"))
    against = t.where("p = 'supports'").join(t.where("p = 'contradicts'").select("s", "o", F.col("id").alias("other")), ["s", "o"])
    return cycle.unionByName(against.select(F.lit("conflict").alias("kind"), F.to_json(F.struct("o", F.lit("opposing_predicates").alias("reason"), "s", F.array("id", "other").alias("triples"))).alias("payload")))


def normalize(nodes: DataFrame, evidence: DataFrame, ontology: Ontology, now: str) -> Normalized:
    first, taken, clashes = by_id(with_ids(nodes))
    merged, moved, asked = by_name(written(first))
    moved = written(moved)
    # an id taken over may have been merged since
    led = taken.join(moved.select(F.col("old").alias("new"), F.col("new").alias("__end")), "new", "left").select("old", F.coalesce("__end", "new").alias("new"))
    rewrites = written(led.union(moved.join(led.select("old"), "old", "left_anti")))
    passed, final, gate = gated(rewritten(evidence, rewrites), merged, ontology)
    united = written(unioned(passed, now))
    triples = triples_of(united)
    return Normalized(final, united, triples, rewrites, review_ids(clashes.unionByName(asked).unionByName(gate).unionByName(conflicts(triples))))

