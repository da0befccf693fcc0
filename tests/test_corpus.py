"""From files to a store and back: grammars, discovery, normalisation, builds, reviews, episodes, snapshots."""

import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from spindlegraph import build, export, ontology, review
from spindlegraph import store as stores
from spindlegraph.errors import GraphError
from spindlegraph.functions import plain, text
from spindlegraph.graph import KnowledgeGraph
from spindlegraph.operators import normalize as norm
from spindlegraph.sources import discover, parsers

NOW = "2026-01-01T00:00:00.000Z"
MD = """---
title: Plan
tags: [alpha, beta]
depends_on: Storage
status: draft
---
# Plan
[[Auth]] --causes--> [[Outage]]
Cache -supports-> Auth
Latency: how long a call takes
See [[Queue]] and [notes](notes.md), [Idea](x) #ops-team.
sk-abcdefghijklmnop is here
"""


def triples(found):
    return [(e["line"], e["s"], e["p"], e["o"]) for e in found.evidence]


def test_markdown():
    f = parsers.markdown("/c/plan.md", MD, "h")
    assert triples(f) == [(3, "Document:plan", "mentions", "Topic:alpha"), (3, "Document:plan", "mentions", "Topic:beta"), (4, "Document:plan", "depends_on", "Concept:storage"), (8, "Concept:auth", "causes", "Concept:outage"), (9, "Concept:cache", "supports", "Concept:auth"), (11, "Document:plan", "mentions", "Concept:queue"), (11, "Document:plan", "mentions", "Document:notes"), (11, "Document:plan", "mentions", "Concept:idea"), (11, "Document:plan", "mentions", "Topic:ops-team")]
    assert f.nodes["Document:plan"]["description"] == "status: draft" and f.nodes["Concept:latency"]["description"] == "how long a call takes"
    g = parsers.markdown("/c/a.md", "[[X]]\nterm: one\nterm: two\nmore #tag\n[[X]]\n[[X]]", "h")
    # no context for the first link; the tag makes the file one; a repeat keeps the first line
    assert triples(g) == [(4, "Document:a-md", "mentions", "Topic:tag"), (5, "Document:a-md", "mentions", "Concept:x")] and g.nodes["Concept:term"]["description"] == "two"
    assert not parsers.markdown("p.txt", "Plain prose says that a causes b, see http://x.y/z today.", "h").evidence
    assert parsers.edge_line("a --x--> b --> c") is None or parsers.edge_line("a --x--> b --> c")[1] == "x"


def test_json_and_yaml():
    fire = dict(type="Concept", label="Fire")
    lines = [dict(type="Concept", label="Drought", aliases=["dry spell", 3, " "], edges=[dict(p="causes", o="Concept:crop-failure"), dict(p="causes", o=fire), dict(o="x"), dict(p="q", o={})]), dict(label="no type"), 7]
    f = parsers.json_records("a.jsonl", "\n".join(map(json.dumps, lines)) + "\n{bad", "h", "lines")
    assert triples(f) == [(None, "Concept:drought", "causes", "Concept:crop-failure"), (None, "Concept:drought", "causes", "Concept:fire")]
    assert f.nodes["Concept:drought"]["aliases"] == ["dry spell"] and sorted(c for c, _ in f.diagnostics) == ["EDGE_INVALID", "EDGE_INVALID", "JSON_LINE_INVALID", "RECORD_INVALID", "RECORD_INVALID"]
    many = parsers.json_records("a.jsonl", "\n".join(["{"] * 20), "h", "lines")
    assert [c for c, _ in many.diagnostics] == ["JSON_LINE_INVALID"] * 8 + ["JSON_LINE_INVALID_TRUNCATED"]
    assert parsers.json_records("a.json", "", "h").diagnostics[0][0] == "CONTENT_EMPTY" and parsers.json_records("a.json", "[NaN]", "h", "document").diagnostics[0][0] == "JSON_INVALID"
    y = parsers.yaml("/d/x.yml", "description: 'it''s' # note\nkeywords:\n- one\n  - two\nuses: [A, 'B c', ]\nnested:\n  k: v\nowner: me\nempty: ~\n", "h")
    assert triples(y) == [(2, "Document:x-yml", "mentions", "Topic:one"), (2, "Document:x-yml", "mentions", "Topic:two"), (5, "Document:x-yml", "uses", "Concept:a"), (5, "Document:x-yml", "uses", "Concept:b-c")]
    assert y.nodes["Document:x-yml"]["description"] == "it''s · owner: me" and y.diagnostics[0][0] == "YAML_NESTED_SKIPPED"


def test_plain_and_columns_agree(spark):
    labels = ["Crop -- Failure!", "Ⅳ ﬁn Été", "?!", "漢字 x", " a b ", "ÀB_c"]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    rows = df.select(text.slug(text.nfkc(F.col("l"))).alias("s"), text.node_id(F.lit("T"), F.col("l")).alias("i"), text.utf16(F.col("l")).alias("n"), text.stems(text.folded(F.col("l"))).alias("w"), text.local_part(F.concat(F.lit("T:"), "l")).alias("p")).collect()
    assert [tuple(r)[:3] for r in rows] == [(plain.slug(x), plain.node_id("T", x), plain.utf16(x)) for x in labels]
    assert [set(r.w) for r in rows] == [plain.stems(plain.folded(x)) for x in labels] and [r.p for r in rows] == labels
    words = ["phases", "buses", "dependencies", "class", "is", "ties", "as"]
    got = spark.createDataFrame([(w,) for w in words], "l string").select(text.stems(F.col("l")).alias("w")).collect()
    assert [set(r.w) for r in got] == [set(plain.variants(w)) for w in words]
    payload = {"b": 1, "a": {"d": "é", "c": [1, 2]}}
    assert plain.canonical(payload) == '{"a":{"c":[1,2],"d":"é"},"b":1}'
    assert spark.range(1).select(text.review_id(F.lit("k"), F.lit(plain.canonical(payload))).alias("r")).first().r == plain.review_id("k", payload)
    assert plain.tokens("Why does the Widget fail, which one?") == ["widget", "fail", "which", "one"] and plain.singular("dependencies") == "dependency"


def test_ontology_packs(tmp_path):
    assert len(ontology.BUILT_IN["general"].types) == 10 and len(ontology.BUILT_IN["general"].predicates) == 14
    assert [len(ontology.BUILT_IN[k].types) for k in ("engineering", "research")] == [12, 11] and [len(ontology.BUILT_IN[k].predicates) for k in ("engineering", "research")] == [17, 9]
    own = {"id": "own", "version": "1", "title": "Own", "node_types": ["Widget"], "predicates": [{"id": "fits"}], "extends": "general", "strict": False}
    (tmp_path / "own.json").write_text(json.dumps(own))
    o = ontology.load("own.json", str(tmp_path))
    assert {"Widget", "Concept"} <= set(o.types) and {"fits", "causes"} <= set(o.predicates) and o.policy("type") == "coerce"
    for bad in (own | {"predicates": [{"id": "causes"}]}, own | {"extends": ["general"]}, own | {"node_types": "x"}, own | {"strange": 1}):
        (tmp_path / "own.json").write_text(json.dumps(bad))
        with pytest.raises(GraphError):
            ontology.load("own.json", str(tmp_path))
    assert set(ontology.ejected(o, {"node_types": ["More"], "predicates": ["p", {"id": "q"}]}, "mine")["node_types"]) > {"More", "Widget"}


def test_discovery(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in (("a.md", "# A"), ("sub/b.JSONL", "{}"), ("c.bin", "x"), ("big.md", "x" * 500)):
        (tmp_path / name).write_text(data)
    c = discover.discover(spark, str(tmp_path), most_bytes=100)
    assert [os.path.basename(r.path) for r in c.files.orderBy("path").collect()] == ["a.md", "b.JSONL"] and [r.code for r in c.diagnostics.collect()] == ["FILE_TOO_LARGE"]
    assert [os.path.basename(r.path) for r in discover.discover(spark, str(tmp_path), ["**/*.{bin,jsonl}"]).files.orderBy("path").collect()] == ["c.bin", "b.JSONL"]
    with pytest.raises(GraphError) as e:
        discover.discover(spark, str(tmp_path / "none"))
    assert e.value.reason == "corpus_not_found"
    (tmp_path / "in").mkdir()
    os.symlink(tmp_path / "a.md", tmp_path / "in" / "out.md")
    with pytest.raises(GraphError) as e:
        discover.discover(spark, str(tmp_path / "in"))
    assert e.value.reason == "path_escape"
    with pytest.raises(GraphError):
        discover.register("mine", [".md"], parsers.markdown)


def names(df):
    return {r.id: (r.type, r.aliases) for r in df.collect()}


NODE = "id string, type string, label string, description string, aliases array<string>, ord struct<phase: int, path: string, n: bigint>"


def node_rows(rows):
    return [(*r, (0, "f", i)) for i, r in enumerate(rows)]


def evidence(spark, rows):
    """rows: (s, p, o, path, confidence, first_seen, last_seen, score)."""
    return spark.createDataFrame([(s, p, o, path, "x", "h", c, 1, 1, a, b, sc, None, None, (0, path, i)) for i, (s, p, o, path, c, a, b, sc) in enumerate(rows)], stores.EVIDENCE)


def test_merges_and_gate(spark):
    nodes = spark.createDataFrame(node_rows([("Person:ada-lovelace", "Person", "Ada Lovelace", None, None), ("Person:ada", "Person", "Ada", "first", ["ada-lovelace"]), ("Concept:math", "Concept", "Math", None, None), ("Concept:maths", "Concept", "Maths", None, None), ("Gadget:x", "Gadget", "X", None, None), ("Concept:math", "Concept", "Mathematics", "numbers", None), ("Concept:ada", "Concept", "Ada", None, None), ("", "Concept", "New one", None, None), ("", "Concept", "New one!", None, None)]), NODE)
    ev = evidence(spark, [("Person:ada", "authored", "Concept:math", "a", "INFERRED", None, None, 0.2), ("Person:ada-lovelace", "authored", "Concept:math", "a", "EXTRACTED", None, None, 0.7), ("Concept:math", "invents", "Concept:maths", "b", "EXTRACTED", None, None, None), ("Gadget:x", "causes", "Concept:math", "b", "EXTRACTED", None, None, None), ("Concept:math", "causes", "Concept:maths", "b", "EXTRACTED", None, None, None), ("Concept:maths", "causes", "Concept:math", "b", "EXTRACTED", "2025", "2025", None), ("Concept:maths", "causes", "Concept:math", "b", "EXTRACTED", None, None, None)])
    done = norm.normalize(nodes, ev, ontology.BUILT_IN["general"], NOW)
    n = names(done.nodes)
    assert n["Person:ada-lovelace"] == ("Person", ["ada", "ada-lovelace"]) and "Person:ada" not in n and n["Concept:math"] == ("Concept", ["mathematics"])
    assert {"Concept:new-one"} <= set(n) and "Concept:new-one-2" not in n  # the second is an alias of the first
    t = {(r.s, r.p, r.o): r for r in done.triples.collect()}
    assert set(t) == {("Person:ada-lovelace", "authored", "Concept:math"), ("Concept:math", "causes", "Concept:maths"), ("Concept:maths", "causes", "Concept:math")}
    ada = t["Person:ada-lovelace", "authored", "Concept:math"]
    assert ada.confidence == "EXTRACTED" and len(ada.provenance) == 2 and ada.score == 0.7
    again = t["Concept:maths", "causes", "Concept:math"].provenance
    assert [(e.first_seen, e.last_seen) for e in again] == [("2025", NOW)]
    kinds = sorted((r.kind, json.loads(r.payload).get("reason")) for r in done.reviews.collect())
    assert ("conflict", "reciprocal_cycle") in kinds and ("entity_merge", "alias_suggestion") in kinds and ("entity_merge", "cross_type_label_clash") in kinds
    assert [k for k, _ in kinds].count("predicate_unknown") == 1 and [k for k, _ in kinds].count("type_unknown") == 1
    for r in done.reviews.collect():
        assert r.id == plain.review_id(r.kind, json.loads(r.payload))
    loose = ontology.Ontology("o", "1", "O", ("Concept",), ("related_to",), False)
    coerced = norm.normalize(nodes, ev, loose, NOW)
    assert {r.p for r in coerced.triples.collect()} == {"related_to"} and names(coerced.nodes)["Person:ada-lovelace"][0] == "Concept"
    dropping = ontology.Ontology("o", "1", "O", ("Concept", "Person"), ("authored",), True, "drop", "drop")
    d = norm.normalize(nodes, ev, dropping, NOW)
    assert {r.p for r in d.triples.collect()} == {"authored"} and not [r for r in d.reviews.collect() if r.kind.endswith("unknown")]


def naive_sweep(rows):
    """The sweep over all pairs, as it is defined."""
    nodes = [dict(r, slugs=None) for r in rows]

    def slugs(n):
        return {plain.slug(n["label"]), plain.local_part(n["id"]), *(plain.slug(a) for a in n["aliases"] or ())}

    moved, asked, gone = {}, set(), set()
    for i, a in enumerate(nodes):
        if i in gone:
            continue
        for j in range(i + 1, len(nodes)):
            b = nodes[j]
            if j in gone:
                continue
            same = bool(slugs(a) & slugs(b))
            if a["type"] != b["type"]:
                if same:
                    asked.add(("cross_type_label_clash", a["id"], b["id"]))
            elif same:
                a["aliases"] = list(dict.fromkeys([*(a["aliases"] or ()), plain.slug(b["label"]), *(plain.slug(x) for x in b["aliases"] or ())]))
                moved[b["id"]] = a["id"]
                gone.add(j)
            elif any(len(x) > 1 and len(y) > 1 and (x == y + "s" or y == x + "s" or norm.acronym(x) == y or norm.acronym(y) == x) for x in slugs(a) for y in slugs(b)):
                asked.add(("alias_suggestion", a["id"], b["id"]))
    return {n["id"]: n["aliases"] for k, n in enumerate(nodes) if k not in gone}, moved, asked


def test_sweep_is_brute_force(spark):
    rng = random.Random(4)
    words = ["red", "reds", "rose", "red rose", "rr", "blue", "blues", "big blue", "bb", "x"]
    tables = []
    for case in range(60):
        rows = []
        for k in range(rng.randrange(2, 9)):
            kind = rng.choice(["A", "B"])
            rows.append({"id": f"{kind}:{case}n{k}", "type": kind, "label": rng.choice(words), "aliases": rng.choice([None, [rng.choice(words)], [rng.choice(words), rng.choice(words)]])})
        tables.append(rows)

    class Row:
        def __init__(self, r):
            self.__dict__.update(r, description=None)

    for rows in tables:
        live, moved, asked = norm.swept([Row(r) for r in rows])
        want = naive_sweep(rows)
        assert ({n.id: n.aliases for n in live}, dict(moved), set(asked)) == want
    # and by components in Spark, all tables as one, their words made apart
    whole = [dict(r, label=f"{r['label']} q{i}" if i % 2 else r["label"]) for i, rows in enumerate(tables[:8]) for r in rows]
    df = spark.createDataFrame(node_rows([(r["id"], r["type"], r["label"], None, r["aliases"]) for r in whole]), NODE)
    nodes, rewrites, reviews = norm.by_name(df)
    keep, moved, asked = naive_sweep(whole)
    assert {r.id: r.aliases for r in nodes.collect()} == keep and {r.old: r.new for r in rewrites.collect()} == moved
    assert {(p["reason"], p["keep"], p["drop"]) for p in (json.loads(r.payload) for r in reviews.collect())} == asked


def test_build_review_and_history(spark, tmp_path):
    corpus, root = tmp_path / "c", str(tmp_path / "s")
    corpus.mkdir()
    (corpus / "a.md").write_text("[[Auth]] --causes--> [[Outage]]\n")
    (corpus / "b.md").write_text("[[Auth]] --causes--> [[Outage]]\n[[Cache]] --warms--> [[Auth]]\n")
    kg = KnowledgeGraph(spark, root)
    assert kg.status()["exists"] is False
    first = kg.build(str(corpus), now=NOW)
    assert (first["triple_count"], first["sources_extracted"], first["review_pending"]) == (1, 2, 1)
    ids = lambda: {(r.s, r.p, r.o): [e.source_path.rpartition("/")[2] for e in r.provenance] for r in kg.graph.triples.collect()}
    assert ids() == {("Concept:auth", "causes", "Concept:outage"): ["a.md", "b.md"]}
    again = kg.maintain(str(corpus))
    assert (again["sources_extracted"], again["sources_fresh"]) == (0, 2) and kg.diff()["counts"] == {"nodes_added": 0, "nodes_removed": 0, "triples_added": 0, "triples_removed": 0}
    kg.store.save_snapshot("one")
    # removed evidence goes, the triple stays as long as it has some
    (corpus / "b.md").unlink()
    kg.maintain(str(corpus))
    assert ids() == {("Concept:auth", "causes", "Concept:outage"): ["a.md"]}
    (corpus / "a.md").write_text("[[Auth]] --precedes--> [[Outage]]\n")
    kg.maintain(str(corpus))
    assert set(ids()) == {("Concept:auth", "precedes", "Concept:outage")}
    d = kg.diff("one")
    assert (d["counts"]["triples_added"], d["counts"]["triples_removed"]) == (1, 1)
    # the review item of the deleted file is still there, and may be accepted with its predicate
    item = kg.review()[0]
    assert item["kind"] == "predicate_unknown" and review.summary(kg.store)["top_predicates"] == [("warms", 1)]
    assert kg.resolve_review("accept") == {"resolved": [], "skipped": []}
    assert kg.resolve_review("accept", predicate="warms", extend_ontology=True)["resolved"] == [item["id"]] and ("Concept:cache", "warms", "Concept:auth") in ids()
    # assertions survive a full build, and so do retractions
    made = kg.assert_fact("Auth", "supports", "Billing", now=NOW)
    assert made["created"] == ["Concept:billing"] and not made["gated"] and kg.assert_fact("Auth", "eats", "Billing")["gated"]
    kg.build(str(corpus), full=True)
    assert ("Concept:auth", "supports", "Concept:billing") in ids()
    kg.retract(made["triple_id"])
    assert ("Concept:auth", "supports", "Concept:billing") not in ids()
    kg.build(str(corpus), full=True)
    assert ("Concept:auth", "supports", "Concept:billing") not in ids()
    # supersession survives builds of what changed
    (corpus / "c.md").write_text("[[A1]] --causes--> [[B1]]\n[[A1]] --precedes--> [[B1]]\n")
    kg.maintain(str(corpus))
    a, b = (plain.triple_id("Concept:a1", p, "Concept:b1") for p in ("causes", "precedes"))
    kg.supersede(b, a)
    (corpus / "d.md").write_text("# D\n")
    kg.maintain(str(corpus))
    links = {r.id: (r.supersedes, r.superseded_by) for r in kg.graph.triples.collect() if r.id in (a, b)}
    assert links == {a: ([], [b]), b: ([a], [])}
    with pytest.raises(GraphError):
        kg.supersede(a, a)
    kg.store.restore("one")
    assert set(ids()) == {("Concept:auth", "causes", "Concept:outage")} and [s["name"] for s in kg.store.snapshots()] == ["one"]
    for form in export.RENDER:
        out = kg.export(form)
        assert out["triple_count"] == 1 and os.path.exists(out["path"]) and "auth" in open(out["path"]).read().lower()
    assert "causes: 1" in kg.report() and kg.status()["triple_count"] == 1


def test_store_is_safe(spark, tmp_path):
    s = stores.Store(spark, str(tmp_path))
    with pytest.raises(GraphError) as e:
        s.load()
    assert e.value.reason == "store_not_found"
    for bad in ("../x", "/etc/x"):
        with pytest.raises(GraphError):
            s.path(bad)
    with s.lock():
        with pytest.raises(GraphError) as e, s.lock():
            pass
        assert e.value.reason == "build_locked"
    with open(s.path(".lock"), "w") as f:
        json.dump({"pid": 2**22 + 1, "host": __import__("socket").gethostname(), "at": 9e12, "key": "x"}, f)
    with s.lock():  # its holder is dead
        pass
    nodes = spark.createDataFrame([("a", "T", "A", None, None, (0, "f", 0))], stores.NODES)
    bad = spark.createDataFrame([("no id", "a", "p", "a", 2, "EXTRACTED", None, None, None, 1, [], (0, "f", 0))], stores.TRIPLES)
    with pytest.raises(GraphError) as e:
        s.publish(nodes, spark.createDataFrame([], stores.EVIDENCE), bad, {"built_at": NOW})
    assert e.value.reason == "schema_invalid" and set(e.value.details) == {"triple_id", "provenance"} and not s.exists()
    with pytest.raises(GraphError) as e:
        s.publish(nodes, spark.createDataFrame([], stores.EVIDENCE), bad.limit(0), {"built_at": NOW}, caps=(0, 0))
    assert e.value.reason == "limit_exceeded"
    s.publish(nodes, spark.createDataFrame([], stores.EVIDENCE), bad.limit(0), {"built_at": NOW})
    assert s.load().nodes.count() == 1 and stores.repair(s).endswith("projection")


def test_invalidation_matrix(spark):
    cases = {"m1": (["E@A", "I@B"], ["A"], "INFERRED"), "m2": (["E@A", "I@B"], ["A", "B"], None), "m3": (["E@A"], ["A"], None), "m4": (["E@A", "E@B"], ["A"], "EXTRACTED"), "m5": (["E@A", "I@B"], ["B"], "EXTRACTED")}
    tier = {"E": "EXTRACTED", "I": "INFERRED"}
    for name, (rows, gone, want) in cases.items():
        ev = evidence(spark, [(name, "p", "o", r[2], tier[r[0]], None, None, None) for r in rows])
        left = build.without_paths(ev, spark.createDataFrame([(g,) for g in gone], "source_path string"))
        got = norm.triples_of(norm.unioned(left, NOW)).collect()
        assert [r.confidence for r in got] == ([want] if want else [])
    states = build.delta(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string"), spark.createDataFrame([("b", "2"), ("c", "9"), ("d", "4")], "path string, content_hash string"))
    assert {r.path: r.state for r in states.collect()} == {"a": "changed", "b": "fresh", "c": "changed", "d": "removed"}


def test_entity_merge(spark, tmp_path):
    corpus, root = tmp_path / "c", str(tmp_path / "s")
    corpus.mkdir()
    (corpus / "a.md").write_text("[[Ledger Service]] --causes--> [[Delay]]\n[[LS]] --causes--> [[Delay]]\nLS: the ledger\n")
    kg = KnowledgeGraph(spark, root)
    kg.build(str(corpus), now=NOW)
    item = next(i for i in kg.review("entity_merge") if i["payload"]["reason"] == "alias_suggestion")
    assert kg.resolve_review("accept", ids=[item["id"]])["resolved"]
    assert {(r.s, r.o) for r in kg.graph.triples.collect()} == {("Concept:ledger-service", "Concept:delay")}
    kept = {r.id: r for r in kg.graph.nodes.collect()}
    assert kept["Concept:ledger-service"].aliases == ["LS"] and kept["Concept:ledger-service"].description == "the ledger" and "Concept:ls" not in kept
    assert kg.resolve_review("accept", everything=True)["resolved"] == [] and list(itertools.islice(kg.review(), 1)) == []


def alike(n=3):
    """n pairs of payloads whose ids as conflicts are the same."""
    seen, out = {}, []
    for k in itertools.count():
        other = seen.setdefault(plain.review_id("conflict", {"k": k}), k)
        if other != k:
            out.append((other, k))
            if len(out) == n:
                return out


def test_items_of_one_id_are_kept_apart(spark):
    pairs = alike()
    texts = [plain.canonical({"k": k}) for p in pairs for k in p]
    found = norm.review_ids(spark.createDataFrame([("conflict", t) for t in texts * 2], "kind string, payload string"))
    assert sorted(r.payload for r in found.collect()) == sorted(texts) and found.select("id").distinct().count() == len(pairs)


def test_a_queue_takes_another_item_of_an_id_it_has(spark):
    (a, b), (c, d), _ = alike()
    one = {k: norm.review_ids(spark.createDataFrame([("conflict", plain.canonical({"k": k}))], "kind string, payload string")) for k in (a, b, c, d)}
    found = one[a].union(one[b]).union(one[c]).union(one[d])
    assert sorted(json.loads(r.payload)["k"] for r in review.merged_tables(one[a], one[c], found).collect()) == sorted((a, b, d))
    items = [(plain.review_id("conflict", {"k": k}), "conflict", {"k": k}) for k in (a, b, c, d)]
    queue = review.merged(review.empty(), [items[0], items[2]], NOW)
    queue["items"][1]["status"], queue["decisions"] = "accepted", [{"id": items[2][0], "action": "accept", "at": NOW}]
    queue = review.merged(review.merged(queue, items, NOW), items, NOW)
    assert [i["payload"]["k"] for i in queue["items"]] == [a, c, b, d]


def test_counts_of_reviews_have_items_of_one_id(spark):
    pairs = [p for p in alike(2)]
    texts = [plain.canonical({"k": k}) for p in pairs for k in p]
    asked = norm.review_ids(spark.createDataFrame([("conflict", t) for t in texts] + [("predicate_unknown", '{"proposed_p":"p"}')], "kind string, payload string"))
    assert {tuple(r) for r in review.summarised(asked).collect()} == {("kind", "conflict", 4), ("kind", "predicate_unknown", 1), ("predicate", "p", 1)}


def test_coerced_types_join_no_evidence(spark):
    nodes = spark.createDataFrame([("a", "Person", "A"), ("b", "Odd", "B"), ("c", "Odd", "C")], "id string, type string, label string")
    rows = [("a", "knows", "b"), ("a", "hates", "b"), ("b", "knows", "none")]
    ev = spark.createDataFrame([(*r, "f", "x", "h", "EXTRACTED", 1, 1, None, None, None, None, None, (0, "f", k)) for k, r in enumerate(rows)], stores.EVIDENCE)
    for policy in ("review", "drop", "coerce"):
        passed, typed, asked = norm.gated(ev, nodes, ontology.Ontology("x", "1", "X", ("Person",), ("knows",), True, "coerce", policy))
        assert sorted((r.s, r.p, r.o) for r in passed.collect()) == sorted((s, "related_to" if p == "hates" else p, o) for s, p, o in rows if policy == "coerce" or p == "knows")
        assert {r.id: r.type for r in typed.collect()} == {"a": "Person", "b": "Concept", "c": "Odd"} and [json.loads(r.payload)["proposed_p"] for r in asked.collect()] == ["hates"] * (policy == "review")
    assert "Join" not in passed._jdf.queryExecution().optimizedPlan().toString()


def test_files_are_spread_and_their_rows_sent_together(spark):
    files = spark.createDataFrame([(f"f{k}.md", f"[[a]] --p--> [[b{k}]]\n".encode()) for k in range(200)], "path string, content binary").coalesce(1)
    assert discover.spread(files).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    registry = {".md": ("markdown", parsers.markdown)}
    batch = files.toArrow().to_batches()[0]
    assert [(b.num_rows, set(b["kind"].to_pylist())) for b in discover._extract(registry, ("triple",))(iter([batch]))] == [(200, {"triple"})]
    whole = [r for b in discover._extract(registry)(iter([batch])) for r in b.to_pylist()]
    assert [r["kind"] for r in whole[:4]] == ["file", "node", "node", "triple"] and len(whole) == 800 and whole[3]["o"] == "Concept:b0" and whole[3]["start_line"] == 1
    failed = [r for b in discover._extract({".md": ("x", lambda *_: 1 / 0)})(iter([batch.slice(0, 1)])) for r in b.to_pylist()]
    assert [(r["kind"], r["code"]) for r in failed] == [("diagnostic", "EXTRACT_FAILED")]


def test_short_ways_give_what_the_rules_give():
    def uncommented(line):
        quote = ""
        for i, c in enumerate(line):
            if c in "'\"" and quote in ("", c):
                quote = "" if quote else c
            elif c == "#" and not quote and (i == 0 or line[i - 1] in " \t"):
                return line[:i]
        return line

    rng = random.Random(4)
    for _ in range(5000):
        line, label = ("".join(rng.choice(signs) for _ in range(rng.randrange(12))) for signs in ("ab:# \t'\"", "aZ0 -_."))
        assert parsers._uncommented(line) == uncommented(line)
        assert plain.slug(label) == ("-".join("".join(c if c.isalnum() else " " for c in label.lower()).split()) or "unnamed")
