"""Exports of a bounded view of the graph, and reports."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlegraph import review
from spindlegraph.components import written
from spindlegraph.errors import GraphError
from spindlegraph.operators import centrality, communities
from spindlegraph.plans.retrieval import Graph
from spindlegraph.store import Store

MOST_TRIPLES = 5000
ENDINGS = {"mermaid": "mmd", "graphml": "graphml", "cypher": "cypher", "html": "html"}


def view(g: Graph, most: int = MOST_TRIPLES) -> tuple[DataFrame, DataFrame, bool]:
    """Nodes that triples link, the first triples in the order they were seen, and whether there are more."""
    head = written(g.triples.orderBy("ord", "id").limit(most + 1).select("ord", "id", "s", "p", "o", "confidence"))
    first = head.orderBy("ord", "id").limit(most)
    nodes = g.nodes.join(first.select(F.explode(F.array("s", "o")).alias("id")), "id", "left_semi").select("id", "type", "label")
    return nodes, first, head.count() > most


def _plain(text: str) -> str:
    return re.sub("[^A-Za-z0-9_]", "_", text)


def _xml(text: str | None) -> str:
    for sign, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
        text = (text or "").replace(sign, f"&{name};")
    return text


def _quoted(text: str | None) -> str:
    return "'" + (text or "").replace("\\", "\\\\").replace("'", "\\'") + "'"


def mermaid(nodes, triples) -> str:
    names = ['  {}["{}"]'.format(_plain(n.id), (n.label or n.id).replace('"', "#quot;")) for n in nodes]
    return "\n".join(["graph LR", *names, *(f"  {_plain(t.s)} -->|{t.p}| {_plain(t.o)}" for t in triples)]) + "\n"


def graphml(nodes, triples) -> str:
    data = lambda **of: "".join(f'<data key="{k}">{_xml(v)}</data>' for k, v in of.items())
    keys = [f'  <key id="{k}" for="{of}" attr.name="{k}" attr.type="string"/>' for of, ks in (("node", ("label", "type")), ("edge", ("predicate", "confidence"))) for k in ks]
    rows = [f'    <node id="{_xml(n.id)}">{data(label=n.label, type=n.type)}</node>' for n in nodes]
    rows += [f'    <edge id="e{i}" source="{_xml(t.s)}" target="{_xml(t.o)}">{data(predicate=t.p, confidence=t.confidence)}</edge>' for i, t in enumerate(triples)]
    return "\n".join(['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '  <graph id="graph" edgedefault="directed">', *rows, "  </graph>", "</graphml>", ""])


def cypher(nodes, triples) -> str:
    made = [f"MERGE (n:{_plain(n.type) or 'Node'} {{id: {_quoted(n.id)}}}) SET n.label = {_quoted(n.label)};" for n in nodes]
    made += [f"MATCH (a {{id: {_quoted(t.s)}}}), (b {{id: {_quoted(t.o)}}}) MERGE (a)-[r:{_plain(t.p.upper())}]->(b) SET r.confidence = {_quoted(t.confidence)};" for t in triples]
    return "\n".join(["// MERGE statements: running them again changes nothing", *made]) + "\n"


_PAGE = """<!doctype html>
<meta charset="utf-8"><title>{title}</title>
<style>body{{margin:0;font:13px sans-serif}}input{{margin:8px}}canvas{{display:block}}</style>
<input id="find" placeholder="find"><span id="size"></span><canvas id="c"></canvas>
<script>
const data = {data}, c = document.getElementById("c"), x = c.getContext("2d"), find = document.getElementById("find");
const at = new Map(data.nodes.map((n, i) => [n.id, Object.assign(n, {{a: i * 2.4, r: 9 * Math.sqrt(i + 1)}})]));
const links = data.triples.filter(t => at.has(t.s) && at.has(t.o));
document.getElementById("size").textContent = data.nodes.length + " nodes, " + links.length + " triples";
function place(n) {{ return [c.width / 2 + n.r * Math.cos(n.a), c.height / 2 + n.r * Math.sin(n.a)]; }}
function draw() {{
  c.width = innerWidth; c.height = innerHeight - 40;
  x.strokeStyle = "#bbb";
  for (const t of links) {{ x.beginPath(); x.moveTo(...place(at.get(t.s))); x.lineTo(...place(at.get(t.o))); x.stroke(); }}
  const q = find.value.toLowerCase();
  for (const n of data.nodes) {{ const [u, v] = place(n); x.fillStyle = q && (n.label + n.id).toLowerCase().includes(q) ? "#c40" : "#357"; x.fillRect(u - 3, v - 3, 6, 6); x.fillText(n.label || n.id, u + 6, v + 3); }}
}}
find.oninput = onresize = draw; draw();
</script>
"""


def html(nodes, triples, title: str = "graph") -> str:
    data = {"nodes": [{"id": n.id, "type": n.type, "label": n.label} for n in nodes], "triples": [{"s": t.s, "p": t.p, "o": t.o, "confidence": t.confidence} for t in triples]}
    return _PAGE.format(title=_xml(title), data=json.dumps(data, ensure_ascii=False).replace("<", "\\u003c"))


RENDER = {"mermaid": mermaid, "graphml": graphml, "cypher": cypher, "html": html}


def export(store: Store, form: str, out: str | None = None, most: int = MOST_TRIPLES) -> dict:
    if form not in RENDER:
        raise GraphError("schema_invalid", f"no such form: {form}", form=form)
    nodes, triples, more = view(store.load().graph, most)
    nodes, triples = nodes.orderBy("id").collect(), triples.orderBy("ord", "id").collect()
    path = out or store.path(f"exports/graph.{ENDINGS[form]}")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(RENDER[form](nodes, triples))
    return {"format": form, "path": path, "node_count": len(nodes), "triple_count": len(triples), "truncated": more}


def predicate_counts(triples: DataFrame, most: int | None = None) -> DataFrame:
    counts = triples.groupBy("p").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.expr("p collate unicode"))
    return counts if most is None else counts.limit(most)


def report(store: Store, most: int = 10) -> str:
    """Markdown: sizes, predicates, and central nodes. It is written to the store, which stays the source of truth."""
    version = store.load()
    meta, g = version.meta, version.graph
    predicates = [f"- {r.p}: {r.n}" for r in predicate_counts(g.triples, most).collect()]
    central = [f"- {r.label or r.id} (`{r.id}`) — degree {r.degree}, pr {r.pagerank:.4f}" for r in centrality.top_nodes(g.nodes, g.triples, most).collect()]
    head = [f"- {k}: {v}" for k, v in (("engine", f"{meta['engine']} {meta['engine_version']}"), ("ontology", f"{meta.get('ontology')}@{meta.get('ontology_version')}"), ("built_at", meta["built_at"]), ("nodes", meta["stats"]["node_count"]), ("triples", meta["stats"]["triple_count"]), ("review_pending", review.pending(store)))]
    text = "\n".join(["# Graph report", "", "> A summary; the store's tables are the source of truth.", "", *head, "", "## Top predicates", *(predicates or ["- (none)"]), "", "## Central nodes (PageRank)", *(central or ["- (none)"]), ""])
    with open(store.path("report.md"), "w", encoding="utf-8") as f:
        f.write(text)
    return text


def community_report(store: Store, least_size: int = communities.LEAST_SIZE) -> str:
    """Communities as a table of the store and as Markdown."""
    g = store.load().graph
    found = written(communities.communities(g.nodes, g.triples, least_size=least_size))
    found.write.mode("overwrite").parquet(f"file://{store.path('communities')}")
    lines = ["# Communities", ""]
    for c in found.orderBy("id").collect():
        lines += [f"## {c.label} ({c.id}, {c.size} nodes)", f"- stable key: {c.stable_key}", f"- internal triples: {c.internal_triple_count}", "- predicates: " + ", ".join(f"{x.p} ({x['count']})" for x in c.top_predicates[:5]), "- nodes: " + ", ".join(n.label or n.id for n in c.top_nodes[:10]), ""]
    text = "\n".join(lines)
    with open(store.path("communities.md"), "w", encoding="utf-8") as f:
        f.write(text)
    return text
