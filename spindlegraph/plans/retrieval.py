"""Questions to subgraphs: seed scores and suggestions, expansion, relevance, token budgets, packs with citations, and answers.

What a question leads to is a few rows of each node's score and the neighbourhood of a few seeds; tables stay distributed until
a pack, which a reader will read, is collected to be rendered.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlegraph.components import sums_before, written
from spindlegraph.errors import GraphError
from spindlegraph.functions import plain, text
from spindlegraph.operators import communities as themes
from spindlegraph.operators import graph

HOPS, SEEDS, FAR = 2, 5, 99
TOP_THEMES, THEME_CITATIONS = 5, 2
#: Signs of an id by which triples are summed up for a budget: some ten thousand ranges of ids that are hashes.
HEAD = 6
ENTRY = "struct<source_path: string, extractor: string, content_hash: string, confidence: string, start_line: int, end_line: int, first_seen: string, last_seen: string>"


@dataclass
class Graph:
    """nodes: (id, type, label, description, aliases); triples: (id, s, p, o, r, confidence, superseded_by, sources, provenance, ...)."""

    nodes: DataFrame
    triples: DataFrame


def _or(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _fields(nodes: DataFrame) -> DataFrame:
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    # aliases are folded as one text, with a sign between that no token has
    return nodes.select("id", "label", F.coalesce(text.folded(F.col("label")), F.lit("")).alias("l"), F.coalesce(text.folded(F.col("description")), F.lit("")).alias("d"), text.folded(F.array_join(aliases, "\n")).alias("a"))


def token_counts(nodes: DataFrame, tokens: Sequence[str]) -> tuple[int, dict[str, int]]:
    """Number of nodes, and of those that have each token in any field."""
    wanted, f = list(dict.fromkeys(tokens)), _fields(nodes)
    hit = lambda t: F.sum(_or([text.mentions(F.col(c), t) for c in "lda"]).cast("long"))
    row = f.agg(F.count("*").alias("n"), *(hit(t).alias(f"t{i}") for i, t in enumerate(wanted))).first()
    return row["n"], {t: row[f"t{i}"] or 0 for i, t in enumerate(wanted)}


def seed_scores(nodes: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """(id, label, score) of nodes that any token hits: for each token, repeated ones again, 3 in the label, 2 in an alias, 1 in the description, times ln(1 + nodes / nodes that have it)."""
    n, df = token_counts(nodes, tokens) if tokens else (0, {})
    idf = {t: F.log1p(F.lit(n / k)) for t, k in df.items() if k}
    score = reduce(lambda a, t: a + idf[t] * reduce(lambda x, y: x + y, (w * text.mentions(F.col(c), t).cast("double") for c, w in (("l", 3), ("d", 1), ("a", 2)))), [t for t in tokens if t in idf], F.lit(0.0))
    return _fields(nodes).select("id", "label", score.alias("score")).where("score > 0")


def scored_seeds(nodes: DataFrame, tokens: Sequence[str], k: int = SEEDS) -> list[str]:
    rows = seed_scores(nodes, tokens).orderBy(F.desc("score"), text.utf16(F.col("label")), F.expr("id collate unicode")).limit(max(0, k))
    return [r.id for r in rows.collect()]


def suggestions(nodes: DataFrame, tokens: Sequence[str], k: int = 5) -> DataFrame:
    """(id, label, distance): nodes with words within a small edit distance of tokens of three characters or more; a token without one adds 3."""
    usable = [plain.singular(t) for t in tokens if len(t) >= 3]
    f = _fields(nodes).select("id", "label", text.stems(F.col("l")).alias("ls"), text.stems(F.col("a")).alias("as"))
    none = 1 << 20

    def best(stem: str) -> Column:
        limit = 2 if len(stem) >= 6 else 1
        near = lambda c: F.coalesce(F.array_min(F.transform(F.filter(c, lambda w: F.abs(F.length(w) - len(stem)) <= limit), lambda w: (d := F.levenshtein(w, F.lit(stem), limit), F.when(d >= 0, d))[1])), F.lit(none))
        return F.when(near("ls") < none, near("ls")).otherwise(near("as"))

    if not usable:
        return f.select("id", "label", F.lit(0).alias("distance")).limit(0)
    each = f.select("id", "label", F.array(*map(best, usable)).alias("b"))
    found = each.withColumn("hit", F.filter("b", lambda x: x < none)).where(F.size("hit") > 0)
    distance = F.aggregate("hit", F.lit(0), lambda a, x: a + x) + 3 * (len(usable) - F.size("hit"))
    return found.select("id", "label", distance.alias("distance")).orderBy("distance", text.utf16(F.col("label")), F.expr("id collate unicode")).limit(k)


def matched(nodes: DataFrame, term: str) -> DataFrame:
    """Nodes with the folded term in id, label or an alias; none for an empty term."""
    t = plain.folded(term).strip()
    if not t:
        return nodes.limit(0)
    return nodes.where(text.folded(F.col("id")).contains(t) | F.coalesce(text.folded(F.col("label")).contains(t), F.lit(False)) | F.coalesce(text.folded(F.array_join("aliases", "\n")).contains(t), F.lit(False)))


def resolved(nodes: DataFrame, term: str) -> str | None:
    """The node of this id, else of those matched the one of the shortest label, then the first id."""
    if row := nodes.where(F.col("id") == term).select("id").first():
        return row.id
    row = matched(nodes, term).orderBy(text.utf16(F.col("label")), F.expr("id collate unicode")).select("id").first()
    return row.id if row else None


def _ids(nodes: DataFrame, ids: Sequence[str]) -> DataFrame:
    return nodes.sparkSession.createDataFrame([(i,) for i in ids], "id string")


def expanded(g: Graph, seeds: DataFrame, hops: int = HOPS) -> Graph:
    """Triples incident to a node nearer than hops, and known nodes within hops."""
    reached = written(graph.distances(g.triples, seeds, hops))
    nodes = g.nodes.join(reached.select("id"), "id", "left_semi")
    if hops <= 0:
        return Graph(nodes, g.triples.limit(0))
    return Graph(nodes, graph.incident(g.triples, reached.where(F.col("depth") < hops)))


def filtered(g: Graph, types: Sequence[str] = (), predicates: Sequence[str] = (), least_tier: str | None = None) -> Graph:
    """Triples by predicate and tier, and their ends; with types, all nodes of these, and triples between such alone."""
    triples = graph.filtered(g.triples, predicates, least_tier)
    if types:
        nodes = g.nodes.where(F.col("type").isin(*types))
        return Graph(nodes, graph.of_types(g.nodes, triples, types))
    ends = triples.select(F.explode(F.array("s", "o")).alias("id"))
    return Graph(g.nodes.join(ends, "id", "left_semi"), triples)


def path_triples(g: Graph, path: Sequence[tuple[str, str | None]]) -> DataFrame:
    """(step, id, s, p, o): the triple of each step, in the path's direction where there is one, else the other."""
    steps = [(i, a, p, path[i + 1][0]) for i, (a, p) in enumerate(path[:-1])]
    wanted = g.triples.sparkSession.createDataFrame(steps, "step int, a string, p string, b string")
    both = wanted.select("step", F.inline(F.array(F.struct(F.lit(0).alias("back"), F.col("a").alias("s"), "p", F.col("b").alias("o")), F.struct(F.lit(1).alias("back"), F.col("b").alias("s"), "p", F.col("a").alias("o")))))
    found = g.triples.select("id", "s", "p", "o").join(F.broadcast(both), ["s", "p", "o"])  # at most twice MOST_HOPS rows
    return found.groupBy("step").agg(F.min(F.struct("back", "id", "s", "p", "o")).alias("t")).select("step", "t.id", "t.s", "t.p", "t.o")


def relevance(triples: DataFrame, distances: DataFrame) -> DataFrame:
    """triples with `score`: the tier's rank times 100, up to 12 for being near a seed, 4 unless the predicate is `mentions`, 2 for each of up to 5 places, less 150 where superseded."""
    lines = F.size(F.array_distinct(F.transform("provenance", lambda x: F.struct(x["source_path"], x["start_line"]))))
    own = F.col("r") * 100 + F.when(F.col("p") == "mentions", 0).otherwise(4) + F.least(lines, F.lit(5)) * 2 - F.when(F.size("superseded_by") > 0, 150).otherwise(0)
    t, near = triples.withColumn("__own", own), graph.few(distances.select("id", "depth"))  # so places aren't shuffled unless they are asked for
    for e in "so":
        t = t.join(near.select(F.col("id").alias(e), F.col("depth").alias(f"__{e}")), e, "left")
    d = F.least(F.coalesce("__s", F.lit(FAR)), F.coalesce("__o", F.lit(FAR)))
    score = F.col("__own") + F.greatest(F.lit(0), 12 - 4 * F.least(d, F.lit(3)))
    return t.withColumn("score", score.cast("int")).select(*[c for c in triples.columns if c != "score"], "score")


def _json_node() -> Column:
    return F.to_json(F.struct("id", "type", "label", "description", "aliases"))


def _json_triple() -> Column:
    span = lambda x: F.when(x["start_line"].isNotNull(), F.struct(x["start_line"].alias("start_line"), x["end_line"].alias("end_line")))
    entry = lambda x: F.struct(x["source_path"].alias("source_path"), x["extractor"].alias("extractor"), x["content_hash"].alias("content_hash"), x["confidence"].alias("confidence"), span(x).alias("span"), x["first_seen"].alias("first_seen"), x["last_seen"].alias("last_seen"))
    links = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    return F.to_json(F.struct("id", "s", "p", "o", "confidence", F.transform("provenance", entry).alias("provenance"), links("supersedes"), links("superseded_by")))


def budgeted(g: Graph, budget: int | None, seeds: DataFrame, score: Column | None = None) -> tuple[Graph, DataFrame]:
    """The graph whose compact JSON is within budget tokens (four UTF-16 units each), and the triples left out, those of the least score first, then of the first id. Nodes left are seeds and ends. No budget leaves all."""
    score = F.col("r") if score is None else score
    if not budget or budget <= 0:
        return g, g.triples.limit(0)
    scored = g.triples.withColumn("__score", score).withColumn("__head", F.substring("id", 1, HEAD))
    size = text.utf16(_json_triple()) + 1
    # of all, and one sign less than commas for the last of either list
    n = g.nodes.agg(F.coalesce(F.sum(text.utf16(_json_node()) + 1), F.lit(0)).alias("s"), F.count("*").alias("n")).first()
    # triples of one score and beginning of the id follow one another: they are summed up first, and the order inside is asked for where the budget ends alone
    runs = written(scored.groupBy("__score", "__head").agg(F.sum(size).alias("__size"), F.count("*").alias("__n")))
    t = runs.agg(F.coalesce(F.sum("__size"), F.lit(0)).alias("s"), F.coalesce(F.sum("__n"), F.lit(0)).alias("n")).first()
    over = len('{"nodes":[],"triples":[]}') + n.s - (n.n > 0) + t.s - (t.n > 0) - 4 * budget
    same, later = lambda c, v: F.col(c).eqNullSafe(F.lit(v)), lambda c, v: F.col(c).isNotNull() if v is None else F.coalesce(F.col(c) > F.lit(v), F.lit(False))
    at = sums_before(runs, ["__score", "__head"], "__size", "__gone").where((F.col("__gone") < over) & (F.col("__gone") + F.col("__size") >= over)).first() if over > 0 else None
    if at is None:
        fits = F.lit(over <= 0)
    else:
        inside = scored.where(same("__score", at["__score"]) & same("__head", at["__head"])).select("id", size.alias("__size"))
        first = sums_before(inside, ["id"], "__size", "__gone").where(F.col("__gone") + at["__gone"] >= over).agg(F.min("id")).first()[0]
        left = F.lit(False) if first is None else same("__head", at["__head"]) & (F.col("id") >= first)
        fits = later("__score", at["__score"]) | (same("__score", at["__score"]) & (later("__head", at["__head"]) | left))
    kept, out = scored.where(fits), scored.where(~fits)
    columns = g.triples.columns
    ends = kept.select(F.explode(F.array("s", "o")).alias("id")).union(seeds.select("id"))
    return Graph(g.nodes.join(ends, "id", "left_semi"), kept.select(*columns, F.col("__score"))), out.select("id", "confidence", "__score")


@dataclass
class Query:
    """One of path (from, to), id, filter or term, asked in that order."""

    term: str | None = None
    id: str | None = None
    path: tuple[str, str] | None = None
    types: tuple[str, ...] = ()
    predicates: tuple[str, ...] = ()
    least_tier: str | None = None
    hops: float | None = None
    most_depth: float | None = None
    budget: int | None = None


@dataclass
class Result:
    graph: Graph
    seeds: list[str]
    paths: list[list[tuple[str, str | None]]] = field(default_factory=list)
    left_out: DataFrame | None = None


def query(g: Graph, q: Query) -> Result:
    """A path's triples; what is within hops (1 by default) of an id; a filter; or what is within hops (2 by default) of a term's nodes. Then the budget, by tier."""
    paths: list[list[tuple[str, str | None]]] = []
    if q.path is not None:
        path = graph.shortest_path(g.triples, *q.path, graph.hops(q.most_depth, 6))
        paths = [path] if path else []
        seeds = [n for n, _ in path]
        steps = path_triples(g, path) if len(path) > 1 else None
        found = Graph(g.nodes.join(_ids(g.nodes, seeds), "id", "left_semi"), g.triples.join(steps.select("id"), "id", "left_semi") if steps is not None else g.triples.limit(0))
    elif q.id is not None:
        seeds = [q.id]
        found = expanded(g, _ids(g.nodes, seeds), graph.hops(q.hops, 1))
    elif q.term is None and (q.types or q.predicates or q.least_tier):
        seeds, found = [], filtered(g, q.types, q.predicates, q.least_tier)
    elif q.term is not None:
        hit = written(matched(g.nodes, q.term).select("id"))
        seeds, found = [r.id for r in hit.orderBy("id").collect()], expanded(g, hit, graph.hops(q.hops, HOPS))
    else:
        raise GraphError("schema_invalid", "a query needs a path, an id, a filter or a term")
    kept, out = budgeted(found, q.budget, _ids(g.nodes, seeds))
    return Result(kept, sorted(set(seeds)), paths, out)


@dataclass
class Pack:
    """What a question leads to, collected: nodes and triples as rows, paths, citations, and what the budget left out."""

    question: str
    seeds: list[str]
    nodes: list = field(default_factory=list)
    triples: list = field(default_factory=list)
    paths: list[list[tuple[str, str | None]]] = field(default_factory=list)
    citations: list[dict] = field(default_factory=list)
    trimmed: str | None = None
    budget: int | None = None
    suggestions: list[tuple[str, str]] = field(default_factory=list)


def citation(t) -> dict:
    """All places of a triple in the order they were seen, and how many there are."""
    sources, seen = [], set()
    for e in t.provenance or []:
        key = (e.source_path, e.start_line, e.end_line)
        if e.source_path and key not in seen:
            seen.add(key)
            sources.append({k: v for k, v in (("source_path", e.source_path), ("extractor", e.extractor), ("start_line", e.start_line), ("end_line", e.end_line)) if v is not None})
    return {"triple_id": t.id, "s": t.s, "p": t.p, "o": t.o, "confidence": t.confidence, "source_count": len(sources), "superseded": bool(t.superseded_by), "sources": sources}


def pack(g: Graph, question: str, hops: int = HOPS, k: int = SEEDS, budget: int | None = None, extra_seeds: Sequence[str] = ()) -> Pack:
    """Seeds by score, else extra ones that are known; all within hops of them, and shortest paths between the first three; trimmed to the budget by relevance; with citations."""
    words = plain.tokens(question)
    seeds = scored_seeds(g.nodes, words, k)
    if not seeds and extra_seeds:
        known = {r.id for r in g.nodes.join(_ids(g.nodes, extra_seeds), "id", "left_semi").select("id").collect()}
        seeds = [s for s in extra_seeds if s in known][:k]
    empty = Pack(question, seeds, budget=budget)
    if not seeds:
        return replace(empty, suggestions=[(r.id, r.label) for r in suggestions(g.nodes, words).collect()])
    start = _ids(g.nodes, seeds)
    # an end of a triple near seeds is within hops of one, and any node of a path between seeds within half of it
    reached = written(graph.distances(g.triples, start, max(graph.hops(hops), (graph.hops(hops) + 2) // 2)))
    near = graph.incident(g.triples, reached.where(F.col("depth") < graph.hops(hops))) if graph.hops(hops) else g.triples.limit(0)
    inside, paths = reached.where(F.col("depth") <= graph.hops(hops)).select("id"), []
    for i, a in enumerate(seeds[:3]):
        for b in seeds[i + 1 : 3]:
            if path := graph.shortest_path(g.triples, a, b, graph.hops(hops) + 2):
                paths.append(path)
                inside = inside.union(_ids(g.nodes, [n for n, _ in path]))
                if len(path) > 1:
                    near = near.union(g.triples.join(path_triples(g, path).select("id"), "id", "left_semi").select(*near.columns))
    whole = Graph(g.nodes.join(inside.distinct(), "id", "left_semi"), relevance(near.dropDuplicates(["id"]), reached))
    kept, out = budgeted(whole, budget, start, F.col("score"))
    order = ["__score", "id"] if budget and budget > 0 else ["id"]
    triples = kept.triples.orderBy(*order).collect()
    gone = out.orderBy("__score", "id").collect() if budget and budget > 0 else []
    trimmed = "dropped " + ", ".join(f"{r.id} ({r.confidence})" for r in gone) if gone else None
    if not triples:
        return replace(empty, trimmed=trimmed)
    nodes = kept.nodes.orderBy(F.expr("id collate unicode")).collect()
    return replace(empty, nodes=nodes, triples=triples, paths=paths, citations=[citation(t) for t in triples], trimmed=trimmed)


@dataclass
class Answer:
    pack: Pack
    markdown: str
    mode: str  # deterministic, global, abstain, prompt_pending or http
    reason: str | None = None
    suggestions: list[str] = field(default_factory=list)

    @property
    def abstained(self) -> bool:
        return self.mode == "abstain"


def _place(sources: Sequence[dict]) -> str:
    first = sources[0]
    line = f":{first['start_line']}" if "start_line" in first else ""
    return f" ({first['source_path']}{line}{f' +{len(sources) - 1} more' if len(sources) > 1 else ''})"


def _cited(c: dict) -> str:
    count = f" ×{c['source_count']}" if c["source_count"] > 1 else ""
    old = " · superseded" if c["superseded"] else ""
    return f"- `{c['triple_id']}`: {c['s']} —{c['p']}→ {c['o']} [{c['confidence']}{count}{old}]{_place(c['sources']) if c['sources'] else ''}"


def rendered(p: Pack) -> str:
    label = {n.id: n.label for n in p.nodes}
    walk = lambda path: "- " + "".join(f"{n} -{q}→ " if q else n for n, q in path)
    parts = {
        "Seeds": [f"- {s} ({label[s]})" if label.get(s) else f"- {s}" for s in p.seeds],
        "Relationships": [f"- {t.s} —{t.p}→ {t.o} (`{t.id}`)" for t in p.triples],
        "Paths": [walk(path) for path in p.paths],
        "Citations": [_cited(c) for c in p.citations],
    }
    return "\n".join(line for title, lines in parts.items() for line in (f"## {title}", *(lines or ["- (none)"]), ""))


_ASPECT, _PLACE = "areas|concepts|themes|topics", "codebase|project|repo|repository"
OVERVIEW = re.compile(rf"overview|overall|high[- ]?level|architecture|structure|themes|main\s+(?:{_ASPECT}|components|parts)|key\s+(?:{_ASPECT})|(?:what\s+(?:is|are)\s+(?:the|this)|about\s+this)\s+(?:{_PLACE})", re.IGNORECASE)


def theme_citations(g: Graph, found: DataFrame, each: int = THEME_CITATIONS) -> DataFrame:
    """(community, nth, and a triple's columns): of triples inside each community those with the most places, of equal ones of the first id."""
    inside = found.select(F.col("id").alias("community"), F.explode("members").alias("m"))
    a, b = inside.select("community", F.col("m").alias("s")), inside.select(F.col("community").alias("__c"), F.col("m").alias("o"))
    lines = F.size(F.array_distinct(F.transform(F.filter("provenance", lambda x: F.coalesce(x["source_path"], F.lit("")) != ""), lambda x: F.struct(x["source_path"], x["start_line"]))))
    t = g.triples.join(a, "s").join(b, "o").where("community = __c").withColumn("__n", lines)
    return t.withColumn("nth", F.expr("row_number() over (partition by community order by __n desc, id)")).where(F.col("nth") <= each).drop("__c", "__n")


def global_answer(g: Graph, empty: Pack) -> Answer | None:
    """The largest communities as themes; None where there are none."""
    all_found = written(themes.communities(g.nodes, g.triples))
    found = all_found.orderBy(F.desc("size"), "id").limit(TOP_THEMES)
    top = found.collect()
    if not top:
        return None
    cited: dict[str, list] = {}
    for r in theme_citations(g, found).orderBy("community", "nth").collect():
        cited.setdefault(r.community, []).append(r)
    rows = [r for c in top for r in cited.get(c.id, [])]
    ends = {e for r in rows for e in (r.s, r.o)}
    nodes = g.nodes.join(_ids(g.nodes, sorted(ends)), "id", "left_semi").collect() if ends else []
    label = {n.id: n.label or n.id for n in nodes}
    lines = ["## Themes", ""]
    for c in top:
        lines.append(f"### {c.label} ({c.size} nodes)")
        if names := ", ".join(n.label or n.id for n in c.top_nodes[:5]):
            lines.append(f"- Key nodes: {names}")
        if kinds := ", ".join(f"{x.p} ({x['count']})" for x in c.top_predicates[:3]):
            lines.append(f"- Main relationships: {kinds}")
        lines += [f"- e.g. {label.get(r.s, r.s)} —{r.p}→ {label.get(r.o, r.o)} (`{r.id}`)" for r in cited.get(c.id, [])]
        lines.append("")
    citations = [citation(r) for r in rows]
    short = lambda c: f"- `{c['triple_id']}`: {c['s']} —{c['p']}→ {c['o']} [{c['confidence']}]{_place(c['sources'][:1]) if c['sources'] else ''}"
    lines += ["## Citations", *map(short, citations), ""]
    return Answer(replace(empty, nodes=nodes, triples=rows, paths=[], citations=citations), "\n".join(lines), "global")


def answer(g: Graph, question: str, overview: bool = False, apply: Callable[[Pack], str] | None = None, **options) -> Answer:
    """Markdown with citations, or the reason for none. overview, or a question that sounds like it and leads nowhere, asks for themes. apply: what turns a pack into markdown elsewhere, its citations checked against the pack."""
    p = pack(g, question, **options)
    if overview or not p.triples:
        if (overview or OVERVIEW.search(question)) and (found := global_answer(g, p)) is not None:
            return found
        if not p.triples:
            reason = "no_seeds_matched" if not p.seeds else "seeds_disconnected" if p.trimmed is None else "empty_subgraph"
            return Answer(p, "", "abstain", reason, [f"{label} ({i})" for i, label in p.suggestions])
    if apply is not None:
        return Answer(p, apply(p), "prompt_pending")
    return Answer(p, rendered(p), "deterministic")


SeedScorer = Callable[[DataFrame, str, int], DataFrame]
_scorer: SeedScorer | None = None


def set_seed_scorer(scorer: SeedScorer | None) -> None:
    """scorer(nodes, question, k) gives (id, score), for questions whose tokens match nothing."""
    global _scorer
    _scorer = scorer


def answer_semantic(g: Graph, question: str, scorer: SeedScorer | None = None, **options) -> Answer:
    """answer(), and where no seed matched again with the scorer's. A scorer's failure leaves the first answer."""
    first, scorer = answer(g, question, **options), scorer or _scorer
    if first.reason != "no_seeds_matched" or scorer is None:
        return first
    try:
        ids = [r.id for r in scorer(g.nodes, question, options.get("k", SEEDS)).orderBy(F.desc("score"), "id").collect()]
    except Exception:  # a scorer is foreign code, and its help optional
        return first
    return answer(g, question, extra_seeds=ids, **options) if ids else first


def checked_citations(p: Pack, ids: Sequence[str]) -> None:
    """An error unless all ids are triples of the pack."""
    strange = sorted(set(ids) - {t.id for t in p.triples})
    if strange:
        raise GraphError("prompt_result_invalid", f"citations that aren't in the pack: {', '.join(strange)}", ids=strange)


@dataclass
class Why:
    from_id: str | None
    to_id: str | None
    path: list[tuple[str, str | None]] | None
    reason: str | None = None
    sentences: list[str] = field(default_factory=list)
    citations: list[dict] = field(default_factory=list)
    alternatives: list[list[tuple[str, str | None]]] = field(default_factory=list)
    markdown: str = ""


def alternative_paths(g: Graph, path: Sequence[tuple[str, str | None]], k: int, most: int = 6) -> list[list[tuple[str, str | None]]]:
    """Up to k - 1 other routes: shortest paths without each step of this one in turn, the shortest first."""
    seen, out = {tuple(n for n, _ in path)}, []
    for (a, p), (b, _) in zip(path, path[1:]):
        step = (F.col("p") == p) & (((F.col("s") == a) & (F.col("o") == b)) | ((F.col("s") == b) & (F.col("o") == a)))
        other = graph.shortest_path(g.triples.where(~step), path[0][0], path[-1][0], most)
        key = tuple(n for n, _ in other)
        if len(other) > 1 and key not in seen:
            seen.add(key)
            out.append(other)
    return sorted(out, key=lambda x: (len(x), "\0".join(n for n, _ in x)))[: max(0, k - 1)]


def why(g: Graph, from_term: str, to_term: str, most: int = 6, k: int = 1) -> Why:
    """How two nodes are linked, a sentence for each step in the direction that is stored, with citations and other routes."""
    a, b = resolved(g.nodes, from_term), resolved(g.nodes, to_term)
    if a is None or b is None:
        return Why(a, b, None, "no node matches: " + ", ".join(t for t, i in ((from_term, a), (to_term, b)) if i is None))
    path = graph.shortest_path(g.triples, a, b, most)
    if len(path) < 2:
        return Why(a, b, None, "both terms resolve to the same node" if a == b else "no path connects these nodes")
    others = alternative_paths(g, path, k, most) if k > 1 else []
    ids = {n for way in [path, *others] for n, _ in way}
    labels = {r.id: r.label for r in g.nodes.join(_ids(g.nodes, sorted(ids)), "id", "left_semi").select("id", "label").collect()}
    name = lambda i: labels.get(i) or i
    steps = path_triples(g, path).select("step", "id").join(g.triples, "id").orderBy("step").collect()
    by_step = {t.step: t for t in steps}
    sentences, citations = [], []
    for i, ((x, p), (y, _)) in enumerate(zip(path, path[1:])):
        t = by_step.get(i)
        s, o = (t.s, t.o) if t else (x, y)
        sentences.append(f"**{name(s)}** {plain.prose(p)} **{name(o)}**" + (f" (`{t.id}`)" if t else ""))
        if t:
            citations.append(citation(t))
    n, chain = len(path) - 1, lambda way: " → ".join(name(i) for i, _ in way)
    plural = lambda m: f"{m} hop{'' if m == 1 else 's'}"
    routes = ["", "## Alternative routes", *(f"- {chain(w)} ({plural(len(w) - 1)})" for w in others)] if others else []
    cites = [f"- `{c['triple_id']}`: {c['s']} —{c['p']}→ {c['o']} [{c['confidence']}]{_place(c['sources']) if c['sources'] else ' (no source)'}" for c in citations]
    lines = [f"**{name(a)}** connects to **{name(b)}** in {plural(n)}: {chain(path)}", "", *(f"- {s}" for s in sentences), *routes, "", "## Citations", *(cites or ["- (none)"]), ""]
    return Why(a, b, path, None, sentences, citations, others, "\n".join(lines))


def pack_json(p: Pack) -> str:
    """A pack as JSON, for prompts."""
    return json.dumps({"question": p.question, "seeds": p.seeds, "nodes": [n.asDict(True) for n in p.nodes], "triples": [t.asDict(True) for t in p.triples], "paths": p.paths, "citations": p.citations, "trimmed": p.trimmed, "budget_tokens": p.budget}, ensure_ascii=False, default=str)
