"""A handle on a stored graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from spindlegraph import build, evaluate, export, review
from spindlegraph import store as stores
from spindlegraph.operators import centrality, communities
from spindlegraph.plans import retrieval


class KnowledgeGraph:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, stores.Store(spark, root)

    @property
    def graph(self) -> retrieval.Graph:
        return self.store.load().graph

    # --- reading

    def status(self) -> dict:
        return stores.status(self.store)

    def query(self, **options) -> retrieval.Result:
        return retrieval.query(self.graph, retrieval.Query(**options))

    def pack(self, question: str, **options) -> retrieval.Pack:
        return retrieval.pack(self.graph, question, **options)

    def ask(self, question: str, semantic: bool = False, **options) -> retrieval.Answer:
        return (retrieval.answer_semantic if semantic else retrieval.answer)(self.graph, question, **options)

    def why(self, from_term: str, to_term: str, **options) -> retrieval.Why:
        return retrieval.why(self.graph, from_term, to_term, **options)

    def resolve(self, term: str, k: int = 5) -> tuple[str | None, list[tuple[str, str]]]:
        """The node of a term, or what else may be meant."""
        nodes = self.graph.nodes
        found = retrieval.resolved(nodes, term)
        return found, [] if found else [(r.id, r.label) for r in retrieval.suggestions(nodes, retrieval.plain.tokens(term), k).collect()]

    def top(self, k: int = 20, metric: str = "pagerank") -> DataFrame:
        return centrality.top_nodes(self.graph.nodes, self.graph.triples, k, metric)

    def communities(self, **options) -> DataFrame:
        return communities.communities(self.graph.nodes, self.graph.triples, **options)

    def diff(self, snapshot: str | None = None) -> dict:
        return stores.diff(self.store, snapshot)

    def evaluate(self, cases: Sequence[dict]) -> dict:
        return evaluate.run(self.graph, cases)

    def export(self, form: str, **options) -> dict:
        return export.export(self.store, form, **options)

    def report(self, most: int = 10) -> str:
        return export.report(self.store, most)

    # --- writing

    def build(self, corpus: str | Sequence[str], **options) -> dict:
        return build.build(self.spark, self.store.root, corpus, **options)

    def maintain(self, corpus: str | Sequence[str], **options) -> dict:
        return build.maintain(self.spark, self.store.root, corpus, **options)

    def assert_fact(self, s: str, p: str, o: str, **options) -> dict:
        return build.assert_fact(self.spark, self.store.root, s, p, o, **options)

    def retract(self, triple_id: str, **options) -> dict:
        return build.retract_fact(self.spark, self.store.root, triple_id, **options)

    def supersede(self, winner: str, loser: str, **options) -> dict:
        return build.supersede(self.spark, self.store.root, winner, loser, **options)

    def review(self, kind: str | None = None, limit: int | None = None) -> list[dict]:
        return review.listed(self.store, kind, limit)

    def resolve_review(self, action: str, **options) -> dict:
        return review.resolve(self.spark, self.store.root, action, **options)
