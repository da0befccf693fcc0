"""Evaluation of answers against cases: seeds found, text contained, abstentions, citations, and paths that should exist."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlegraph.errors import GraphError
from spindlegraph.plans import retrieval
from spindlegraph.plans.retrieval import Graph


@dataclass
class CaseResult:
    id: str
    failures: list[str] = field(default_factory=list)
    seed_recall: float | None = None
    citation_valid: bool | None = None

    @property
    def ok(self) -> bool:
        return not self.failures


def load_cases(path: str) -> list[dict]:
    try:
        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
    except (OSError, ValueError) as why:
        raise GraphError("schema_invalid", f"no cases in {path}: {why}", path=path) from why
    if not isinstance(doc, dict) or doc.get("schema_version") != 1 or not isinstance(doc.get("cases"), list):
        raise GraphError("schema_invalid", "a case file has schema_version 1 and a list of cases", path=path)
    return doc["cases"]


def run_case(g: Graph, case: dict) -> CaseResult:
    out = CaseResult(case["id"])
    fail = out.failures.append
    if "question" in case:
        a = retrieval.answer(g, case["question"])
        reason = case.get("expect_abstain_reason")
        if case.get("expect_abstain") or reason is not None:
            if not a.abstained:
                fail("it should abstain")
            if reason is not None and a.reason != reason:
                fail(f"abstains for {a.reason}, not {reason}")
        elif a.abstained:
            fail(f"it abstains: {a.reason}")
        if case.get("expect_mode", a.mode) != a.mode:
            fail(f"mode {a.mode}")
        if wanted := case.get("expect_seeds"):
            missing = [s for s in wanted if s not in a.pack.seeds]
            out.seed_recall = 1 - len(missing) / len(wanted)
            if missing:
                fail(f"seeds not found: {', '.join(missing)}")
        for part in case.get("expect_answer_contains", ()):
            if part not in a.markdown:
                fail(f"not in the answer: {part}")
        known, cited = {t.id for t in a.pack.triples}, {c["triple_id"] for c in a.pack.citations}
        out.citation_valid = cited <= known
        if not out.citation_valid:
            fail("cites what isn't in the pack")
        for id_ in case.get("expect_citations", ()):
            if id_ not in cited:
                fail(f"not cited: {id_}")
    if "why" in case:
        found = retrieval.why(g, case["why"]["from"], case["why"]["to"]).path is not None
        if found != case["why"]["expect_found"]:
            fail(f"path found: {found}")
    if not {"question", "why"} & set(case):
        fail("neither question nor why")
    return out


def run(g: Graph, cases: Sequence[dict]) -> dict:
    results = [run_case(g, c) for c in cases]
    recalls = [r.seed_recall for r in results if r.seed_recall is not None]
    return {"total": len(results), "passed": sum(r.ok for r in results), "failed": sum(not r.ok for r in results), "seed_recall_avg": sum(recalls) / len(recalls) if recalls else None, "citations_all_valid": all(r.citation_valid is not False for r in results), "cases": results}


def metrics(results: DataFrame) -> DataFrame:
    """The same sums over a table (id, ok, seed_recall, citation_valid)."""
    return results.agg(F.count("*").alias("total"), F.count(F.when(F.col("ok"), 1)).alias("passed"), F.count(F.when(~F.col("ok"), 1)).alias("failed"), F.avg("seed_recall").alias("seed_recall_avg"), F.coalesce(F.min(F.coalesce(F.col("citation_valid"), F.lit(True))), F.lit(True)).alias("citations_all_valid"))


def as_table(spark: SparkSession, results: Sequence[CaseResult]) -> DataFrame:
    return spark.createDataFrame([(r.id, r.ok, r.seed_recall, r.citation_valid) for r in results], "id string, ok boolean, seed_recall double, citation_valid boolean")
