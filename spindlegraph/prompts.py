"""What a language model elsewhere proposes, let in through gates: sources sent out redacted, candidates never above INFERRED, answers citing the pack alone.

The model is a function of the caller's; nothing here opens a connection.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlegraph.errors import GraphError
from spindlegraph.functions import text
from spindlegraph.plans.retrieval import Pack, checked_citations, pack_json
from spindlegraph.store import Store

MOST_SOURCES, MOST_SOURCE_BYTES = 50, 64 << 10
TEMPLATES = {
    "extract": "Give nodes and triples that these sources state, as JSON with nodes and triples; cite source_path for each triple.\n{sources}",
    "normalize": "Say which of these nodes are one, as JSON with a list of keep and drop.\n{nodes}",
    "answer": "Answer from this pack alone, as JSON with answer_markdown and citations, a list of triple ids.\n{pack}",
    "maintain": "Say which of these triples no longer hold, as JSON with a list of ids.\n{triples}",
}
STAGES = tuple(TEMPLATES)


def template(name: str, store: Store | None = None) -> tuple[str, str]:
    """A stage's template and its version; a file prompts/<name>.md of the store goes before the built-in one."""
    if name not in TEMPLATES:
        raise GraphError("prompt_result_invalid", f"no such stage: {name}", stage=name)
    own = store.path(f"prompts/{name}.md") if store is not None else None
    body = TEMPLATES[name]
    if own and os.path.exists(own):
        with open(own, encoding="utf-8") as f:
            body = f.read()
    return body, "sha256:" + hashlib.sha256(body.encode()).hexdigest()[:12]


def sources(files: DataFrame, most: int = MOST_SOURCES, most_bytes: int = MOST_SOURCE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(path, content_hash, text) of the first files by path that are small enough, redacted, and (path, reason) of the others. files: (path, content)."""
    fits = F.octet_length("content") <= most_bytes
    chosen = files.where(fits).orderBy("path").limit(most)
    kept = chosen.select("path", text.content_hash(F.col("content")).alias("content_hash"), text.redacted(F.decode("content", F.lit("UTF-8"))).alias("text"))
    late = files.where(fits).join(chosen.select("path"), "path", "left_anti").select("path", F.lit("too many").alias("reason"))
    return kept, files.where(~fits).select("path", F.lit("too large").alias("reason")).unionByName(late)


def sanitised(evidence: DataFrame, known: DataFrame, version: str, model: str) -> tuple[DataFrame, DataFrame]:
    """Proposed evidence (s, p, o, source_path, content_hash) as candidates of tier INFERRED, and what is refused with the reason: no ends or predicate, a source that wasn't sent, or one that has changed since. known: (path, content_hash)."""
    sent = known.select(F.col("path").alias("source_path"), F.col("content_hash").alias("__now"))
    said = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    reason = F.when(~(said("s") & said("p") & said("o")), "incomplete").when(~F.coalesce("p", F.lit("")).rlike("^[a-z][a-z0-9_]*$"), "no predicate's name").when(F.col("__now").isNull(), "unknown source").when(F.col("content_hash") != F.col("__now"), "the source has changed")
    judged = evidence.join(sent, "source_path", "left").withColumn("reason", reason)
    kept = judged.where("reason is null").select(*(F.trim(text.redacted(F.col(c))).alias(c) for c in "so"), "p", "source_path", F.lit(f"llm/{model}").alias("extractor"), "content_hash", F.lit("INFERRED").alias("confidence"), F.lit(version).alias("prompt_version"))
    return kept, judged.where("reason is not null").select("s", "p", "o", "source_path", "reason")


def parsed(reply: str) -> dict:
    """A reply's JSON object, within one code fence or none."""
    body = re.sub(r"^\s*```[a-z]*\s*\n(.*?)\n?\s*```\s*$", r"\1", reply, flags=re.DOTALL)
    try:
        out = json.loads(body)
    except ValueError as why:
        raise GraphError("prompt_result_invalid", f"not JSON: {why}") from why
    if not isinstance(out, dict):
        raise GraphError("prompt_result_invalid", "not a JSON object")
    return out


def answer_with(ask: Callable[[str], str], store: Store | None = None) -> Callable[[Pack], str]:
    """What retrieval.answer(apply=...) takes: the pack is sent, and the reply's citations must be in it."""

    def apply(pack: Pack) -> str:
        reply = parsed(ask(template("answer", store)[0].replace("{pack}", pack_json(pack))))
        if not isinstance(reply.get("answer_markdown"), str) or not reply["answer_markdown"] or not isinstance(reply.get("citations"), list):
            raise GraphError("prompt_result_invalid", "an answer has answer_markdown and citations")
        checked_citations(pack, reply["citations"])
        return reply["answer_markdown"]

    return apply
