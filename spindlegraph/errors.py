"""Errors that callers can tell apart by their reason."""

from __future__ import annotations

REASONS = frozenset("ok store_not_found build_locked build_failed schema_invalid ontology_invalid corpus_not_found path_escape limit_exceeded no_baseline update_failed prompt_result_invalid no_seeds_matched seeds_disconnected empty_subgraph".split())


class GraphError(Exception):
    def __init__(self, reason: str, message: str, **details):
        if reason not in REASONS:
            raise ValueError(f"no such reason: {reason}")
        super().__init__(message)
        self.reason, self.details = reason, details
