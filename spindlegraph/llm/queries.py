"""The training-data queries with the parameters they have in production, each over its whole table, and SQL where there is an equivalent."""

from __future__ import annotations

from spindlegraph.llm import ann, hilbert, jaccard_join, license_scan, mixing, packing, quality, substring_dedup, toxicity, url_filter
from spindlegraph.llm.shared import table


def op1_mix_sources(spark, sf_dir):
    return mixing.copies(table(spark, sf_dir, "documents"))


def op2_url_filter(spark, sf_dir):
    return url_filter.filtered(table(spark, sf_dir, "pages"))


def op3_license_scan(spark, sf_dir):
    return license_scan.licenses(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    return quality.passing(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark, sf_dir):
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op7_hilbert_shards(spark, sf_dir):
    return hilbert.shards(table(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark, sf_dir):
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_url_filter, op3_license_scan, op4_ngram_jaccard_join, op5_quality_rules, op6_nearest_neighbours, op7_hilbert_shards, op8_packing, op9_substring_dedup, op10_toxicity)}
SQL = {"op2_url_filter": url_filter.VERDICTS_SQL, "op4_ngram_jaccard_join": jaccard_join.CLASSES_SQL, "op5_quality_rules": quality.PASSING_SQL, "op7_hilbert_shards": hilbert.SHARDS_SQL, "op9_substring_dedup": substring_dedup.PASSAGES_SQL}
