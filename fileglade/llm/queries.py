"""Registered queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fileglade.llm import (
    fingerprints, lines, lmscore, neardup, negatives, packing, pieces, quality, repair, suffixes, toxicity, urlrules, variants,
)
from fileglade.llm.common import materialised, table
from fileglade.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def op1_sentencepiece(spark, tables):
    return pieces.encoded(table(spark, tables, "documents"), digests=True)


def op2_toxicity(spark, tables):
    docs = table(spark, tables, "documents")
    return toxicity.severities(docs, toxicity.train(docs, table(spark, tables, "labels")))


def op3_lm_score(spark, tables):
    return lmscore.scored(table(spark, tables, "documents"))


def op4_repair(spark, tables):
    return repair.round_trip(table(spark, tables, "documents")).drop("ids")


def op5_order_minhash(spark, tables):
    return fingerprints.edited_pairs(table(spark, tables, "documents"))


def op6_line_dedup(spark, tables):
    cut = lines.without_boilerplate(table(spark, tables, "documents"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return cut.select("doc_id", "n_lines", "n_dropped", kept)


def op7_quality_rules(spark, tables):
    docs = table(spark, tables, "documents").select("doc_id", "text", "lang", "source")
    measured = materialised(quality.measure(docs).drop("text"), spark)
    names = ["doc_id", *quality.MEASURES, "base_failed", "kept"]
    return quality.verdicts(measured).select(*names)


def op8_prob_minhash(spark, tables):
    return neardup.classes(table(spark, tables, "documents"))


def op9_packing(spark, tables):
    return packing.packed(table(spark, tables, "documents"), keep_ids=False)


def op10_suffix_dedup(spark, tables):
    return suffixes.deduplicated(table(spark, tables, "documents"), keep_bytes=False)


def op11_hard_negatives(spark, tables):
    return negatives.mined(table(spark, tables, "embeddings"), copies=True)


def op12_spelling_variants(spark, tables):
    return variants.grouped(table(spark, tables, "documents"))


def op13_url_filters(spark, tables):
    return urlrules.judged(table(spark, tables, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_toxicity, op3_lm_score, op4_repair, op5_order_minhash, op6_line_dedup, op7_quality_rules,
        op8_prob_minhash, op9_packing, op10_suffix_dedup, op11_hard_negatives,
        op12_spelling_variants, op13_url_filters,
    )
}
