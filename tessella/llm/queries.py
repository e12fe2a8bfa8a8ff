"""Queries of the llm operators: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from . import binpack, bpe, leakage, overlap, pairs, residue


def p1_found(spark, root):
    links = overlap.cross_split_pairs(table(spark, root, "seed_demos"))
    return links.select(F.least("train_id", "held_id").alias("row_id_a"), F.greatest("train_id", "held_id").alias("row_id_b"))


def p1_per_split_source(spark, root):
    return overlap.overlap_report(table(spark, root, "seed_demos"))


def p1_routes(spark, root):
    """How many pairs are equal texts and how many come through the similarity codes."""
    return overlap.route_report(table(spark, root, "seed_demos"))


def p2_found(spark, root):
    return pairs.broken_pairs(table(spark, root, "seed_demos"), table(spark, root, "training_example"))


def p2_routes(spark, root):
    """Defective pairs by defect and by what found them."""
    return pairs.routed_pairs(table(spark, root, "seed_demos"), table(spark, root, "training_example")).groupBy("defect", "route").agg(F.count("*").alias("pairs"))


def p3_packed(spark, root):
    return binpack.packed(table(spark, root, "training_example"), table(spark, root, "mixture_config"))


def p3_fill(spark, root):
    return binpack.fill_report(table(spark, root, "training_example"), table(spark, root, "mixture_config"))


def p5_ids(spark, root):
    return bpe.encode_corpus(table(spark, root, "documents"))


def p6_found(spark, root):
    return leakage.find_leaks(table(spark, root, "documents"), table(spark, root, "vqa_item")).select("doc_id", "item_id")


def p6_removal_spans(spark, root):
    return leakage.removal_spans(leakage.find_leaks(table(spark, root, "documents"), table(spark, root, "vqa_item")))


def p7_found(spark, root):
    return residue.residue_documents(table(spark, root, "documents")).select("doc_id")


def p7_passages(spark, root):
    """Distinct passages taken for residue, with their score."""
    return residue.passage_scores(table(spark, root, "documents"))[1]


def queries():
    return {f.__name__: f for f in (p1_found, p1_per_split_source, p1_routes, p2_found, p2_routes, p3_packed, p3_fill, p5_ids, p6_found, p6_removal_spans, p7_found, p7_passages)}


def oracle_sql():
    """These operators can't be said in SQL over whole tables; tests hold them against brute force and round trips."""
    return {}
