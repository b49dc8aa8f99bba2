"""Queries of the problems on texts, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dialectica.llm import mixing, pairs, pii, spam, tokenizer, toxicity
from dialectica.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.found(table(spark, folder, "sample_input"), table(spark, folder, "review_labels"))


def p1_scores(spark: SparkSession, folder: str) -> DataFrame:
    chain = toxicity.fit_chain(toxicity.labelled(table(spark, folder, "review_labels")))
    return toxicity.scores(table(spark, folder, "sample_input"), chain).drop("source").distinct()


def p1_rates(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.rates(table(spark, folder, "sample_input"), table(spark, folder, "review_labels"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.found(table(spark, folder, "generation_results"))


def p4_labels(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.labels(table(spark, folder, "generation_results")).distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.found(table(spark, folder, "sample_input"))


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.scan(pii.review_texts(table(spark, folder, "sample_input")), ["idx", "item_pos"]).distinct()


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode_column(table(spark, folder, "documents"), ["doc_id"])


def _mixer(spark: SparkSession, folder: str) -> mixing.Mixer:
    return mixing.Mixer(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mixer(spark, folder).uses()


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixer(spark, folder).shares()


def p7_shards(spark: SparkSession, folder: str) -> DataFrame:
    return _mixer(spark, folder).shard_counts()


def p7_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _mixer(spark, folder).shard_documents()


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.found(table(spark, folder, "documents"))


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return spam.scores(table(spark, folder, "documents"))


QUERIES = {"p1_found": p1_found, "p1_scores": p1_scores, "p1_rates": p1_rates, "p4_found": p4_found, "p4_labels": p4_labels, "p5_found": p5_found, "p5_redacted": p5_redacted, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_shards": p7_shards, "p7_documents": p7_documents, "p8_found": p8_found, "p8_scores": p8_scores}
ORACLE: dict[str, str] = {}
