"""The queries of this subpackage: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.tables import table

from . import bpe, embedding_dedup, labelled, mixing, neighbours, pii, quality, simhash, substring_dedup, token_files, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def op1_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents"))


#: Relative target weights by source; any other source has REST.
WEIGHTS, REST = {"src0": 2.0, "src1": 4.0, "src2": 0.5}, 1.0


@query(mixing.sql(WEIGHTS, "d.doc_id, d.text, d.lang, d.source, d.n_chars", REST))
def op2_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), WEIGHTS, rest=REST)


@query()
def op3_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, d, "documents"))


@query()
def op4_bpe(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


@query()
def op5_embedding_dedup(spark: SparkSession, d: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, d, "embeddings"))


@query()
def op6_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = quality.scored(docs, quality.train(docs, table(spark, d, "labels")), out="score")
    return out.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query()
def op7_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = toxicity.scored(docs, toxicity.train(docs, table(spark, d, "labels")), out="score")
    return out.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op8_neighbours(spark: SparkSession, d: str) -> DataFrame:
    found = neighbours.nearest(table(spark, d, "embeddings"), F.col("id") % 20 == 0)
    return found.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


@query()
def op9_token_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    blocks, owners = token_files.tokenised(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)
    return owners.join(token_files.counts(blocks, 50256), ["shard", "ordinal"]).select("doc_id", "n_tokens", "shard", "ordinal")


@query()
def op10_pii(spark: SparkSession, d: str) -> DataFrame:
    found = pii.find_pii(table(spark, d, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda x: x["kind"].isin(*pii.BASE))
    counts = [pii.count_of(F.col("pii"), k).alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("pii")).alias("spans"))
