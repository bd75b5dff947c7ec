"""One registered query per corpus operator, over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestream.llm.decontam import contaminations
from lodestream.llm.fm_quality import fit_quality, quality_scores
from lodestream.llm.minhash import minhash_components
from lodestream.llm.packing import packed
from lodestream.llm.pii import pii_digest
from lodestream.llm.product_codes import product_codes
from lodestream.llm.simhash import simhash_components
from lodestream.llm.simple8b import stored_digest
from lodestream.llm.suffix_dedup import deduplicated
from lodestream.llm.syncmers import edited_likeness
from lodestream.llm.token_counts import token_counts
from lodestream.llm.toxicity import fit_toxicity, scored_with_folds, toxicity_scores
from lodestream.llm.whitening import whitened

QUERIES: dict = {}
ORACLE: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(documents(spark, sf_dir))


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), "word_bpe_49k.json", with_ids=False)


@query
def op3_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_digest(documents(spark, sf_dir), "byte_bpe_50k.json")


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir), words=4, radius=4)


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(documents(spark, sf_dir))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored_with_folds(toxicity_scores(docs, model), 0.5)


@query
def op4_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored_with_folds(quality_scores(docs, model), 0.3)


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir))


@query
def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(documents(spark, sf_dir))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op13_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
