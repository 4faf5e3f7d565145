"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import langid, quality
from tallyframe.llm.common import table
from tallyframe.llm.exact_dedup import exact_dedup
from tallyframe.llm.html_text import extract
from tallyframe.llm.minhash import near_dedup
from tallyframe.llm.mixing import mix
from tallyframe.llm.packing import pack
from tallyframe.llm.sharding import interleave
from tallyframe.llm.token_counts import count_tokens
from tallyframe.llm.topk_search import top_k_search


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learns from labels outside the held-out fold."""
    held = quality.fold(F.col("doc_id"), 3) == 1
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(~held))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best integer inner products of every hundredth vector, against all others."""
    return top_k_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mixture takes of every document, repeats counted."""
    rows, _ = mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats") + F.col("extra")).alias("taken"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learns from documents outside the held-out fold."""
    held = quality.fold(F.col("doc_id"), 5) == 0
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~held))
    found = langid.predict(docs, model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the pieces of a unigram vocabulary."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by the law of near equal counts."""
    rows = interleave(table(spark, sf_dir, "documents"), shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document: three words, 85 percent."""
    return near_dedup(table(spark, sf_dir, "documents"), words=3, percent=85)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of its equals stays, for every document: the largest id."""
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_quality, op3_topk_search, op4_mixing, op5_language_id, op6_token_counts, op7_html_text, op8_sharding, op9_near_dedup, op10_exact_dedup)}
