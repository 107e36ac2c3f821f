"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import byte_bpe, decontamination, graph_search, html_extraction, jaccard_join, language_id, substring_dedup, token_counts, toxicity, url_reputation
from annalist.llm.common import small_batches

HELD_OUT_OF = 5
QUERY_EVERY = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = byte_bpe.encode(table(spark, sf_dir, "documents"), decoded=True)
    n = (F.octet_length("tokens") / 4).cast("long")
    return tokens.select("doc_id", n.alias("n_tokens"), F.sha2("tokens", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def page_outcomes(labels: DataFrame) -> DataFrame:
    """Outcome of the page whose id a label carries: bad if it is of low quality or toxic; null labels tell nothing."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return labels.select(F.col("doc_id").alias("page_id"), bad.cast("int").alias("bad"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(table(spark, sf_dir, "pages"), page_outcomes(table(spark, sf_dir, "labels")))


def hit_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    ids: Column = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(id_col, "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hit_digest(decontamination.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(HELD_OUT_OF)) == 0
    profiles = language_id.train(docs.where(~held_out).select("text", "lang"))
    return language_id.identify(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, toxicity.label_categories(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, chain)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return graph_search.nearest(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline  # noqa: F401  absent when this subpackage was taken out: then nothing here is registered

    own = (op1_ngram_jaccard_join, op2_byte_bpe, op3_url_filters, op4_decontamination, op5_html_extraction, op6_language_id, op7_token_counts, op8_toxicity, op9_substring_dedup, op10_nearest_neighbours, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from annalist.llm.oracle import ORACLES

    return dict(ORACLES)
