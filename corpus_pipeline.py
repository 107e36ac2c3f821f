"""From raw documents to token ids: toxicity, n-gram Jaccard join, substring dedup, benchmark decontamination, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import byte_bpe, decontamination, jaccard_join, substring_dedup, toxicity
from annalist.llm.common import discard, materialize
from annalist.llm.queries import table


def _resized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain, fitted on the judged documents, does not reject; null and empty texts stay."""
    chain = toxicity.train(docs, toxicity.label_categories(table(spark, sf_dir, "labels")))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = docs.select("doc_id", "text", *([F.struct(*others).alias("row")] if others else []))
    scored = toxicity.score(held, chain, keep=tuple(held.columns[1:]))
    return scored.where(~F.col("toxic")).select(*(F.col(f"row.{c}") if c in others else c for c in docs.columns))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every component; documents without words or without an id are no group and stay.
    Rows of one id share a fate: they stay if one of them leads its group."""
    groups = jaccard_join.jaccard_components(docs)
    leaders = groups.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(leaders, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without sentences that an earlier document already has; texts left without words go."""
    cleaned = substring_dedup.clean(docs)
    return _resized(cleaned.where((F.col("n_removed") == 0) | (F.trim("text") != ""))).select(*docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of two or more benchmark items go; a single item's passages are cut out of the text."""
    return _resized(decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))).select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, tokens) of every document: ids as little-endian unsigned 32-bit integers, and the digest of their decoded bytes."""
    decoded = byte_bpe.encode(docs, decoded=True)
    n = (F.octet_length("tokens") / 4).cast("long")
    return decoded.select("doc_id", n.alias("n_tokens"), "tokens", F.octet_length("decoded").cast("long").alias("n_bytes"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", keep_civil),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", cut_benchmark),
    ("byte_bpe", to_tokens),
]

#: Classifier chain, component search and BPE have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
