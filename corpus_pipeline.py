"""The corpus pipeline: from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.  docs has doc_id, text, lang, source
and n_chars, and may have more columns: all stages but the last return docs' columns.
Any column may be null; null text counts as empty.  Rows that share a doc_id, or have
none, are documents of their own in every stage.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foyer.llm import common, mixture, packing, quality, queries, simhash, suffixes


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects.

    Null, empty and short texts (below 50 words) go; equal texts have equal verdicts.
    """
    return quality.cascade(docs).filter("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by shingles of five words and a similarity of 0.8, the document with the smallest doc_id.

    Of rows that share it the first by text; texts without words are one group.
    """
    inner, named = common.shielded(docs, ("doc_id", "text"))
    own = common.keyed(inner)
    groups = simhash.similar_groups(own.select(F.col("_key").alias("doc_id"), "text"))
    kept = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("_key"))
    return named(own.join(kept, "_key", "left_semi").drop("_key", "_order")).select(*docs.columns)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 400-byte strings that stand more than once; characters that a cut splits go.

    No copy of a repeat stays, so a text can become empty; its row stays, with n_chars of
    what is left.  Null text becomes empty.
    """
    inner, named = common.shielded(docs, ("doc_id", "text", "n_chars"))
    found = suffixes.remove_repeats(inner, as_text=True).withColumnRenamed("kept", "text")
    return named(found.withColumn("n_chars", F.length("text").cast("long"))).select(*docs.columns)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, a row for each time that it takes a document.

    Null is a source of its own.  A document that the budget cuts keeps its first words;
    one without words is never taken.
    """
    return mixture.mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences.

    Each row, repeated ones too, gives its own pieces: at least the end id.
    """
    return packing.pack(packing.token_pieces(docs, queries.tokenizer_path("byte_bpe_50k.json")))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", repeat_dedup),
    ("source mixture", source_mixture),
    ("best-fit packing", best_fit_packing),
]

#: Tokens, suffixes and fingerprints aren't expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of sf_dir's documents; each stage's result is stored in the shared folder."""
    docs = queries.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
