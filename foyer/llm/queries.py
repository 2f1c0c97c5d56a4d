"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foyer.llm.packing import pack, token_pieces

    return pack(token_pieces(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json")))


def op2_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foyer.llm.chunkstore import stored_digests

    return stored_digests(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foyer.llm.preference import adjacent_pairs, format_preferences, mask_text

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    ready = format_preferences(turns, adjacent_pairs(turns))
    return ready.withColumns({c: mask_text(c) for c in ("chosen_mask", "rejected_mask")})


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foyer.llm.sharding import shard

    return shard(documents(spark, sf_dir))


def op5_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foyer.llm.quality import quality_report

    return quality_report(documents(spark, sf_dir))


def op6_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foyer.llm.recompress import remove_repeats

    found = remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foyer.llm.simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op8_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foyer.llm.phrases import compare_with_next

    return compare_with_next(documents(spark, sf_dir))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foyer.llm.suffixes import remove_repeats

    found = remove_repeats(documents(spark, sf_dir), passages=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "shares_passage")


def op10_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foyer.llm.mixture import mix

    return mix(documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foyer.llm.spelling import group_variants

    return group_variants(documents(spark, sf_dir))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foyer.llm.langid import identify

    return identify(documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foyer.llm.negatives import mine

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(moved, F.col("vec_id") % 50 == 0)


_OP13_SQL = """
with given as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
    from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
           cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) as score
    from given a, given b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), positives as (
    select anchor_id, other_id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select anchor_id, positive_id,
       cast(row_number() over (partition by anchor_id, positive_id order by score desc, other_id) as int) as rank,
       other_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, other_id) <= 3
"""


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op13_hard_negatives": _OP13_SQL}
