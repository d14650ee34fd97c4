"""The corpus operators as queries over the driver's tables: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrastkit.llm.clusters import centroid_clusters
from contrastkit.llm.counting import EDITS, edited, token_trees
from contrastkit.llm.embeddings import embedding_near_duplicates
from contrastkit.llm.filters import filter_audit
from contrastkit.llm.langid import identify_languages
from contrastkit.llm.licenses import license_scan
from contrastkit.llm.lines import deduplicated_lines
from contrastkit.llm.mixing import mixed_sources
from contrastkit.llm.oracle import ORACLE_SQL as ORACLE_SQL
from contrastkit.llm.packing import Capacity, best_fit_packing
from contrastkit.llm.pairs import decoded, encoded
from contrastkit.llm.quality import quality_rules
from contrastkit.llm.simhash import near_duplicates
from contrastkit.llm.substrings import removed_repeats


def tokenizer() -> str:
    """Path of the byte-level BPE vocabulary that the queries count and pack by."""
    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sources(_table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), most=3)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 tokens; no document count or attention cost can go over its capacity there, so in the score
    those residuals only tell apart bins that tokens alone do not."""
    return best_fit_packing(_table(spark, sf_dir, "documents"), tokenizer(), Capacity(tokens=2048))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_repeats(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and behind three edits of every document: a headline, a cut in the middle, a closing line."""
    length = F.length(F.coalesce("text", F.lit("")))
    edit = lambda at, removed, inserted: F.struct(at.cast("long").alias("at"), F.lit(removed).cast("long").alias("removed"), inserted.alias("inserted"))
    headline = F.concat(F.lit("From "), F.coalesce("source", F.lit("nowhere")), F.lit(":\n"))
    changes = F.array(edit(F.lit(0), 0, headline), edit(F.floor(length / 2), 40, F.lit(" [...] ")), edit(length * 2 + 100, 0, F.lit("\nEnd.")))
    trees = token_trees(_table(spark, sf_dir, "documents").select("doc_id", "text", changes.cast(EDITS).alias("edits")), tokenizer())
    out = edited(trees.withColumn("tokens_before", F.col("n_tokens")), tokenizer())
    return out.select("doc_id", "tokens_before", F.col("n_tokens").alias("tokens_after"), F.length("text").cast("long").alias("chars_after"), "encoded_chars")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.98)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, radius=2)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed="3")


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as counts and digests."""
    out = decoded(encoded(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer()).drop("text"), tokenizer())
    listed = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), digest(listed).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_source_mixing,
        op3_best_fit_packing,
        op4_substring_dedup,
        op5_token_counts,
        op6_simhash_near_dedup,
        op7_embedding_near_dedup,
        op8_line_dedup,
        op9_quality_rules,
        op10_language_id,
        op11_filter_audit,
        op12_centroid_clusters,
        op13_bpe_round_trip,
    )
}
