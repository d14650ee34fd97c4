"""A corpus pipeline of five stages over the table documents; each stage is written before the next reads it.

1. language_id drops documents without letters or with an uncertain language, and fills in a missing lang.
2. line_dedup takes repeated lines out of texts; n_chars follows.
3. simhash_near_dedup keeps the first document of each group of near-duplicates (similarity 0.8 of five-word shingles).
4. source_mixing repeats and drops documents so that sources come near their target shares.
5. best_fit_packing packs what is left into sequences of 2048 tokens, one row for each piece.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrastkit.llm.common import cut, own_names, row_key
from contrastkit.llm.langid import UNDETERMINED, held_out, identify_languages
from contrastkit.llm.lines import deduplicated_lines
from contrastkit.llm.mixing import mixed_documents
from contrastkit.llm.packing import Capacity, best_fit_packing
from contrastkit.llm.similar import first_of_similar

#: Least posterior probability of a document's language.
LEAST_SCORE = 0.5
SHINGLE_WORDS, RADIUS = 5, 3
#: Least Jaccard similarity of two documents' shingles at which the later one is dropped.
LEAST_SIMILARITY = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with letters whose language is found with a score of LEAST_SCORE; a null lang becomes that found.
    Null and empty texts go. Where no document has a lang to learn from, every text with letters stays."""
    sure = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    if not docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).limit(1).count():
        sure = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))  # nothing to learn from: a text with letters stays
    predicted = F.nullif(F.col("lang_pred"), F.lit(UNDETERMINED))
    return identify_languages(docs).where(sure).withColumn("lang", F.coalesce("lang", predicted)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that a smaller doc_id holds; a text may become empty, a null one stays null."""
    out = deduplicated_lines(docs).withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group linked by a shingle similarity of LEAST_SIMILARITY. Of rows that agree
    in doc_id and text one stays; texts without words are one group."""
    (key,) = own_names(docs, "row_key")
    keyed = docs.withColumn(key, row_key(docs))
    kept = first_of_similar(keyed.select(F.col(key).alias("doc_id"), "text"), SHINGLE_WORDS, LEAST_SIMILARITY, RADIUS).withColumnRenamed("doc_id", key)
    one = keyed.join(kept, key, "left_semi")
    if one.groupBy(key).count().where("count > 1").limit(1).count():  # rows with one doc_id and text
        one = one.dropDuplicates([key])
    return one.select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times; those without words once. A null source is a source."""
    return mixed_documents(docs, weights=(5.0, 2.0, 1.0), most=3)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 tokens; a null or empty text is one piece of one id."""
    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"), Capacity(tokens=2048))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", packing),
]

#: No SQL: models, fingerprints and packing are not expressible; tests hold stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the table documents in sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name, instead_of=[docs])
    return STAGES[-1][1](spark, docs, sf_dir)
