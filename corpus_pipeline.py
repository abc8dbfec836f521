"""From raw documents to packed batches: language ID, quality, exact copies, near copies, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dugout.llm import exact, langid, packing, quality, setjoin
from dugout.llm.common import free_name, stored, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in one of the declared languages; those that no known language explains go.

    A decision is one of id, text, declared language and source: rows that share only an id are decided each alone.
    """
    model = langid.train(docs)
    digest, declared, source = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), F.lower(F.trim("lang")), F.lower(F.trim("source"))
    key = free_name(docs, "key")
    rows = docs.withColumn(key, F.struct(F.col("doc_id"), digest.alias("digest"), declared.alias("declared"), source.alias("source")))
    found = langid.identify(rows, model, key, "text", declared, source)
    gone = stored(found.where(F.col("lang") == langid.UNKNOWN).select(F.col(key).alias("gone")).distinct(), "gone")
    return rows.join(gone, rows[key].eqNullSafe(gone["gone"]), "left_anti").drop(key)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by the labelled ones, gives at least an even chance.

    A null text counts as an empty one and is scored like any other; repeated rows get equal scores, so they stay or go
    together. An empty table stays empty; extra columns of any name are kept as they are.
    """
    labels = table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs, labels)
    score = free_name(docs, "score")
    return quality.score(docs, model, column=score).where(F.col(score) >= 0.5).drop(score)


def one_of_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, null and empty texts being one group; columns of any name stay."""
    return exact.drop_exact_duplicates(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similar word sets; texts without words are linked with nothing and stay."""
    return setjoin.drop_similar(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A bucket, batch and slot for every document, null and empty texts with length 0; an empty table gives no row."""
    return packing.pack(docs, packing.word_count(F.col("text")))


STAGES = [
    ("language ID", known_language),
    ("quality classifier", good_quality),
    ("exact dedup", one_of_exact_copies),
    ("n-gram Jaccard join", one_of_near_copies),
    ("packing", packed),
]

#: Trained models decide in two stages, which SQL cannot say; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rows of ``documents`` after all stages, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
