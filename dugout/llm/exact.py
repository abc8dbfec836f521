"""Exact duplicates: rows of equal normalised text, found by a 128-bit hash and confirmed by their bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dugout.llm.common import lowered, stored


def content_hash(text):
    """128-bit hash of a text."""
    return F.unhex(F.md5(text))


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "smallest", hasher=content_hash) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after A-Z are lower-cased; a null text is an empty one. Of a group the row with
    the smallest id stays, or the largest with ``keep="largest"``. Texts are counted by (hash, bytes) with a
    map-side combine, so a text shared by a third of all rows leaves each task once, and two texts that share a
    hash stay apart. The way back from a row to its group is a join on the hash alone, of ids and hashes without
    texts; only rows of a hash that holds several texts also compare their bytes.

    Rows that repeat one id with one text are all returned; all of them carry ``kept`` of that id. A null id stays
    only in a group without other ids, and then keep_id is null. An empty table gives an empty result; other
    columns are not looked at.
    """
    best = F.max if keep == "largest" else F.min
    rows = docs.select(F.col(doc_id).alias("doc_id"), lowered(F.col(text)).alias("norm"))
    rows = rows.select("doc_id", "norm", hasher(F.col("norm")).alias("hash"))
    texts = rows.groupBy("hash", "norm").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = texts.groupBy("hash").agg(
        F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
    )
    groups = stored(groups, "exact-groups")
    slim = rows.select("doc_id", "hash", F.sha2("norm", 256).alias("text_sha256"))
    result = slim.join(groups.where("texts = 1").drop("texts"), "hash")
    mixed = groups.where("texts > 1").select("hash")
    if not mixed.isEmpty():
        several = rows.join(mixed, "hash", "left_semi")
        several = several.join(texts.join(mixed, "hash", "left_semi"), ["hash", "norm"])
        several = several.withColumn("text_sha256", F.sha2("norm", 256))
        result = result.unionByName(several.select(result.columns))
    return result.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept: that of the smallest (or largest) id.

    Equal is as in :func:`exact_duplicates`. A null id stays only in a group without other ids, and of rows that share
    id and text any one stays. Rows are grouped by (hash, bytes) with the row that stays as a running
    minimum, so a task sends one row for each text it met, however many copies it has. An empty table gives an empty result; columns of any
    name and type are kept as they are.
    """
    norm = lowered(docs[text])
    named = F.col(doc_id)
    if keep == "largest":
        best = F.max_by(F.struct(*docs.columns), F.struct(named.isNotNull(), named))
    else:
        best = F.min_by(F.struct(*docs.columns), F.struct(named.isNull(), named))
    kept = docs.groupBy(content_hash(norm).alias("__hash"), norm.alias("__norm")).agg(best.alias("__row"))
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
