"""The operators of this subpackage over the driver's whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dugout.llm import ann, bpe, chat, exact, hardneg, importance, langid, layout, lm, outliers, packing, quality, setjoin
from dugout.llm.common import table

NEAREST, QUERY_EVERY = 20, 20
CONTROL = "\\### Assistant: </turn> ok"


def tokenizer_ranks() -> tuple[str, str]:
    """(rank file, splitting pattern) of the vocabulary in use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").where(~quality.held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs, labels)
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks, pattern = tokenizer_ranks()
    ids = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), ranks, pattern).drop("text")
    both = bpe.decode(ids, ranks)
    return both.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm.lm_scores(table(spark, folder, "documents"))


def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], rows.schema)
    back = chat.read_back(chat.format_trees(chat.linear(rows.unionByName(extra))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned_text").cast("bigint").alias("loss_chars"), F.sha2("learned_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


def op5_html(spark: SparkSession, folder: str) -> DataFrame:
    pages = layout.extract(table(spark, folder, "pages").select("page_id", "html")).drop("html")
    return pages.withColumn("n_chars", F.length("text").cast("bigint"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), packing.word_count(F.col("text")))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    model = langid.train(table(spark, folder, "documents"))
    pages = table(spark, folder, "pages").select("page_id", langid.host_of(F.col("url")).alias("host"), langid.declared_in(F.col("html")).alias("declared"), "html")
    return langid.identify(layout.extract(pages).drop("html"), model, "page_id", "text", F.col("declared"), F.col("host"))


def op8_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), NEAREST, QUERY_EVERY)


def op9_set_join(spark: SparkSession, folder: str) -> DataFrame:
    return setjoin.similar_sets(table(spark, folder, "documents"))


def op10_exact(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, folder, "documents"), keep="largest")


def op11_importance(spark: SparkSession, folder: str) -> DataFrame:
    drawn = importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = outliers.quality_rules(table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(table(spark, folder, "embeddings").withColumn("label", moved))


ALL = {f.__name__: f for f in (
    op1_quality, op2_bpe, op3_lm, op4_chat, op5_html, op6_packing, op7_language, op8_neighbours, op9_set_join, op10_exact, op11_importance,
    op12_quality_rules, op13_hard_negatives)}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT *, role || chr(10) || text || chr(10) AS said, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned,
    length('<turn>' || replace(replace(replace(role, '\', '\e'), '<', '\l'), chr(10), '\n') || chr(10) || replace(replace(text, '\', '\e'), '<', '\l') || '</turn>' || chr(10)) AS chars
  FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(said, '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(length(learned)) AS BIGINT) AS loss_chars, sha256(string_agg(learned, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

OP9_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWERED}, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_LOWERED} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""

# The CRC register takes one byte of a word after the other; each distinct word is hashed once.
OP11_SQL = rf"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
u AS (SELECT r, unnest(w) AS w FROM d),
h AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM u UNION SELECT w FROM b)),
k AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2),
    lambda i: CAST((instr('0123456789ABCDEF', substr(x, i, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, i + 1, 1)) - 1 AS BIGINT))),
    lambda c, y: xor(t[xor(c % 256, y) + 1], c // 256))) % 10000 AS k FROM h, tab),
s AS (SELECT k, count(*) AS s FROM u JOIN k USING (w) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM b JOIN k USING (w) GROUP BY k),
g AS (SELECT k, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1.0)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS g FROM s LEFT JOIN t USING (k)),
v AS (SELECT r, count(*) AS n, CAST(sum(g) AS BIGINT) AS weight FROM u JOIN k USING (w) JOIN g USING (k) GROUP BY r),
x AS (SELECT d.r, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN v USING (r)),
y AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM y) // 100 THEN rank END AS rank FROM x LEFT JOIN y USING (r)
"""

OP13_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

SQL = {"op4_chat": OP4_SQL, "op9_set_join": OP9_SQL, "op10_exact": OP10_SQL, "op11_importance": OP11_SQL, "op13_hard_negatives": OP13_SQL}
