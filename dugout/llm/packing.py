"""Length buckets of least padding, and token-budget batches inside each bucket.

Rows are counted by exact length over the whole table. A dynamic programme over the distinct lengths chooses the
bucket boundaries that minimise padding: every text of a bucket is padded to the longest length of its bucket. n
distinct lengths need at least n * n / 2 words, so even 100 TB have a few million of them. Batches then take ``budget // boundary`` texts of a bucket, in an order that is
random but fixed (md5 of the id).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from dugout.llm.common import stored

BUCKETS, BUDGET = 8, 16384
#: Rows that one window partition numbers, about.
PART_ROWS = 50_000


def word_count(text):
    """Words `[^ \\t-\\r]+` of a text; null or blank: 0."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t-\r]+|[ \t-\r]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[ \t-\r]+")))


def boundaries(lengths: np.ndarray, rows: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Bucket boundaries (longest lengths) of least total padding, for distinct ``lengths`` and the ``rows`` of each.

    Bucket by bucket the least padded length of the first j lengths is the least of i -> best[i] + top[j] * (rows[j] - rows[i]):
    lines in top[j] whose slopes fall with i, asked in ascending order, so their lower hull answers each in constant
    time. Whole numbers, no rounding. Of equal choices the one with fewer buckets and then the longer last bucket is taken.
    """
    order = np.argsort(lengths)
    top = np.asarray(lengths)[order].tolist()
    upto = [0, *np.cumsum(np.asarray(rows)[order], dtype=np.int64).tolist()]
    n = len(top)
    if not n:
        return []
    best: list[int | None] = [0] + [None] * n
    choice, finals = [], []
    for _ in range(min(buckets, n)):
        after: list[int | None] = [None] * (n + 1)
        pick = np.zeros(n + 1, np.int32)
        hull: list[int] = []
        at = 0
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                new = j - 1
                while len(hull) - at > 1:
                    # The last line goes when it is above the crossing of its neighbours, and only then: ties stay.
                    a, b = hull[-2], hull[-1]
                    if (best[b] - best[a]) * (upto[new] - upto[b]) <= (best[new] - best[b]) * (upto[b] - upto[a]):
                        break
                    hull.pop()
                hull.append(new)
            if len(hull) == at:
                continue
            x = top[j - 1]
            while at + 1 < len(hull) and best[hull[at + 1]] - x * upto[hull[at + 1]] < best[hull[at]] - x * upto[hull[at]]:
                at += 1
            pick[j] = hull[at]
            after[j] = best[hull[at]] + x * (upto[j] - upto[hull[at]])
        best = after
        choice.append(pick)
        finals.append(best[n])
    k, j, out = finals.index(min(finals)), n, []
    while j:
        out.append(int(top[j - 1]))
        j = int(choice[k][j])
        k -= 1
    return out[::-1]


def pack(docs: DataFrame, length, doc_id: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, bucket, boundary, batch_id, slot, capacity, oversize.

    ``length`` is a column with a row's length (null: 0). ``boundary`` is what the row is padded to: the longest
    length of its bucket. A batch holds ``capacity = budget // max(boundary, 1)`` rows, at least one; a bucket whose
    boundary is above the budget has batches of one row, and a row that is itself longer is ``oversize``; no text
    is cut or dropped. Equal lengths are always in one bucket. Ids that repeat get a slot each, and a null id
    counts as the text "null". An empty table gives an empty result; other columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(length, F.lit(0)).cast("bigint").alias("n_tokens"))
    rows = stored(rows, "lengths")
    # One row a distinct length: see the module's note.
    histogram = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("rows")).toPandas()
    total = int(histogram["rows"].sum())
    edges = boundaries(histogram["n_tokens"].to_numpy(), histogram["rows"].to_numpy(), buckets) or [0]
    digits = 1
    while total / (16**digits * len(edges)) > PART_ROWS / 2 and digits < 6:
        digits += 1
    bucket = F.lit(0)
    for edge in edges[:-1]:
        bucket = bucket + F.when(F.col("n_tokens") > edge, 1).otherwise(0)
    tops = F.array(*[F.lit(e).cast("bigint") for e in edges])
    rows = rows.withColumn("bucket", bucket).withColumn("boundary", F.element_at(tops, F.col("bucket") + 1))
    rows = rows.withColumn("place", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = rows.withColumn("part", F.substring("place", 1, digits))
    parts = rows.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("rows"))
    # One row per (bucket, part): 16**digits parts a bucket at most.
    before = F.sum("rows").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("bucket", "part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("place", "n_tokens"))
    rows = rows.withColumn("inside", inside).join(parts, ["bucket", "part"])
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("boundary"), F.lit(1)))).cast("bigint")
    at = F.col("before") + F.col("inside") - 1
    return rows.withColumn("capacity", capacity).select(
        "doc_id", "n_tokens", "bucket", "boundary",
        F.concat_ws("-", F.col("bucket"), F.floor(at / F.col("capacity"))).alias("batch_id"),
        (at % F.col("capacity")).alias("slot"), "capacity", (F.col("n_tokens") > budget).alias("oversize"))
