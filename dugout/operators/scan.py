"""Ordered running state over groups of any size.

A plain window needs a whole group in one task. Here each group is split into chunks of its own
order; every chunk is scanned on its own, a one-row summary per chunk is scanned across chunks,
and the result is joined back. The rows a task sees are bounded by the chunk, not by the group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: str,
    fills: Mapping[str, tuple[Column, bool]] | None = None,
    totals: Mapping[str, tuple[Column, bool]] | None = None,
    initial: DataFrame | None = None,
    fold: str | None = None,
) -> DataFrame:
    """Add the last non-null value (``fills``) and the running sum (``totals``) of a group.

    Each entry is ``name -> (value, inclusive)``; with ``inclusive`` false the row itself does not
    count. ``chunk`` must grow with ``order`` inside a group. ``initial`` holds one row per key
    with the values to use before the first one is seen. ``fold`` names a key with a few values:
    its summaries travel in one row per remaining key and chunk, so rows that are already
    partitioned by those are joined without moving again.
    """
    fills, totals = dict(fills or {}), dict(totals or {})
    keys, order = list(keys), list(order)
    valued = df.withColumns(
        {f"__v_{n}": v for n, (v, _) in fills.items()}
        | {f"__v_{n}": F.coalesce(v, F.lit(0)).cast("bigint") for n, (v, _) in totals.items()}
    )
    position = F.struct(*order)
    per_chunk = valued.groupBy(*keys, chunk).agg(
        *[
            F.max_by(F.col(f"__v_{n}"), F.when(F.col(f"__v_{n}").isNotNull(), position)).alias(f"__c_{n}")
            for n in fills
        ],
        *[F.sum(f"__v_{n}").alias(f"__c_{n}") for n in totals],
    )
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(
        *keys, chunk,
        *[F.last(f"__c_{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in fills],
        *[F.coalesce(F.sum(f"__c_{n}").over(before), F.lit(0)).alias(f"__c_{n}") for n in totals],
    )
    if initial is not None:
        known = [n for n in fills if n in initial.columns]
        first = initial.select(*keys, *[F.col(n).alias(f"__i_{n}") for n in known])
        carry = carry.join(first, keys, "left").withColumns(
            {f"__c_{n}": F.coalesce(f"__c_{n}", f"__i_{n}") for n in known}
        ).drop(*[f"__i_{n}" for n in known])

    def frame(inclusive: bool):
        inside = Window.partitionBy(*keys, chunk).orderBy(*order)
        return inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)

    local = valued.withColumns(
        {
            f"__l_{n}": F.last(f"__v_{n}", ignorenulls=True).over(frame(inc))
            for n, (_, inc) in fills.items()
        }
        | {
            f"__l_{n}": F.coalesce(F.sum(f"__v_{n}").over(frame(inc)), F.lit(0))
            for n, (_, inc) in totals.items()
        }
    )
    if fold is None:
        joined = local.join(carry, [*keys, chunk])
    else:
        outer = [k for k in keys if k != fold]
        carried = F.struct(*[f"__c_{n}" for n in (*fills, *totals)])
        folded = carry.groupBy(*outer, chunk).agg(
            F.map_from_entries(F.collect_list(F.struct(F.col(fold), carried))).alias("__carry")
        )
        joined = local.join(folded, [*outer, chunk]).withColumn("__own", F.col("__carry")[F.col(fold)])
        joined = joined.withColumns({f"__c_{n}": F.col("__own")[f"__c_{n}"] for n in (*fills, *totals)})
    return joined.select(
        *[F.col(c) for c in df.columns if c not in fills and c not in totals],
        *[F.coalesce(f"__l_{n}", f"__c_{n}").alias(n) for n in fills],
        *[(F.col(f"__l_{n}") + F.col(f"__c_{n}")).alias(n) for n in totals],
    )


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ties: Sequence[str],
    name: str = "rank",
    spread: Column | None = None,
    buckets: int = 1024,
) -> DataFrame:
    """1..n per group by ``value`` descending, for groups (and ties) of any size.

    Equal values are ordered by ``spread`` and then by ``ties``. ``spread`` cuts equal values into
    parts of bounded size; ``id div 1000000`` does so without changing the order of the ids, the
    default is a hash of the ties. Counts per (group, value, part) are aggregated map-side; only
    those counts are scanned per group.
    """
    keys = list(keys)
    bucket = spread if spread is not None else F.pmod(F.xxhash64(*ties), F.lit(buckets))
    spreaded = df.withColumn("__bucket", bucket.cast("bigint"))
    cell = [*keys, value, "__bucket"]
    ahead = (
        Window.partitionBy(*keys)
        .orderBy(F.desc(value), "__bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = spreaded.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        *cell, F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__offset")
    )
    inside = Window.partitionBy(*cell).orderBy(*ties)
    return (
        spreaded.withColumn("__row", F.row_number().over(inside))
        .join(offsets, cell)
        .withColumn(name, (F.col("__offset") + F.col("__row")).cast("bigint"))
        .drop("__bucket", "__row", "__offset")
    )


def kth_largest(df: DataFrame, keys: Sequence[str], value: str, k: Column, most: int) -> DataFrame:
    """``value`` at rank ``k`` per group. Partitions keep only their best ``most`` rows first."""
    place = Window.partitionBy(*keys).orderBy(F.desc(value))
    return (
        df.withColumn("__place", F.row_number().over(place))
        .filter(F.col("__place") <= most)
        .filter(F.col("__place") == k)
        .select(*keys, F.col(value).alias("kth"))
    )
