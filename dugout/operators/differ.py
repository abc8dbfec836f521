"""Two states of a mart compared: which rows came, went or changed, and in which columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

#: Buckets of one place; only those whose digests differ are compared row by row.
BUCKETS = 256
#: Sums of the quarters of the rows' digests.
SUMS = ("__sum0", "__sum1", "__sum2", "__sum3")


def _digest(rows: DataFrame, columns: Sequence[str]) -> list[Column]:
    """128 bits of the values as four whole numbers, whose sums are exact; nulls apart from empty texts.

    A hash passes over a null, so what is null is hashed as well; nested values go as JSON, where inner nulls show.
    """
    plain = {f.name: not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) for f in rows.schema.fields}
    values = [F.col(c) if plain[c] else F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}) for c in columns]
    hashes = [F.xxhash64(F.lit(half), *[F.isnull(c) for c in columns], *values) for half in (1, 2)]
    return [part for h in hashes for part in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(2**32 - 1)))]


def bucket_digests(rows: DataFrame, place: Sequence[str], keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(place, bucket, rows, sums): a digest that any order of the rows gives, one row for each bucket of a place."""
    parts = [part.alias(name) for name, part in zip(SUMS, _digest(rows, [*keys, *columns]), strict=True)]
    digest = rows.select(*place, F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("__bucket"), *parts)
    return digest.groupBy(*place, "__bucket").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(name).alias(name) for name in SUMS])


def mart_difference(before: DataFrame, after: DataFrame, place: Sequence[str], keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(place, keys, change, changed): rows that are ``added``, ``removed`` or ``changed``, and the names of the columns that differ.

    ``place`` (league and day) and ``keys`` name a row; a key that repeats in a place counts as many times as it occurs,
    in the order of its values. Buckets of equal digest are left out before any row is joined, so two readings
    that differ in a few games cost two aggregations and a join of their buckets.
    """
    place, keys, columns = list(place), list(keys), list(columns)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("__bucket")
    sides = [bucket_digests(x, place, keys, columns) for x in (before, after)]
    other = sides[1].select(*place, "__bucket", *[F.col(c).alias(f"o_{c}") for c in ("rows", *SUMS)])
    both = sides[0].join(other, [*place, "__bucket"], "full")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in ("rows", *SUMS)])
    # One row a place, so it goes to the rows; a join by bucket would move every row of both sides.
    open_ = F.broadcast(both.where(~same).groupBy(*place).agg(F.collect_set("__bucket").alias("__open")))

    def opened(rows: DataFrame, mark: int) -> DataFrame:
        values = [F.col(c).alias(f"__v{i}") for i, c in enumerate(columns)]
        placed = rows.select(*place, *keys, bucket, *values, F.lit(mark).alias("__mark")).join(open_, place)
        return placed.where(F.array_contains("__open", F.col("__bucket"))).drop("__open", "__bucket")

    rows = opened(before, 1).unionByName(opened(after, -1))
    # Equal rows of the two sides cancel out; what is left stands on one side only.
    names = [f"__v{i}" for i in range(len(columns))]
    left = rows.groupBy(*place, *keys, *names).agg(F.sum("__mark").alias("__net")).where("__net <> 0")
    times = F.explode(F.sequence(F.lit(1), F.abs(F.col("__net")).cast("int")))
    left = left.select(*place, *keys, F.struct(*names).alias("__v"), (F.col("__net") > 0).alias("__was"), times.alias("__time"))
    # Placed by key once, which both the numbering and the pairing keep.
    left = left.repartition(*place, *keys)
    number = F.row_number().over(Window.partitionBy(*place, *keys, "__was").orderBy("__v", "__time"))
    numbered = left.withColumn("__number", number)
    found = numbered.groupBy(*place, *keys, "__number").agg(
        F.struct(F.max(F.when(F.col("__was"), F.col("__v"))).alias("old"), F.max(F.when(~F.col("__was"), F.col("__v"))).alias("new")).alias("__p"))
    differ = F.filter(
        F.array(*[F.when(~F.col(f"__p.old.{n}").eqNullSafe(F.col(f"__p.new.{n}")), F.lit(c)) for n, c in zip(names, columns, strict=True)]), lambda x: x.isNotNull())
    change = F.when(F.col("__p.old").isNull(), "added").when(F.col("__p.new").isNull(), "removed").otherwise("changed")
    return found.select(*place, *keys, change.alias("change"), F.when(change == "changed", F.array_join(differ, ",")).otherwise("").alias("changed"))
