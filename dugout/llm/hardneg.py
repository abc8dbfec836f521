"""Hard negatives of anchors: exact whole-number inner products, several candidates at each multiplication.

*Products*: vectors are whole-number components. Components of anchors and of candidates are biased to be no less
than zero; as many candidates as fit stand in separated fields of one wide integer, each field wide enough for the
whole product. One multiplication for each anchor component then adds to the products of all fields at once; the
fields are cut apart and the biases taken off again. Where one product alone needs more than 63 bits, Python's
unbounded integers hold the same fields.

*Blocks*: candidates are dealt into blocks of about ``ROWS`` and anchors into blocks of about ``ANCHORS``; each
pair of blocks meets in one task and leaves the few best. Positives are looked for inside the anchor's label, split
the same way; negatives among all blocks. Equal vectors of one label count once as anchors, and as candidates with as
many ids as can be asked for, so a vector that a third of all rows hold costs no more than any other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from dugout.llm.common import stored

SCALE, POSITIVES, NEGATIVES, LEAST, MOST = 256, 5, 5, 80, 100
ROWS, ANCHORS = 4096, 512
#: Fields of one integer without bound, anchors that are multiplied at once, and the place of what is not allowed.
FIELDS, TURN, NEVER = 8, 64, -(1 << 63)


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Every inner product of two whole-number matrices (anchors x rows), exact; Python integers beyond 63 bits."""
    bias_a, bias_r = -int(anchors.min()), -int(rows.min())
    high_a, high_r = int(anchors.max()) + bias_a, int(rows.max()) + bias_r
    width = max(1, (high_a * high_r * anchors.shape[1]).bit_length())
    kind, fields = (np.uint64, 64 // width) if width < 64 else (object, FIELDS)
    # The sums below must be exact as well, not the fields alone.
    plain = max(abs(int(x)) for x in (anchors.min(), anchors.max(), rows.min(), rows.max(), bias_a, bias_r)) ** 2 * anchors.shape[1] * 4 < 1 << 63
    wide = np.int64 if plain and kind is not object else object
    count = -(-len(rows) // fields)
    packed = np.zeros((count, rows.shape[1]), kind)
    biased = (rows.astype(wide) + bias_r).astype(kind)
    for field in range(fields):
        part = biased[field * count : (field + 1) * count]
        packed[: len(part)] += part << kind(field * width) if kind is not object else part * (1 << field * width)
    packed = np.ascontiguousarray(packed.T)
    out = np.empty((len(anchors), len(rows)), wide)
    mask = kind((1 << width) - 1) if kind is not object else (1 << width) - 1
    off_r = rows.astype(wide).sum(axis=1) * bias_a
    for at in range(0, len(anchors), TURN):
        some = anchors[at : at + TURN].astype(wide)
        lifted = (some + bias_a).astype(kind)
        total = np.zeros((len(some), count), kind)
        for component, line in enumerate(packed):
            total += lifted[:, component, None] * line
        off = some.sum(axis=1) * bias_r + anchors.shape[1] * bias_a * bias_r
        for field in range(fields):
            low, high = field * count, min((field + 1) * count, len(rows))
            if low < high:
                cut = (total[:, : high - low] >> kind(field * width) if kind is not object else total[:, : high - low] // (1 << field * width)) & mask
                out[at : at + TURN, low:high] = cut.astype(wide) - off[:, None] - off_r[None, low:high]
    return out


def best(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of the ``k`` largest allowed scores of each line, ties to the smaller column."""
    score = np.where(allowed, score, NEVER)
    few = min(k, score.shape[1])
    last = np.partition(score, score.shape[1] - few, axis=1)[:, score.shape[1] - few, None]
    above, equal = score > last, score == last
    equal &= equal.cumsum(axis=1) <= few - above.sum(axis=1, keepdims=True)
    return np.nonzero((above | equal) & (score > NEVER))


def _held(numbers) -> np.ndarray:
    """As 64-bit numbers; one beyond them is the last of them."""
    return np.clip(numbers, NEVER + 1, -NEVER - 1).astype(np.int64)


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["q"].to_numpy()).astype(np.int64)


def whole_vectors(rows: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """vec_id, label, q (floor(scale * x) of each component) of the rows that take part, one row for each id."""
    x = F.col(vector).cast("array<double>")
    fine = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: F.coalesce((~F.isnan(c)) & (F.abs(c) < float("inf")), F.lit(False)))
    q = F.transform(x, lambda c: F.floor(c * scale).cast("bigint"))
    one = F.min(F.struct(F.col(label).cast("bigint").alias("label"), q.alias("q"))).alias("one")
    kept = rows.where(fine).groupBy(F.col(vec_id).cast("bigint").alias("vec_id")).agg(one).select("vec_id", "one.label", "one.q")
    kept = stored(kept, "vectors")
    widths = kept.groupBy(F.size("q").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    return kept.where(F.size("q") == widths[0]["w"]) if widths else kept


def _dealt(of: DataFrame, name: str, size: int, shelf: str) -> DataFrame:
    """(shelf, number of blocks) of the rows."""
    return of.groupBy(shelf).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))


def _meetings(anchors: DataFrame, rows: DataFrame, shelf: str, work, schema: str) -> DataFrame:
    """``work`` on every block of anchors with every block of rows of the same shelf."""
    blocks = _dealt(anchors, "a_blocks", ANCHORS, shelf).join(_dealt(rows, "r_blocks", ROWS, shelf), shelf)
    blocks = stored(blocks, "blocks")

    def placed(of: DataFrame, key: str, own: str, others: str) -> DataFrame:
        mine = F.expr(f"cast(pmod(xxhash64({key}), {own}) as int)")
        every = F.explode(F.expr(f"sequence(0, {others} - 1)"))
        return of.join(blocks, shelf).select("*", mine.alias(own[0]), every.alias(others[0])).drop("a_blocks", "r_blocks")

    left = placed(anchors, "anchor", "a_blocks", "r_blocks").groupBy(shelf, "a", "r")
    right = placed(rows, "vec_id", "r_blocks", "a_blocks").groupBy(shelf, "a", "r")
    return left.cogroup(right).applyInPandas(work, schema)


def hard_negatives(rows: DataFrame, every: int = 100, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE,
                   positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product of floor(scale * x) components, exact. Anchors are the rows whose id is divisible by
    ``every``; an anchor's positives are its ``positives`` best other rows of its label (fewer: all), higher scores first,
    ties to the smaller id. Of each positive the first ``negatives`` rows of other labels are returned whose score lies
    between ``least`` and ``most`` hundredths of the positive's, both included. A positive without such a row, and an
    anchor without a positive, give no row. No part is taken by a null id, label or vector, by a vector that is
    empty, of another length than most, or holding a null or non-finite component. Rows that repeat an id are one row,
    with the smallest (label, components). A component or a score beyond 64 bits counts as the last number of them. An
    empty table gives an empty result; other columns are not looked at.
    """
    kept = whole_vectors(rows, vec_id, vector, label, scale)
    place = F.row_number().over(Window.partitionBy("label", "q").orderBy("vec_id"))
    shown = stored(kept.withColumn("place", place).where(F.col("place") <= max(positives + 1, negatives)).drop("place").withColumn("all", F.lit(0)), "candidates")
    asked = kept.where(F.col("vec_id") % every == 0)
    first = asked.groupBy("label", "q").agg(F.min("vec_id").alias("anchor"))
    first = stored(first.withColumn("all", F.lit(0)), "anchors")
    groups = asked.join(first.drop("all"), ["label", "q"]).select("anchor", F.col("vec_id").alias("anchor_id"))

    def like(held: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(seen):
            return pd.DataFrame({"anchor": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        seen = seen.sort_values("vec_id")
        score = _held(products(_matrix(held), _matrix(seen)))
        q, v = best(score, np.ones(score.shape, bool), positives + 1)
        return pd.DataFrame({"anchor": held["anchor"].to_numpy()[q], "vec_id": seen["vec_id"].to_numpy()[v], "score": score[q, v]})

    near = _meetings(first.select("anchor", "label", "q"), shown.select("vec_id", "label", "q"), "label", like, "anchor bigint, vec_id bigint, score bigint")
    order = [F.desc("score"), F.asc("vec_id")]
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).where(F.col("place") <= positives + 1)
    near = stored(near.drop("place"), "near")
    # Of the anchors with one vector each leaves out itself, so one more was kept.
    own = groups.join(near, "anchor").where("vec_id <> anchor_id")
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("anchor_id").orderBy(*order))).where(F.col("place") <= positives)
    own = stored(own.select("anchor", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    levels = own.groupBy("anchor").agg(F.sort_array(F.collect_set("positive_score")).alias("levels"))  # positives + 1 scores at most

    def unlike(held: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"anchor": np.zeros(0, np.int64), "level": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})]
        if not len(held) or not len(seen):
            return found[0]
        seen = seen.sort_values("vec_id")
        score = _held(products(_matrix(held), _matrix(seen)))
        other = held["label"].to_numpy()[:, None] != seen["label"].to_numpy()[None, :]
        sets = held["levels"].to_numpy()
        for turn in range(max(map(len, sets))):
            lines = np.array([i for i, x in enumerate(sets) if len(x) > turn])
            level = [int(sets[i][turn]) for i in lines]
            # The smallest whole number no less than the lower end, and the largest no more than the upper one.
            low, high = (_held(np.array(end, object)) for end in ([-(-least * x // 100) for x in level], [most * x // 100 for x in level]))
            here = score[lines]
            q, v = best(here, other[lines] & (here >= low[:, None]) & (here <= high[:, None]), negatives)
            found.append(pd.DataFrame({
                "anchor": held["anchor"].to_numpy()[lines][q], "level": np.array(level, np.int64)[q], "vec_id": seen["vec_id"].to_numpy()[v], "score": here[q, v]}))
        return pd.concat(found)

    far = _meetings(first.join(levels, "anchor"), shown, "all", unlike, "anchor bigint, level bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("anchor", "level").orderBy(*order))
    far = far.withColumn("rank", rank).where(F.col("rank") <= negatives)
    far = far.select("anchor", F.col("level").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = own.join(far, ["anchor", "positive_score"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
