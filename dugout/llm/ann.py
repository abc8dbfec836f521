"""Nearest neighbours by inner product: a forest of random-projection trees, one shared queue, exact reranking.

Trees are fitted on a bounded sample (``SAMPLE``); every row is put into one leaf of every tree. A query walks
all trees with one priority queue, ordered by how far it stands on the wrong side of the splits passed, until it
has ``probes`` leaves. A leaf's rows meet the queries that opened it in one task, a large leaf in several; the
inner products are exact and in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from dugout.llm.common import stored

SAMPLE, TREES, LEAF, PROBES = 20_000, 10, 48, 400
#: Rows of a leaf that one task holds.
BLOCK = 2_000


def grow(sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> list[dict[str, np.ndarray]]:
    """Each tree: normals, cuts and children of its splits; a child below 0 is the leaf ``-child - 1``."""
    rng = np.random.Generator(np.random.PCG64(seed))
    forest = []
    for _ in range(trees):
        normals, cuts, left, right, leaves = [], [], [], [], 0
        todo = [(np.arange(len(sample)), None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            split = None
            for _try in range(3 if len(rows) > leaf else 0):
                a, b = sample[rng.choice(rows, 2, replace=False)].astype(np.float64)
                at = sample[rows] @ (a - b)
                middle = np.median(at)
                if (at <= middle).any() and (at > middle).any():
                    split = a - b, middle, at > middle
                    break
            if split is None:
                name, leaves = -leaves - 1, leaves + 1
            else:
                name = len(cuts)
                length = np.linalg.norm(split[0]) or 1.0
                normals.append(split[0] / length)
                cuts.append(split[1] / length)
                left.append(0)
                right.append(0)
                todo += [(rows[~split[2]], name, 0), (rows[split[2]], name, 1)]
            if parent is not None:
                (right if side else left)[parent] = name
        width = sample.shape[1]
        forest.append({
            "normals": np.array(normals).reshape(-1, width), "cuts": np.array(cuts, float), "left": np.array(left, np.int64),
            "right": np.array(right, np.int64), "leaves": np.array(leaves)})
    return forest


def leaves_of(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    if not len(tree["cuts"]):
        return np.zeros(len(x), np.int64)
    node = np.zeros(len(x), np.int64)
    open_ = np.arange(len(x))
    while len(open_):
        n = node[open_]
        far = np.einsum("ij,ij->i", x[open_], tree["normals"][n]) > tree["cuts"][n]
        node[open_] = np.where(far, tree["right"][n], tree["left"][n])
        open_ = open_[node[open_] >= 0]
    return -node - 1


def probe(forest: list[dict[str, np.ndarray]], query: np.ndarray, probes: int) -> list[int]:
    """``tree << 32 | leaf`` of the leaves nearest to the query, over all trees."""
    margins = [tree["normals"] @ query - tree["cuts"] for tree in forest]
    queue = [(0.0, t, 0 if len(tree["cuts"]) else -1) for t, tree in enumerate(forest)]
    found = []
    while queue and len(found) < probes:
        far, t, node = heapq.heappop(queue)
        while node >= 0:
            m = float(margins[t][node])
            near, other = (forest[t]["right"], forest[t]["left"]) if m > 0 else (forest[t]["left"], forest[t]["right"])
            heapq.heappush(queue, (max(far, abs(m)), t, int(other[node])))
            node = int(near[node])
        found.append(t << 32 | (-node - 1))
    return found


def best_in_block(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int):
    """(query index, row index, inner product) of each query's k best rows at or above its floor, ties to the smaller id.

    ``ids`` ascend. The sums of equal vectors are equal, wherever they stand.
    """
    score = np.einsum("qd,vd->qv", queries, vectors)
    score[own[:, None] == ids[None, :]] = -np.inf
    few = min(k, score.shape[1])
    last = np.partition(score, score.shape[1] - few, axis=1)[:, score.shape[1] - few]
    above, equal = score > last[:, None], score == last[:, None]
    equal &= equal.cumsum(axis=1) <= few - above.sum(axis=1, keepdims=True)
    q, v = np.nonzero((above | equal) & (score >= floor[:, None]) & (score > -np.inf))
    return q, v, score[q, v]


def nearest(rows: DataFrame, k: int, query_every: int, vec_id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE,
            trees: int = TREES, leaf: int = LEAF, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose id is divisible by ``query_every``.

    Candidates are all rows but the query's own, nearest first, equal scores by the smaller id; fewer candidates are
    all returned. No part is taken by a null id and by a vector that is null, empty, all zero, of another length than
    most, or holding a null or non-finite component. Rows that repeat an id are one row, with the smallest of their
    vectors. Equal vectors of different ids are all candidates. An empty table gives an empty result; other columns
    are not looked at.
    """
    good = F.expr(f"forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({vector}, x -> x <> 0)")
    kept = rows.where(F.col(vector).isNotNull() & F.col(vec_id).isNotNull() & good)
    kept = kept.groupBy(F.col(vec_id).cast("bigint").alias("vec_id")).agg(F.min(vector).alias("v"))
    kept = stored(kept, "vectors")
    out = "query_id bigint, rank int, vec_id bigint, score double"
    widths = kept.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    if not widths:
        return rows.sparkSession.createDataFrame([], out)
    kept = kept.where(F.size("v") == widths[0]["w"])
    # At most ``sample`` vectors.
    seen = kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas().sort_values("vec_id")
    known, known_ids = np.array(seen["v"].tolist(), np.float64), seen["vec_id"].to_numpy()
    longest = np.linalg.norm(known, axis=1).max()
    forest = grow(known, trees, leaf)
    known_leaves = [leaves_of(tree, known) for tree in forest]

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                x = np.array(part["v"].tolist(), np.float64)
                for t, tree in enumerate(forest):
                    yield pd.DataFrame({"leaf": (t << 32) + leaves_of(tree, x), "vec_id": part["vec_id"].to_numpy(), "v": part["v"]})

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            leaves, floors = [], []
            for name, v in zip(part["vec_id"], part["v"], strict=True):
                x = np.asarray(v, np.float64)
                leaves.append(probe(forest, x, probes))
                # Sample rows in the opened leaves are found for sure, so the k-th best found is not below their k-th best.
                inside = known_ids != name
                at = [x - (x >> 32 << 32) for x in leaves[-1]]
                hit = np.zeros(len(known), bool)
                for t, assigned in enumerate(known_leaves):
                    opened = np.zeros(int(forest[t]["leaves"]), bool)
                    opened[[leaf for leaf, x in zip(at, leaves[-1], strict=True) if x >> 32 == t]] = True
                    hit |= opened[assigned]
                score = known[hit & inside] @ x
                # Sums of another order differ by less than this.
                slack = 4 * len(x) * np.finfo(float).eps * np.linalg.norm(x) * longest
                floor = np.partition(score, len(score) - k)[len(score) - k] - slack if len(score) >= k else -np.inf
                floors.append(floor if np.isfinite(floor) else -np.inf)
            asked = pd.DataFrame({"leaf": leaves, "query_id": part["vec_id"].to_numpy(), "q": part["v"].to_numpy(), "floor": floors})
            yield asked.explode("leaf").astype({"leaf": "int64"})

    kind = kept.schema["v"].dataType.simpleString()
    index = kept.mapInPandas(place, f"leaf bigint, vec_id bigint, v {kind}")
    asks = kept.where(F.col("vec_id") % query_every == 0).mapInPandas(ask, f"leaf bigint, query_id bigint, q {kind}, floor double")
    sizes = index.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sizes = stored(sizes, "leaves")
    index = index.join(sizes, "leaf").select(F.col("leaf").alias("at"), F.expr("cast(pmod(xxhash64(vec_id), blocks) as int)").alias("part"), "vec_id", "v")
    asks = asks.join(sizes, "leaf").select("leaf", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "query_id", "q", "floor")

    def meet(key, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(held) or not len(asked):
            return empty
        held = held.sort_values("vec_id")
        vectors, ids = np.array(held["v"].tolist(), np.float64), held["vec_id"].to_numpy()
        names, queries = asked["query_id"].to_numpy(), np.array(asked["q"].tolist(), np.float64)
        found = [empty]
        for at in range(0, len(names), 512):
            q, v, score = best_in_block(vectors, ids, queries[at : at + 512], names[at : at + 512], asked["floor"].to_numpy()[at : at + 512], k)
            found.append(pd.DataFrame({"query_id": names[at + q], "vec_id": ids[v], "score": score}))
        return pd.concat(found)

    pairs = index.groupBy("at", "part").cogroup(asks.groupBy("leaf", "block")).applyInPandas(meet, "query_id bigint, vec_id bigint, score double")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
