"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken per task from the bytes of many texts at once. Trees are grown in numpy on binned
statistics of a bounded sample of labelled rows (``SAMPLE_ROWS``), flattened into arrays, and applied to all rows
by walking all trees of a batch level by level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dugout.llm.common import crc_rest, slices, text_bytes
from dugout.llm.words import word_hashes, word_spans

#: Most labelled rows that the trees are grown on; of more, those with the smallest hash of the id.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_WEIGHT, SHRINK = 80, 4, 64, 0.15, 1.0, 1.0
_KINDS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": [32], "line": [10], "tab": [9, 13],
    "period": [46], "comma": [44], "question": [63], "bang": [33], "bar": [124], "symbol": [35, 36, 37, 38, 42, 64, 94, 126],
    "bracket": [40, 41, 60, 62, 91, 93, 123, 125], "quote": [34, 39], "dash": [45, 95], "slash": [47, 92, 58], "wide": range(128, 256),
}
_CODE = np.full(256, len(_KINDS), np.int64)
for _i, _codes in enumerate(_KINDS.values()):
    _CODE[list(_codes)] = _i
STATISTICS = (
    "log_bytes", "log_words", *(f"share_{k}" for k in _KINDS), "share_other", "mean_word", "max_word", "distinct_words",
    "repeated_next", "top_word", "log_lines", "mean_line", "repeated_lines", "upper_words", "symbol_words", "distinct_pairs",
)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0], np.cumsum(values)))
    return (run[bounds[1:]] - run[bounds[:-1]]).astype(np.float64)


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, most frequent value's count) of each owner."""
    if not len(values):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.concatenate(([True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])))
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(v)))
    top = np.zeros(n)
    np.maximum.at(top, o[at], counts)
    return np.bincount(o[at], minlength=n).astype(np.float64), top


def statistics(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row per text, columns as ``STATISTICS``; an empty text has zeros."""
    n = len(ends) - 1
    size = np.diff(ends).astype(np.float64)
    kinds = len(_KINDS) + 1
    owner = np.repeat(np.arange(n), np.diff(ends))
    codes = _CODE[raw]
    shares = np.bincount(owner * kinds + codes, minlength=n * kinds).reshape(n, kinds) / np.maximum(size, 1)[:, None]
    starts, stops, counts = word_spans(raw, ends)
    hashes, _ = word_hashes(raw, ends)
    words = np.diff(counts).astype(np.float64)
    some = np.maximum(words, 1)
    word_owner = np.repeat(np.arange(n), np.diff(counts))
    length = stops - starts
    longest = np.zeros(n)
    np.maximum.at(longest, word_owner, length)
    distinct, top = _distinct(hashes, word_owner, n)
    again = np.zeros(len(hashes), bool)
    pair = np.zeros(len(hashes), np.uint64)
    if len(hashes) > 1:
        inside = word_owner[1:] == word_owner[:-1]
        again[1:] = (hashes[1:] == hashes[:-1]) & inside
        pair[1:] = np.where(inside, hashes[1:] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[:-1], np.uint64(0))
    pairs, _ = _distinct(pair, word_owner, n)
    upper = np.concatenate(([0], np.cumsum(codes == 0)))
    letters = np.concatenate(([0], np.cumsum(codes <= 1)))
    symbol = np.concatenate(([0], np.cumsum(codes == list(_KINDS).index("symbol"))))
    n_upper, n_letters, n_symbol = (x[stops] - x[starts] for x in (upper, letters, symbol))
    shout = (n_letters > 1) & (n_upper == n_letters)
    # Lines, by the hash sum of their words: a line starts at a text's start and after each line feed.
    feed = np.flatnonzero(raw == 10)
    line_start = np.unique(np.concatenate((ends[:-1][size > 0], feed[~np.isin(feed + 1, ends)] + 1 if len(feed) else feed)))
    line_owner = np.searchsorted(ends, line_start, side="right") - 1
    lines = np.bincount(line_owner, minlength=n).astype(np.float64)
    at = np.searchsorted(starts, line_start)
    run = np.concatenate(([np.uint64(0)], np.cumsum(hashes * (np.arange(len(hashes), dtype=np.uint64) * np.uint64(0) + np.uint64(1)))))
    line_hash = run[np.append(at[1:], len(starts))] - run[at] if len(at) else np.zeros(0, np.uint64)
    line_distinct, _ = _distinct(line_hash, line_owner, n)
    columns = [
        np.log1p(size), np.log1p(words), *shares.T, _sums(length, counts) / some, longest, distinct / some, _sums(again, counts) / some,
        top / some, np.log1p(lines), size / np.maximum(lines, 1), 1 - line_distinct / np.maximum(lines, 1),
        _sums(shout, counts) / some, _sums(n_symbol > 0, counts) / some, pairs / some,
    ]
    return np.stack(columns, axis=1)


def _bins(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> dict[str, np.ndarray]:
    """Trees of one depth, flattened: node i of a tree has children 2i+1 and 2i+2; leaves stand after all splits.

    A node that gains nothing sends all rows left. Without rows, or with rows of one label, every score is that
    label's share (0.5 without rows).
    """
    splits = 2**depth - 1
    feature, threshold = np.zeros((trees, splits), np.int64), np.full((trees, splits), np.inf)
    value = np.zeros((trees, splits + 1))
    mean = float(y.mean()) if len(y) else 0.5
    base = np.log((mean * len(y) + 0.5) / ((1 - mean) * len(y) + 0.5))
    if 0 < mean < 1 and len(y):
        edges = _bins(x)
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
        score = np.full(len(y), base)
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            grad, weight = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                wide, first = 2**level, 2**level - 1
                best = np.zeros(wide)
                pick, cut = np.zeros(wide, np.int64), np.full(wide, BINS, np.int64)
                for f, bins in enumerate(binned):
                    at = node * BINS + bins
                    g = np.bincount(at, grad, wide * BINS).reshape(wide, BINS).cumsum(axis=1)
                    h = np.bincount(at, weight, wide * BINS).reshape(wide, BINS).cumsum(axis=1)
                    whole_g, whole_h = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + SHRINK) + (whole_g - g) ** 2 / (whole_h - h + SHRINK) - whole_g**2 / (whole_h + SHRINK)
                    gain[(h < LEAST_WEIGHT) | (whole_h - h < LEAST_WEIGHT)] = 0
                    gain[:, len(edges[f]) :] = 0
                    top = gain.argmax(axis=1)
                    now = gain[np.arange(wide), top]
                    better = now > best + 1e-12
                    best[better], pick[better], cut[better] = now[better], f, top[better]
                for i in np.flatnonzero(cut < BINS):
                    feature[t, first + i], threshold[t, first + i] = pick[i], edges[pick[i]][cut[i]]
                node = node * 2 + (binned[pick[node], np.arange(len(y))] > cut[node])
            g, h = np.bincount(node, grad, splits + 1), np.bincount(node, weight, splits + 1)
            value[t] = rate * g / (h + SHRINK)
            score += value[t][node]
    return {"feature": feature, "threshold": threshold, "value": value, "base": np.array(base)}


def predict(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each row: all trees are walked at once, level by level."""
    trees, splits = model["feature"].shape
    tree = np.arange(trees)[None, :]
    node = np.zeros((len(x), trees), np.int64)
    row = np.arange(len(x))[:, None]
    while splits and node.size and node[0, 0] < splits:
        node = 2 * node + 1 + (x[row, model["feature"][tree, node]] > model["threshold"][tree, node])
    return 1 / (1 + np.exp(-(model["base"] + model["value"][tree, node - splits].sum(axis=1))))


def _with_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        x = statistics(*text_bytes(batch.column("text")))
        values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("label"), values, batch.column("place")], ["label", "x", "place"])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "label", sample_rows: int = SAMPLE_ROWS) -> dict[str, np.ndarray]:
    """A model of ``labels`` (doc_id, 0/1); a null label or id teaches nothing, repeated labels count by their majority (a tie: 1).

    At most ``sample_rows`` labelled ids are looked for, and at most so many of their rows teach, chosen by hashes: an id
    that many rows share sends no more. Without any row to learn from, every text scores 0.5.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id"))
    rows = rows.agg(F.round(F.avg(label)).cast("int").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    # At most ``sample_rows`` ids.
    taught = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("text")).join(F.broadcast(rows), F.col("_doc") == F.col("_id"))
    taught = taught.select("text", "label", F.xxhash64("_id", "text").alias("place"))
    taught = taught.mapInArrow(_with_statistics, "label int, x array<double>, place bigint")
    found = taught.orderBy("place", "label").limit(sample_rows).toPandas()
    x = np.array(found["x"].tolist(), np.float64).reshape(len(found), len(STATISTICS))
    order = np.lexsort(x.T)
    return fit(x[order], found["label"].to_numpy(np.float64)[order])


def score(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with a score in 0..1 in ``column`` (replaced if there); a null text is an empty one and is scored too."""
    names = [c for c in docs.columns if c != column]
    docs = docs.select(*names)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            p = predict(model, statistics(*text_bytes(batch.column(text))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*names, column])

    return docs.mapInArrow(scored, docs.withColumn(column, F.lit(0.0)).schema)


def held_out(doc_id):
    """Rows that never teach the classifier."""
    return crc_rest(doc_id, 3) == 1
