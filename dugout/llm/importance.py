"""Resampling towards a target: texts whose hashed n-grams look like the target's are drawn more often.

*Features*: runs of 1 to ``longest`` words, joined by one space; a feature's bucket is the CRC-32 of its bytes modulo
``buckets``. The CRCs of many features are taken at once: distinct features of equal length are the rows of one uint8
matrix, all CRC registers take one column at a time, and the buckets are scattered back to the places of the features.
A feature longer than ``WIDTH`` bytes is cut into rows of that width, whose registers are folded with the operator
that feeds ``WIDTH`` zero bytes. *Gains*: whole-number log ratios of a bucket's share in the target and in the rows.
*Draw*: weight plus Gumbel noise taken from the id alone, so the highest scores are a sample without replacement in
proportion to the weights, and a row's score does not change with the rows around it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dugout.llm.common import slices, stored, text_bytes

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
#: Columns of one CRC matrix, and bytes of one matrix.
WIDTH, MATRIX = 256, 1 << 22

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _step(register: np.ndarray, byte) -> np.ndarray:
    return _TABLE[(register ^ byte) & np.uint32(255)] ^ (register >> np.uint32(8))


_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & np.uint32(1), np.uint32(0xEDB88320) ^ (_TABLE >> np.uint32(1)), _TABLE >> np.uint32(1)).astype(np.uint32)
#: What ``WIDTH`` zero bytes make of a register, by each of its four bytes.
_ZEROS = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None])
for _ in range(WIDTH):
    _ZEROS = _step(_ZEROS, np.uint32(0))


def crc_rows(rows: np.ndarray) -> np.ndarray:
    """The CRC-32 of every row of a uint8 matrix."""
    register = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    head = rows.shape[1] % WIDTH
    for column in range(head):
        register = _step(register, rows[:, column])
    if rows.shape[1] > head:
        cut = np.zeros((len(rows), rows.shape[1] // WIDTH), np.uint32)
        flat, cuts = cut.reshape(-1), rows[:, head:].reshape(-1, WIDTH)
        for column in range(WIDTH):
            flat = _step(flat, cuts[:, column])
        for part in flat.reshape(cut.shape).T:
            moved = _ZEROS[0][register & np.uint32(255)]
            for byte in range(1, 4):
                moved = moved ^ _ZEROS[byte][(register >> np.uint32(8 * byte)) & np.uint32(255)]
            register = moved ^ part
    return register ^ np.uint32(0xFFFFFFFF)


def crc_spans(buffer: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The CRC-32 of every span of the buffer; spans hold no zero byte."""
    length = stop - start
    out = np.empty(len(start), np.uint32)
    order = np.argsort(length, kind="stable")
    at = 0
    while at < len(order):
        width = int(length[order[at]])
        upto = int(np.searchsorted(length[order], width, side="right"))
        step = max(1, MATRIX // max(width, 1))
        for low in range(at, upto, step):
            places = order[low : min(low + step, upto)]
            rows = buffer[start[places][:, None] + np.arange(width)]
            names = rows.view(f"S{width}").ravel() if width > 8 else _packed(rows)
            _, first, back = np.unique(names, return_index=True, return_inverse=True)
            out[places] = crc_rows(rows[first])[back]
        at = upto
    return out


def _packed(rows: np.ndarray) -> np.ndarray:
    """Each row of at most eight bytes as one number."""
    wide = np.zeros((len(rows), 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(np.uint64).ravel()


def features(raw: np.ndarray, ends: np.ndarray, longest: int = LONGEST):
    """(buffer, start, stop, text) of every feature, and the words of each text; A-Z count as a-z."""
    raw = _FOLD[raw]
    word = np.zeros(len(raw) + 2, bool)
    word[1:-1] = _WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[ends] = True
    start = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
    stop = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
    before = np.searchsorted(start, ends)
    words = np.diff(before)
    text = np.repeat(np.arange(len(words)), words)
    if longest == 1:
        return raw, start, stop, text, words
    # Words side by side with one space after each.
    length = stop - start
    after = np.cumsum(length + 1)
    buffer = np.full(int(after[-1]) if len(after) else 0, 32, np.uint8)
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    buffer[np.repeat(after - length - 1, length) + inside] = raw[np.repeat(start, length) + inside]
    low, high = after - length - 1, after - 1
    parts = []
    for n in range(1, longest + 1):
        first = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :]) if len(text) >= n else np.zeros(0, np.int64)
        parts.append((low[first], high[first + n - 1], text[first]))
    return buffer, *(np.concatenate(x) for x in zip(*parts, strict=True)), words


def bucket_counts(rows: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts; a null text has no words.

    A task sends one number for each bucket it met, so what reaches the driver is ``buckets`` numbers at any size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches, "text"):
            buffer, start, stop, _, _ = features(*text_bytes(part.column("text")), longest)
            total += np.bincount(crc_spans(buffer, start, stop) % np.uint32(buckets), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], ["bucket", "n"])

    found = rows.select(F.col(text).alias("text")).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in found.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(here: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of (share in the target / share here) of each bucket, one added to every count."""
    all_here, all_target = float(here.sum()) + len(here), float(target.sum()) + len(target)
    return np.floor(1000 * np.log((target + 1.0) * all_here / ((here + 1.0) * all_target))).astype(np.int64)


def weigh(rows: DataFrame, gain: np.ndarray, carry: list[str], text: Column, longest: int = LONGEST) -> DataFrame:
    """The columns of ``carry``, then n_words, n_features and weight (the summed gain of a text's features)."""
    body = "body" + "_" * max(map(len, carry), default=0)
    kept = rows.select(*carry, text.alias(body))
    schema = kept.select(*carry).schema.add("n_words", "long").add("n_features", "long").add("weight", "long")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, body):
            buffer, start, stop, owner, words = features(*text_bytes(part.column(body)), longest)
            won = np.bincount(owner, gain[crc_spans(buffer, start, stop) % np.uint32(len(gain))], part.num_rows)
            some = np.bincount(owner, minlength=part.num_rows)
            # Sums of whole numbers below 2**53 are exact in doubles.
            new = [pa.array(words.astype(np.int64)), pa.array(some.astype(np.int64)), pa.array(won.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *new], [*carry, "n_words", "n_features", "weight"])

    return kept.mapInArrow(each, schema)


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """floor(1000 times a Gumbel number), fixed by the seed and the id; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with rank: 1, 2, 3... of the ``percent`` of rows with ``least_words`` words that score highest.

    One sort by score over all tasks; a row's number is its place in its sorted piece plus the rows of the pieces
    before, so no task numbers more than its piece. Rows that share a score and an id are dealt by their place in
    the table, so a row that is repeated without end does not fill one piece.
    """
    rows = stored(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    able = F.col("n_words") >= least_words
    line = rows.where(able).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "_row")
    line = stored(line.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    piece, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    # One row for each piece of the sort.
    pieces = sorted(map(tuple, line.groupBy(piece.alias("piece")).count().collect()))
    total, before = 0, []
    for name, count in pieces:
        before.append((name, total))
        total += count
    most = percent * total // 100
    before = rows.sparkSession.createDataFrame(before, "_piece bigint, _before bigint")
    rank = F.col("_before") + inside + 1
    ranked = line.join(before, piece == F.col("_piece")).withColumn("rank", F.when(rank <= most, rank))
    return ranked.drop("_at", "_piece", "_before", "_row").unionByName(rows.where(~able).drop("_row").withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", carry: tuple[str, ...] = (),
             longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, the columns named in ``carry``, n_words, n_features, weight, score and rank.

    ``carry`` may name any column of ``docs`` (the text among them) that is called unlike these. A null or empty text
    has no features, weight 0, and is never drawn. A null id stands behind all others of its score. Repeated rows are
    counted, scored and ranked each; equal scores go to the smaller id. Texts of any length are read whole. An empty
    table gives an empty result, an empty target the gains of a target without words. Other columns are not looked at.
    """
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    ids = docs.withColumn("doc_id", F.col(doc_id).cast("long"))
    scored = weigh(ids, gain, ["doc_id", *carry], F.col(text), longest)
    return draw(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), percent, least_words)
