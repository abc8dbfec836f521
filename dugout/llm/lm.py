"""Language-model scoring: a gated recurrent network with a class-factored output, in numpy, beside a word-count base.

*Counts* come from every training row. *Vocabulary*: it grows with the counted words. A word seen ``OWN`` times has
an entry of its own (``HEAD`` words at most); all others share entries by their hash, one for each ``SHARED`` tokens
of theirs or up to twice as many, and are scored as that entry times their smoothed share of its words. So every word is context for its
neighbours and is scored in context. Entries lie by frequency in cells, whose number and width grow with the square
root of the entries. Each of the ``BROAD`` most frequent cells is a class; the others make up ``PLAIN`` classes. *Network*:
word vectors projected to gated recurrent units; the output is a softmax over classes times a softmax inside the class of the word,
which in the plain classes is its counted share (a rare word is told from its like by counts alone, its class by context). It
starts from the counted word shares. *Training*: truncated backpropagation through windows of ``WINDOW`` tokens, over one stream
of texts cut into equal lanes, in rounds; in each, every task of the scan trains a copy on its rows and the copies are averaged, weighted by
tokens. Each round takes one of ``SHARES`` = ``ROUNDS`` equal shares of the training rows by a hash of the id, so
the gradient sees every training row once. *Scoring*: texts lie end to end in lanes; windows of a lane hand
the state on, and it is cleared only where a text begins, so a whole text is scored however long it is.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dugout.llm.common import crc_rest, short_shuffles, slices, stored, text_bytes
from dugout.llm.words import word_hashes

#: The least cells and words in a cell; more words have more of both.
CLASSES, PER_CLASS, HIDDEN = 32, 32, 32
#: Components of a word's own vector; they are projected to the gates.
INPUT = 24
#: Cells of the most frequent words (the last ones) are classes with a softmax of their own; the cells of the others make
#: up at most ``PLAIN`` classes, inside which a word has its counted share.
BROAD, PLAIN = 64, 32
#: Times a word is seen that has an entry of its own beyond the least ones; tokens for each entry of the other words.
OWN, SHARED = 32, 128
#: Words whose counts every task holds (16 bytes each); counts of the others are joined.
HEAD = 1 << 18
SMOOTH = 0.1
#: Lanes while learning: as many as leave ``WINDOWS`` updates for a slice, within these bounds.
WINDOW, LANES, WINDOWS, SCORE_LANES = 24, (16, 256), 150, 128
#: As many shares as rounds: together they take every training row.
ROUNDS, STEP = 4, 8e-3
SHARES = ROUNDS
#: The end mark, and the first of the entries that words without one of their own share.
END, OTHER = 0, 1
_MOST_COUNTS = 1 << 22
#: Tokens whose class probabilities are worked out at once: they stay in the cache.
_BLOCK = 1024
_LANE_BYTES = 16 << 20
#: Far above what the network gives; keeps exp() finite without a pass for the largest.
_MOST_LOGIT = np.float32(40)
_SHARES_OF_MODEL = 16


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    values = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(values)
    values, counts = values[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, int)
    return values[at], np.add.reduceat(counts, at) if len(at) else counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a task with their counts; what a task holds is bounded by ``_MOST_COUNTS``."""
    def out(parts):
        values, counts = _merge(parts)
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["word", "c"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in slices(batches, "text"):
        hashes, _ = word_hashes(*text_bytes(batch.column("text")))
        values, counts = np.unique(hashes, return_counts=True)
        held.append((values, counts.astype(np.int64)))
        if len(held) >= 8:
            held = [_merge(held)]
            if len(held[0][0]) > _MOST_COUNTS:
                yield out(held)
                held = []
    if held:
        yield out(held)


def sizes(counts: np.ndarray, tokens: int) -> tuple[int, int]:
    """(words with entries of their own, entries of all others) for the counts of the frequent words and all words' tokens."""
    own = max(min(CLASSES * PER_CLASS - 2, len(counts)), int((counts >= OWN).sum()))
    outside = tokens - int(np.sort(counts)[::-1][:own].sum())
    return own, 1 << int(np.log2(min(max(outside / SHARED, 1), HEAD // 4)))


class Vocabulary:
    """Frequent words by their hashes (sorted), their counts, and their output entries.

    ``own`` words have entries of their own. The others share the entries from ``OTHER`` on by the low bits of their
    hashes; ``shared`` has (tokens, words) of *all* words by these bits, and its length is a power of two.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, ends: int, total: int, distinct: int, own: int = CLASSES * PER_CLASS - 2, shared: np.ndarray | None = None):
        if shared is None:
            shared = np.array([[total - ends, max(distinct - 1, 0)]], np.int64)
        order = np.argsort(-counts, kind="stable")
        self.mask = np.uint64(len(shared) - 1)
        entries = self.bits(words) + OTHER
        inside, first = order[:own], OTHER + len(shared)
        tokens = shared[:, 0] - np.bincount(self.bits(words[inside]), counts[inside], len(shared))
        kinds = shared[:, 1] - np.bincount(self.bits(words[inside]), minlength=len(shared))
        # The most frequent word has the last entry, so that the last classes are the frequent ones.
        entries[inside] = np.arange(first + len(inside) - 1, first - 1, -1)
        sort = np.argsort(words)
        self.words, self.counts, self.entries, self.first = words[sort], counts[sort], entries[sort].astype(np.int32), first
        self.ends, self.total, self.distinct = ends, total, distinct
        per_cell = max(PER_CLASS, int(np.ceil(np.sqrt(first + len(inside)) / 2)))
        self.shape = max(CLASSES, -(-(first + len(inside)) // per_cell)), per_cell
        share = np.zeros(self.shape[0] * self.shape[1])
        share[END] = ends
        share[first : first + len(inside)] = counts[inside][::-1]
        share[OTHER:first] = np.maximum(tokens, 0)
        self.outside = np.log10(np.maximum(tokens, 0) + SMOOTH * np.maximum(kinds, 0) + SMOOTH)
        share += SMOOTH
        self.share = share / share.sum()
        self.whole = np.log10(total + SMOOTH * (distinct + 1))

    def bits(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the shared entries a word has that has none of its own."""
        return (hashes & self.mask).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each word among the frequent ones, whether it is there)."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return at, self.words[at] == hashes


def tops(cells: int, broad: int) -> np.ndarray:
    """The class of each cell."""
    plain = max(cells - broad, 0)
    classes = min(PLAIN, plain)
    return np.concatenate([np.arange(plain) * classes // max(plain, 1), classes + np.arange(cells - plain)])


def start(vocabulary: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    """A network that gives every word its counted share."""
    rng = np.random.Generator(np.random.PCG64(seed))
    cells, per_cell = vocabulary.shape
    share = vocabulary.share.reshape(cells, per_cell)
    top = tops(cells, BROAD)
    classes = int(top[-1]) + 1
    broad = min(BROAD, cells)
    whole = np.bincount(top, share.sum(axis=1), classes)
    f = np.float32
    return {
        "E": rng.normal(0, 1, (cells * per_cell, INPUT)).astype(f), "V": rng.normal(0, 0.3 * INPUT**-0.5, (INPUT, 3 * HIDDEN)).astype(f), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)).astype(f),
        "C": np.zeros((HIDDEN, classes), f), "c": np.log(whole).astype(f),
        "W": np.zeros((broad, HIDDEN, per_cell), f), "w": np.log(share / whole[top][:, None]).astype(f),
    }


def lanes_of(entries: np.ndarray, bounds: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end in lanes, the longest lane first: (input, target, text) by step and lane, and lane lengths.

    ``entries``: all texts' entries, each text closed by ``END``. The text is -1 where a lane has ended. The input
    of a text's first step is ``END``.
    """
    sizes = np.diff(bounds)
    lanes = min(most, len(sizes))
    heap = [(0, i) for i in range(lanes)]
    place = np.zeros(len(sizes), np.int64)
    first = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        length, lane = heapq.heappop(heap)
        place[i], first[i] = lane, length
        heapq.heappush(heap, (length + int(sizes[i]), lane))
    length = np.bincount(place, sizes, lanes).astype(np.int64)
    rank = np.empty(lanes, np.int64)
    rank[np.argsort(-length, kind="stable")] = np.arange(lanes)
    steps = int(length.max(initial=0))
    x, y, text = np.zeros((steps, lanes), np.int32), np.zeros((steps, lanes), np.int32), np.full((steps, lanes), -1, np.int32)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    row = first[owner] + np.arange(len(entries)) - bounds[owner]
    column = rank[place[owner]]
    y[row, column], text[row, column] = entries, owner
    given = np.concatenate(([END], entries[:-1])) if len(entries) else entries
    given[bounds[:-1]] = END
    x[row, column] = given
    return x, y, text, np.sort(length)[::-1]


def stream_of(entries: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end as one stream cut into equal lanes, for learning: (input, target, whether a text begins, whether a token) by step and lane.

    A text that goes on in the next lane is learned there from an empty state; no lane waits for the longest text.
    """
    n = len(entries)
    lanes = min(max(n // (WINDOW * WINDOWS), LANES[0]), LANES[1])
    steps = -(-n // lanes)
    out = np.full((3, lanes * steps), END, np.int32)
    out[0, 1:n], out[1, :n], out[2, bounds[:-1]] = entries[:-1], entries, 1
    out[0, bounds[:-1]] = END
    x, y, fresh = (np.ascontiguousarray(a.reshape(lanes, steps).T) for a in out)
    live = np.ascontiguousarray((np.arange(lanes * steps) < n).reshape(lanes, steps).T)
    return x, y, fresh.astype(bool), live


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.minimum(x, _MOST_LOGIT, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _forward(m, x, fresh, h, keep: bool):
    """States after each step of a window; with ``keep`` also what the way back needs."""
    steps, wide = x.shape
    H = HIDDEN
    given = (m["E"][x.ravel()] @ m["V"]).reshape(steps, wide, 3 * H)
    out = np.empty((steps, wide, H), np.float32)
    saved = [np.empty((steps, wide, k * H), np.float32) for k in (2, 1, 1, 1)] if keep else None
    for t in range(steps):
        if fresh[t].any():
            h = h * ~fresh[t][:, None]
        a = h @ m["U"]
        g = given[t]
        zr = _sigmoid(g[:, : 2 * H] + a[:, : 2 * H])
        n = np.tanh(g[:, 2 * H :] + zr[:, H:] * a[:, 2 * H :])
        new = n + zr[:, :H] * (h - n)
        if keep:
            saved[0][t], saved[1][t], saved[2][t], saved[3][t] = zr, n, a[:, 2 * H :], h
        h = new
        out[t] = h
    return out, h, saved


def _output(m, h, y, grad: bool, each=None):
    """Natural log probability of each target given its state; with ``grad`` also the gradients of their negative sum.

    ``each``, if given, gets (cell, its W gradient, its w gradient) as they come, for the broad cells that have targets.
    """
    cells, per_cell = m["w"].shape
    broad, classes = len(m["W"]), len(m["c"])
    cell, inner = y // per_cell, y % per_cell
    group = tops(cells, broad)[cell]
    found = np.empty(len(y), np.float32)
    ones = np.ones(max(classes, per_cell, _BLOCK), np.float32)
    if grad:
        back, CT = np.empty_like(h), np.ascontiguousarray(m["C"].T)
        g = {"C": np.zeros_like(m["C"]), "c": np.zeros_like(m["c"])}
        if each is None:
            g |= {k: np.zeros_like(m[k]) for k in ("W", "w")}
    for start in range(0, len(y), _BLOCK):
        part = slice(start, start + _BLOCK)
        target = group[part]
        row = np.arange(len(target))
        p = h[part] @ m["C"]
        p += m["c"]
        np.minimum(p, _MOST_LOGIT, out=p)
        hit = p[row, target]
        np.exp(p, out=p)
        total = p @ ones[:classes]
        found[part] = hit - np.log(total)
        if grad:
            p *= np.reciprocal(total)[:, None]
            p[row, target] -= 1
            back[part] = p @ CT
            g["C"] += h[part].T @ p
            g["c"] += ones[: len(target)] @ p
    plain = cells - broad
    fixed = cell < plain
    found[fixed] += m["w"][cell[fixed], inner[fixed]]
    order = np.argsort(cell, kind="stable")[int(fixed.sum()) :]
    cuts = np.searchsorted(cell[order], np.arange(plain, cells + 1)).tolist()
    states, inner = h[order], inner[order]
    more = np.empty(len(order), np.float32)
    if grad:
        pull = np.zeros_like(states)
    for k in range(broad):
        a, b = cuts[k], cuts[k + 1]
        if a == b:
            continue
        q = states[a:b] @ m["W"][k]
        q += m["w"][plain + k]
        np.minimum(q, _MOST_LOGIT, out=q)
        pick = np.arange(b - a)
        hit = q[pick, inner[a:b]]
        np.exp(q, out=q)
        total = q @ ones[:per_cell]
        more[a:b] = hit - np.log(total)
        if grad:
            q *= np.reciprocal(total)[:, None]
            q[pick, inner[a:b]] -= 1
            np.matmul(q, m["W"][k].T, out=pull[a:b])
            found_here = states[a:b].T @ q, ones[: b - a] @ q if b - a <= len(ones) else q.sum(axis=0)
            if each is not None:
                each(k, *found_here)
            else:
                g["W"][k], g["w"][plain + k] = found_here
    found[order] += more
    if not grad:
        return found
    back[order] += pull
    return found, back, g


def _backward(m, x, fresh, saved, dout):
    steps, wide = x.shape
    H = HIDDEN
    zr, n, an, before = saved
    dgiven, da = np.empty((steps, wide, 3 * H), np.float32), np.empty((steps, wide, 3 * H), np.float32)
    UT = np.ascontiguousarray(m["U"].T)
    dh = np.zeros((wide, H), np.float32)
    for t in range(steps - 1, -1, -1):
        dh += dout[t]
        z, r = zr[t, :, :H], zr[t, :, H:]
        pre = dh * (1 - z) * (1 - n[t] ** 2)
        d = da[t]
        d[:, :H] = dh * (before[t] - n[t]) * z * (1 - z)
        d[:, H : 2 * H] = pre * an[t] * r * (1 - r)
        d[:, 2 * H :] = pre * r
        dgiven[t] = d
        dgiven[t, :, 2 * H :] = pre
        dh = dh * z + d @ UT
        if fresh[t].any():
            dh *= ~fresh[t][:, None]
    flat, given = da.reshape(-1, 3 * H), dgiven.reshape(-1, 3 * H)
    ids = x.ravel()
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    at = np.flatnonzero(np.concatenate(([True], sorted_ids[1:] != sorted_ids[:-1])))
    dwords = (given @ m["V"].T)[order]
    return before.reshape(-1, H).T @ flat, m["E"][ids].T @ given, sorted_ids[at], np.add.reduceat(dwords, at, axis=0)


def _entries(vocabulary: Vocabulary, batch: pa.RecordBatch):
    """(entries with an END after each text, bounds, word hashes, their frequent places, whether frequent, words before each text)."""
    hashes, counts = word_hashes(*text_bytes(batch.column("text")))
    at, there = vocabulary.find(hashes)
    inner = (vocabulary.bits(hashes) + OTHER).astype(np.int32)
    inner[there] = vocabulary.entries[at[there]]
    bounds = counts + np.arange(len(counts))
    entries = np.full(bounds[-1], END, np.int32)
    entries[np.arange(len(hashes)) + np.repeat(np.arange(len(counts) - 1), np.diff(counts))] = inner
    return entries, bounds, hashes, at, there, counts


def train_on(m, vocabulary: Vocabulary, batches: Iterator[pa.RecordBatch], rate: float) -> int:
    """Train ``m`` in place on the texts, in the order they come; returns the number of tokens.

    The few dense arrays have two moments for each number. What belongs to one word (its vector, its weights inside a
    class) is divided by the running root mean square of that word's gradients: one number a word, kept from the
    updates that touched it.
    """
    small = ("V", "U", "C", "c")
    first = {k: np.zeros_like(m[k]) for k in small}
    second = {k: np.zeros_like(m[k]) for k in small}
    broad, _, per_cell = m["W"].shape
    plain = len(m["w"]) - broad
    size = {"E": np.zeros(len(m["E"]), np.float32), "W": np.zeros((broad, per_cell), np.float32), "w": np.zeros((broad, per_cell), np.float32)}
    times = {"E": np.zeros(len(m["E"]), np.float32), "W": np.zeros(broad, np.float32)}
    tokens = step = 0

    def dense(name, grad):
        a, b = first[name], second[name]
        a += 0.1 * (grad - a)
        b += 0.01 * (grad**2 - b)
        m[name] -= warm * (a / (1 - 0.9 ** (step + 1))) / (np.sqrt(b / (1 - 0.99 ** (step + 1))) + 1e-6)

    def inside(k, grad, bias):
        times["W"][k] += 1
        keep = max(0.01, 1 / times["W"][k])
        b = size["W"][k]
        b += keep * (np.einsum("hp,hp->p", grad, grad) / len(grad) - b)
        grad *= -warm / (np.sqrt(b) + 1e-4)
        m["W"][k] += grad
        b = size["w"][k]
        b += keep * (bias**2 - b)
        m["w"][plain + k] -= warm * bias / (np.sqrt(b) + 1e-4)

    for batch in slices(batches, "text", _LANE_BYTES):
        entries, bounds, *_ = _entries(vocabulary, batch)
        x, y, fresh, live = stream_of(entries, bounds)
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        for t in range(0, len(x), WINDOW):
            part = slice(t, t + WINDOW)
            warm = np.float32(rate * min(1.0, (step + 1) / 20))
            out, h, saved = _forward(m, x[part], fresh[part], h, True)
            there = live[part]
            n = int(there.sum())
            if not n:
                break
            _, back, grads = _output(m, out[there], y[part][there], True, inside)
            dout = np.zeros_like(out)
            dout[there] = back
            dU, dV, rows, dE = _backward(m, x[part], fresh[part], saved, dout)
            for name, grad in (*grads.items(), ("U", dU), ("V", dV)):
                dense(name, grad / np.float32(n))
            times["E"][rows] += 1
            b = size["E"][rows]
            b += np.maximum(0.01, 1 / times["E"][rows]) * (np.einsum("rd,rd->r", dE, dE) / INPUT - b)
            size["E"][rows] = b
            m["E"][rows] -= (warm / (np.sqrt(b) + 1e-4))[:, None] * dE
            tokens += n
            step += 1
    return tokens


def log10_of(m, entries: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log10 probability of each text's entries."""
    x, y, text, length = lanes_of(entries, bounds, SCORE_LANES)
    total = np.zeros(len(bounds) - 1)
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    t = 0
    while t < len(x):
        wide = int((length > t).sum())
        # The few lanes of very long texts go on in longer windows.
        window = max(64, SCORE_LANES * 64 // wide)
        xs, ys, who = x[t : t + window, :wide], y[t : t + window, :wide], text[t : t + window, :wide]
        new = np.ones(who.shape, bool)
        new[1:] = who[1:] != who[:-1]
        new[0] = who[0] != text[t - 1, :wide] if t else True
        out, h, _ = _forward(m, xs, new, h[:wide], False)
        live = who >= 0
        found = _output(m, out[live], ys[live], False)
        total += np.bincount(who[live], found.astype(np.float64), len(total))
        t += window
    return total / np.log(10)


def _flat(m) -> np.ndarray:
    return np.concatenate([m[k].ravel() for k in sorted(m)])


def _shaped(flat: np.ndarray, like) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _average(parts: pd.DataFrame) -> pd.DataFrame:
    """The token-weighted mean of copies of one piece of what the network learned."""
    weight = parts["tokens"].to_numpy(np.float64)
    total = np.zeros(len(parts["values"].iloc[0]) // 2, np.float32)
    for v, w in zip(parts["values"], weight / max(weight.sum(), 1), strict=True):
        total += np.float32(w) * np.frombuffer(v, np.float16)
    return pd.DataFrame({"piece": parts["piece"].iloc[:1], "copy": parts["copy"].iloc[:1], "tokens": [int(weight.sum())], "values": [total.astype(np.float16).tobytes()]})


def train(rows: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, shares: int = SHARES) -> dict[str, np.ndarray]:
    """A network taught by ``rows`` (key, text); each round's copies are averaged in a tree of at most 64 a task.

    There are as many copies as the cores work on in two turns, not one for each split: a copy is as large as the
    vocabulary. A copy sends what it learned, in half precision. A round's files go when it is over.
    """
    m = start(vocabulary)
    context = rows.sparkSession.sparkContext
    copies = max(1, min(rows.rdd.getNumPartitions(), 2 * context.defaultParallelism))
    rows = rows.coalesce(copies)
    with short_shuffles(rows.sparkSession):
        return _taught(rows, vocabulary, m, copies, rounds, shares)


def _taught(rows: DataFrame, vocabulary: Vocabulary, m: dict, copies: int, rounds: int, shares: int) -> dict[str, np.ndarray]:
    schema = "piece int, copy int, tokens bigint, values binary"
    for r in range(rounds):
        rate = STEP * (0.5**r)

        def teach(batches: Iterator[pa.RecordBatch], m=m, rate=rate) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            own = {k: v.copy() for k, v in m.items()}
            tokens = train_on(own, vocabulary, batches, rate)
            if tokens:
                for k in own:
                    own[k] -= m[k]
                task = TaskContext.get().partitionId()
                for n, piece in enumerate(np.array_split(_flat(own), _SHARES_OF_MODEL)):
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([task], pa.int32()), pa.array([tokens]), pa.array([piece.astype(np.float16).tobytes()], pa.binary())], ["piece", "copy", "tokens", "values"])

        taught = rows.where(F.pmod(F.xxhash64("key"), F.lit(shares)) == r).select("text").mapInArrow(teach, schema)
        left = copies
        while left > 1:
            left = (left + 63) // 64
            taught = taught.withColumn("copy", F.col("copy") % left).groupBy("piece", "copy").applyInPandas(_average, schema)
        flat = _flat(m)
        for x, part in zip(sorted(taught.collect()), np.array_split(flat, _SHARES_OF_MODEL), strict=False):
            part += np.frombuffer(x["values"], np.float16)
        m = _shaped(flat, m)
    return m


def held_out(doc_id):
    """Rows that never teach the model."""
    return crc_rest(doc_id, 10) == 0


def lm_scores(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is an empty one: its only token is the end. A null id is taught from and scored as the text "".
    Rows that repeat are each counted and scored. Without training rows the counts are zero and every token is
    unknown. An empty table gives an empty result; other columns are not looked at.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out(F.col(doc_id)).alias("held_out"))
    taught = rows.where("not held_out")
    counts = taught.select("text").mapInArrow(_count, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c"))
    counts = stored(counts, "counts")
    facts = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    ends = taught.count()
    total, distinct = (facts[0] or 0) + ends, facts[1] + (1 if ends else 0)
    # At most HEAD words.
    head = counts.orderBy(F.desc("c"), "word").limit(HEAD).toPandas()
    words, seen = head["word"].to_numpy(np.int64).view(np.uint64), head["c"].to_numpy(np.int64)
    own, shares = sizes(seen, total - ends)
    # A row for each shared entry, HEAD / 4 at most.
    bits = counts.groupBy(F.col("word").bitwiseAND(F.lit(shares - 1)).alias("bits")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).toPandas()
    shared = np.zeros((shares, 2), np.int64)
    shared[bits["bits"].to_numpy(np.int64)] = bits[["c", "n"]].to_numpy(np.int64)
    vocabulary = Vocabulary(words, seen, ends, total, distinct, own, shared)
    m = train(taught.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text"), vocabulary)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smooth = np.log10(vocabulary.counts + SMOOTH)
        for batch in slices(batches, "text", _LANE_BYTES):
            entries, bounds, hashes, at, there, counts = _entries(vocabulary, batch)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(counts))
            n = batch.num_rows
            head_log = np.bincount(owner[there], smooth[at[there]], n) if there.any() else np.zeros(n)
            outer = there & (vocabulary.entries[at] < vocabulary.first) if len(vocabulary.entries) else there
            outer_log = np.bincount(owner[outer], smooth[at[outer]], n) if outer.any() else np.zeros(n)
            sharing = ~there | outer
            outside = np.bincount(owner[sharing], vocabulary.outside[vocabulary.bits(hashes[sharing])], n)
            rest = np.flatnonzero(~there)
            offsets = np.searchsorted(rest, counts).astype(np.int32)
            tail = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[rest].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(counts) + 1), pa.array(np.bincount(owner[there], minlength=n)),
                 pa.array(head_log), pa.array(log10_of(m, entries, bounds) + outer_log - outside), tail],
                ["doc_id", "held_out", "n_tokens", "head", "head_log", "inner", "tail"])

    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, head bigint, head_log double, inner double, tail array<bigint>"
    scores = stored(rows.mapInArrow(scored, schema).withColumn("row", F.monotonically_increasing_id()), "scores")
    rare = scores.select("row", F.explode("tail").alias("word"))
    rare = rare.join(counts, "word", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("rare_log"), F.count("c").alias("rare"))
    end_log = float(np.log10(ends + SMOOTH))
    whole = scores.drop("tail").join(rare, "row", "left").fillna({"rare_log": 0.0, "rare": 0})
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("head") + F.col("rare") + (1 if ends else 0)).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("head_log") + F.col("rare_log") + end_log - F.col("n_tokens") * float(vocabulary.whole)).alias("base_score"),
        (F.col("inner") + F.col("rare_log")).alias("score"))
