"""Edge rows, brute force and round trips for every operator."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dugout.llm import ann, bpe, chat, exact, langid, layout, lm, packing, quality, setjoin
from dugout.llm.common import stored, text_bytes
from dugout.llm.queries import tokenizer_ranks
from dugout.llm.words import shingle_sets

LONG = " ".join(f"w{i % 97}" for i in range(30_000))
#: Nulls, empty and blank texts, case, ties, repeated rows, a repeated id, a very long text; columns with clashing names.
EDGE = [
    (1, "The same text here now", "en", "a", 1), (2, "THE SAME text here now", "en", "a", 1), (3, None, "en", None, None), (4, "", None, "b", 0),
    (5, " \t\n ", "en", "b", 1), (None, "no id at all in this row", "de", "b", 1), (6, "two words", "de", "c", 2), (6, "two words", "de", "c", 2),
    (6, "another text under the same id as before", "de", "c", 2), (7, LONG, "en", "c", 3), (8, "ÄÖÜ ß élan 日本語   🙂", "fr", "c", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, score double, ids string, bucket int, digest string, hash string, n int"


def documents(spark, rows):
    return spark.createDataFrame([(*r[:4], *([None] * 6)) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def edge(spark):
    return documents(spark, EDGE)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return fold(text).encode().split()


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_exact(edge, none):
    got = sorted(map(tuple, exact.exact_duplicates(edge, keep="largest").collect()), key=str)
    groups = {}
    for r in EDGE:
        groups.setdefault(fold(r[1]), []).append(r[0])
    want = []
    for r in EDGE:
        ids = [i for i in groups[fold(r[1])] if i is not None]
        keep = max(ids, default=None)
        want.append((r[0], keep, len(groups[fold(r[1])]), r[0] == keep, hashlib.sha256(fold(r[1]).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert exact.exact_duplicates(none).count() == 0
    kept = exact.drop_exact_duplicates(edge)
    assert kept.columns == edge.columns
    assert sorted(fold(r.text) for r in kept.collect()) == sorted(groups)


def test_exact_keeps_texts_of_one_hash_apart(edge):
    alike = exact.exact_duplicates(edge, hasher=lambda c: F.lit("same"))
    assert sorted(map(tuple, alike.collect()), key=str) == sorted(map(tuple, exact.exact_duplicates(edge).collect()), key=str)


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def test_set_join(spark, none, monkeypatch):
    monkeypatch.setattr(setjoin, "GROUP", 8)
    monkeypatch.setattr(setjoin, "QUERIES", 5)
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passages, bases = [some(60) for _ in range(2)], [some(120) for _ in range(4)]
    rows = [(x[0], x[1]) for x in EDGE]
    for i in range(10, 190):
        kind = r.random()
        if kind < 0.5:
            text = list(r.choice(bases))
            for _ in range(r.randint(0, 5)):
                text[r.randrange(len(text))] = r.choice(vocabulary)
        elif kind < 0.8:
            text = some(r.randint(0, 22)) + r.choice(passages) + some(r.randint(0, 8))
        else:
            text = some(r.randint(0, 80))
        rows.append((i, " ".join(text)))
    docs = documents(spark, [(*x, None, None) for x in rows]).repartition(5)
    assert sorted(map(tuple, setjoin.similar_sets(docs).collect()), key=str) == brute(rows)
    assert setjoin.drop_similar(none).columns == none.columns


def test_groups_of_one_text_do_not_all_meet(spark, monkeypatch):
    """Copies of one text, few of them linked and spread over many groups, meet in a number in proportion to them."""
    r = random.Random(8)
    base = [[f"w{i}{v}" for v in ("", "x", "y")] for i in range(60)]
    rows = sorted({" ".join(r.choice(base[i]) if i % 7 == 3 else base[i][0] for i in range(60)) for _ in range(240)})
    rows = list(enumerate(rows))
    seen = []

    def counted(df, name):
        out = stored(df, name)
        seen.extend([out.count()] * (name == "meets"))
        return out

    monkeypatch.setattr(setjoin, "stored", counted)
    docs = documents(spark, [(*x, None, None) for x in rows]).repartition(5)
    assert sorted(map(tuple, setjoin.similar_sets(docs).collect()), key=str) == brute(rows)
    assert max(seen) <= len(rows) // 8


def test_stages_decide_by_id_and_text(spark, monkeypatch):
    import corpus_pipeline

    r = random.Random(5)
    some = lambda n: " ".join(f"w{r.randrange(4000)}" for _ in range(n))
    base, other = some(80), some(80)
    # Near copies of one base: without an id, under one id, and under the smallest of their ids.
    rows = [(None, base + " x"), (None, base + " y"), (5, base + " z"), (5, base + " q"), (4, base)]
    rows += [(None, some(60)), (5, some(60)), (None, other + " x"), (None, other + " y"), (7, ""), (7, None), (None, None)]
    kept = setjoin.drop_similar(documents(spark, [(*x, "en", None) for x in rows])).collect()
    assert sum((x.text or "").startswith(other) for x in kept) == 1
    want = [x for x in rows if not (x[1] or "").startswith((base, other))] + [(4, base)]
    assert sorted(((x.doc_id, x.text) for x in kept if not (x.text or "").startswith(other)), key=str) == sorted(want, key=str)
    same = setjoin.drop_similar(documents(spark, [(6, base + " x", None, None), (6, base + " y", None, None)])).collect()
    assert len(same) == 1

    en, de, junk = "the cat sat on the mat and then went home ", "der hund lief durch den wald und dann nach haus ", "qzx wvk jjq zzx qwv xkq vvz kqj xzw"
    rows = [(i if i > 9 else None if i > 4 else 3, (en if i % 2 else de) + str(i), "en" if i % 2 else "de", None) for i in range(40)]
    rows += [(None, junk, None, None), (3, junk, None, None)]
    docs = documents(spark, rows)
    kept = corpus_pipeline.known_language(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == sorted(((x[0], x[1]) for x in rows if x[1] != junk), key=str)


def test_stages_keep_columns_of_any_name(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(quality, "train", lambda *a: quality.fit(np.zeros((0, len(quality.STATISTICS))), np.zeros(0)))
    monkeypatch.setattr(corpus_pipeline, "table", lambda *a: spark.createDataFrame([], "doc_id long, quality int"))
    names = ["_score", "score", "_key", "KEY", "_gone", "gone", "_sha", "sha", "__hash", "__norm", "n_tokens", "bucket", "place"]
    docs = spark.createDataFrame([(1, "one text of some words here", "en", "s"), (2, None, "en", None), (None, "", "en", "s")], "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({n: F.lit(n) for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (docs, docs.limit(0)):
            kept = stage(spark, rows, "")
            assert kept.columns == docs.columns
            assert all(r[n] == n for r in kept.collect() for n in names)
    sizes = corpus_pipeline.packed(spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in sizes) == [("1", 6), ("2", 0), ("None", 0)]


def test_shingles_of_chunks():
    texts = [LONG, "a b c", "", "A  B\tc d\x0be", "x" * 3_000_000 + " y z u v w"]
    got = shingle_sets(*text_bytes(pa.array(texts)))
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    assert shingle_sets(*text_bytes(pa.array(["a b c d e"])))[0] == got[3]


def test_bpe(edge, none):
    import tiktoken

    ranks, pattern = tokenizer_ranks()
    tokens = bpe.read_ranks(ranks)
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rows = bpe.decode(bpe.encode(edge, ranks, pattern), ranks).collect()
    for r in rows:
        assert list(memoryview(bytes(r.ids)).cast("I")) == other.encode_ordinary(r.text or "")
        assert bytes(r.decoded).decode() == (r.text or "")
    assert bpe.encode(none, ranks, pattern).count() == 0


def test_bpe_code_points():
    import tiktoken

    ranks, pattern = tokenizer_ranks()
    tokens = bpe.read_ranks(ranks)
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    encode = bpe.Encoder(bpe.model_of(tokens), tokens, pattern)
    for first in range(0, 0x3000, 64):
        text = "".join(f"a{chr(c)} b{chr(c) * 2}  1" for c in range(first, first + 64))
        assert list(memoryview(encode(text)).cast("I")) == other.encode_ordinary(text)


def test_packing(edge, none):
    rows = packing.pack(edge, packing.word_count(F.col("text")), budget=64).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == sorted((x[0] or 0, len(words(x[1]))) for x in EDGE if x[0] != 8) + [(8, len(EDGE[-1][1].split(" ")))]
    batches = {}
    for r in rows:
        batches.setdefault(r.batch_id, []).append(r)
    for held in batches.values():
        assert sorted(r.slot for r in held) == list(range(len(held))) and len(held) <= held[0].capacity
        assert all(r.n_tokens <= r.boundary for r in held)
        assert len(held) == 1 or len(held) * held[0].boundary <= 64
    assert packing.pack(none, packing.word_count(F.col("text"))).count() == 0


def test_boundaries_are_best():
    from itertools import combinations

    r = random.Random(1)
    for _ in range(20):
        lengths = sorted(r.sample(range(1, 60), 8))
        counts = [r.randint(1, 9) for _ in lengths]
        cost = lambda edges: sum(c * min(e for e in edges if e >= n) for n, c in zip(lengths, counts, strict=True))
        best = min(cost((*some, lengths[-1])) for some in combinations(lengths[:-1], 2))
        assert cost(packing.boundaries(np.array(lengths), np.array(counts), 3)) == best


def _every_boundary(lengths, counts, buckets):
    """Least padded length and its boundaries by trying every predecessor; the first of equal ones, fewest buckets first."""
    n, upto = len(lengths), np.concatenate(([0], np.cumsum(counts))).tolist()
    best, found = {0: (0, [])}, []
    for _ in range(min(buckets, n)):
        best = {
            j: min(((best[i][0] + lengths[j - 1] * (upto[j] - upto[i]), i) for i in range(j) if i in best), default=None) and
            (lambda c, i: (c, best[i][1] + [lengths[j - 1]]))(*min((best[i][0] + lengths[j - 1] * (upto[j] - upto[i]), i) for i in range(j) if i in best))
            for j in range(1, n + 1) if any(i in best for i in range(j))}
        if n in best:
            found.append(best[n])
    return min(found, key=lambda f: f[0])[1]


@pytest.mark.parametrize("most", [9, 60, 20_000, 10**9])
def test_boundaries_of_any_length(most):
    r = random.Random(most)
    for buckets in (1, 2, 5, 8):
        for kinds in (1, 3, 40, 160):
            lengths = sorted(r.sample(range(most + 1), min(kinds, most)))
            counts = [r.choice((1, 1, 2, 5, 1000)) for _ in lengths]
            mixed = list(zip(lengths, counts, strict=True))
            r.shuffle(mixed)
            got = packing.boundaries(np.array([m[0] for m in mixed]), np.array([m[1] for m in mixed]), buckets)
            assert got == _every_boundary(lengths, counts, buckets)


def test_quality(spark, edge, none):
    r = random.Random(2)
    good = [(i, " ".join(r.choice("abcdefgh") * r.randint(2, 6) for _ in range(40)) + ".", "en", "s") for i in range(150)]
    bad = [(i, " ".join(r.choice("ABCDEFGH") * r.randint(2, 6) + "!!" for _ in range(40)), "en", "s") for i in range(150, 300)]
    docs = documents(spark, good + bad)
    labels = docs.select("doc_id", (F.col("doc_id") < 150).cast("int").alias("label"))
    odd = spark.createDataFrame([(None, 1), (5, None), (3, 7)], "doc_id long, label int")
    model = quality.train(docs, labels.where(~quality.held_out(F.col("doc_id"))).unionByName(odd))
    rows = quality.score(docs, model).where(quality.held_out(F.col("doc_id"))).collect()
    assert sum((x.score >= 0.5) == (x.doc_id < 150) for x in rows) >= 0.97 * len(rows)
    scored = quality.score(edge, model)
    assert scored.columns == [c for c in edge.columns if c != "score"] + ["score"]
    assert all(0 <= x.score <= 1 for x in scored.collect()) and quality.score(none, model).count() == 0
    assert quality.predict(quality.fit(np.zeros((0, 3)), np.zeros(0)), np.zeros((2, 3))) == pytest.approx([0.5, 0.5])


def test_quality_takes_a_bounded_number_of_rows(spark, monkeypatch):
    docs = spark.range(500).select(F.lit(1).alias("doc_id"), F.concat(F.lit("row "), "id").alias("text"), F.lit(None).cast("long").alias("place"))
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(x.shape))
    quality.train(docs, docs.limit(1).select("doc_id", F.lit(1).alias("label")), sample_rows=40)
    quality.train(docs.limit(0), docs.limit(1).select("doc_id", F.lit(1).alias("label")), sample_rows=40)
    assert [n for n, _ in seen] == [40, 0]


def test_language_model_is_a_distribution():
    hashes = np.arange(1, 3000, dtype=np.uint64)
    v = lm.Vocabulary(hashes, np.arange(len(hashes), 0, -1, dtype=np.int64), 50, int(sum(range(len(hashes) + 1))) + 50, len(hashes) + 1)
    m = lm.start(v)
    rng = np.random.default_rng(0)
    m["C"] += rng.normal(0, 1, m["C"].shape).astype(np.float32)
    m["W"] += rng.normal(0, 1, m["W"].shape).astype(np.float32)
    h = np.repeat(rng.normal(0, 1, (1, lm.HIDDEN)).astype(np.float32), lm.CLASSES * lm.PER_CLASS, axis=0)
    assert np.exp(lm._output(m, h, np.arange(len(h)), False).astype(float)).sum() == pytest.approx(1, abs=1e-4)
    # One text scored whole, and scored among others in few lanes, has one score.
    texts = [np.array([5, 9, 1, 7] * 40 + [0], np.int32), np.array([3, 0], np.int32), np.array([0], np.int32)]
    alone = [lm.log10_of(m, t, np.array([0, len(t)]))[0] for t in texts]
    together = lm.log10_of(m, np.concatenate(texts), np.cumsum([0] + [len(t) for t in texts]))
    assert together == pytest.approx(alone, rel=1e-5)


def test_language_model_gradients(monkeypatch):
    v = lm.Vocabulary(np.arange(1, 9, dtype=np.uint64), np.arange(9, 1, -1, dtype=np.int64), 4, 60, 9)
    m = {k: x.astype(np.float64) for k, x in lm.start(v).items()}
    rng = np.random.default_rng(1)
    m = {k: x + rng.normal(0, 0.1, x.shape) for k, x in m.items()}
    x, y = rng.integers(0, 8, (6, 3)), rng.integers(0, 8, (6, 3))
    fresh = np.zeros((6, 3), bool)
    fresh[0] = True
    fresh[3, 1] = True
    f32 = lambda: {k: a.astype(np.float32) for k, a in m.items()}
    loss = lambda: -lm._output(f32(), lm._forward(f32(), x, fresh, np.zeros((3, lm.HIDDEN), np.float32), False)[0].reshape(-1, lm.HIDDEN), y.ravel(), False).astype(float).sum()
    out, _, saved = lm._forward(f32(), x, fresh, np.zeros((3, lm.HIDDEN), np.float32), True)
    _, back, grads = lm._output(f32(), out.reshape(-1, lm.HIDDEN), y.ravel(), True)
    dU, dV, rows, dE = lm._backward(f32(), x, fresh, saved, back.reshape(out.shape))
    dense = np.zeros_like(m["E"])
    dense[rows] = dE
    for name, grad in (("U", dU), ("V", dV), ("E", dense), ("C", grads["C"]), ("c", grads["c"]), ("W", grads["W"]), ("w", grads["w"])):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old = m[name][at]
        m[name][at] = old + 1e-2
        up = loss()
        m[name][at] = old - 1e-2
        down = loss()
        m[name][at] = old
        assert (up - down) / 2e-2 == pytest.approx(float(grad[at]), rel=0.03)


def test_language_model_plain_classes():
    # More cells than have a softmax of their own: the others share classes, and all words still add up to one.
    words = 9000
    counts = 40 + np.arange(words, 0, -1, dtype=np.int64)
    v = lm.Vocabulary(np.arange(1, words + 1, dtype=np.uint64), counts, 50, int(counts.sum()) + 50, words + 1, words)
    m = lm.start(v)
    top = lm.tops(v.shape[0], lm.BROAD)
    assert v.shape[0] > lm.BROAD + lm.PLAIN and len(m["c"]) == lm.BROAD + lm.PLAIN and (np.diff(top) >= 0).all()
    rng = np.random.default_rng(2)
    m = {k: x if k == "w" else x + rng.normal(0, 0.3, x.shape).astype(np.float32) for k, x in m.items()}
    h = np.repeat(rng.normal(0, 1, (1, lm.HIDDEN)).astype(np.float32), v.shape[0] * v.shape[1], axis=0)
    assert np.exp(lm._output(m, h, np.arange(len(h)), False).astype(float)).sum() == pytest.approx(1, abs=1e-3)
    # Inside a plain class, context leaves the ratio of two words as counted.
    a, b = v.entries[-1], v.entries[-2]
    assert a // v.shape[1] < v.shape[0] - lm.BROAD
    p = np.exp(lm._output(m, h[:2], np.array([a, b]), False).astype(float))
    assert p[0] / p[1] == pytest.approx((counts[-1] + lm.SMOOTH) / (counts[-2] + lm.SMOOTH), rel=1e-3)


def test_language_model_stream():
    sizes = np.array([3, 1, 4000, 2, 700, 1])
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    entries = np.arange(1, bounds[-1] + 1).astype(np.int32)
    entries[bounds[1:] - 1] = lm.END
    x, y, fresh, live = lm.stream_of(entries, bounds)
    back = lambda a: a.T.ravel()[: len(entries)]
    assert live.sum() == len(entries) and back(live).all()
    assert (back(y) == entries).all()
    assert (np.flatnonzero(back(fresh)) == bounds[:-1]).all()
    assert (back(x)[bounds[:-1]] == lm.END).all()
    rest = np.setdiff1d(np.arange(len(entries)), bounds[:-1])
    assert (back(x)[rest] == entries[rest - 1]).all()


def test_language_model_counts(spark, edge, none):
    rows = lm.lm_scores(edge).collect()
    import zlib
    from collections import Counter

    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    c = Counter()
    for x in EDGE:
        if not held(x[0]):
            c.update(words(x[1]))
            c["end"] += 1
    total, distinct = sum(c.values()), len(c)
    want = []
    for x in EDGE:
        t = [*words(x[1]), "end"]
        want.append((x[0], held(x[0]), len(t), sum(c[w] > 0 for w in t), total, round(sum(np.log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t), 5)))
    assert sorted(((*tuple(r)[:5], round(r.base_score, 5)) for r in rows), key=str) == sorted(want, key=str)
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)
    assert lm.lm_scores(none).count() == 0


def test_language_model_knows_every_word(spark, monkeypatch):
    # 3,000 words seen 40 times, 9,000 seen twice: all of the first have entries of their own, the others share many.
    texts = [" ".join(f"often{i}" for i in range(a, 3000, 40)) for a in range(40)] * 40 + [" ".join(f"rare{i}" for i in range(a, 9000, 40)) for a in range(40)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(lm, "held_out", lambda _: F.lit(False))
    seen = []
    monkeypatch.setattr(lm, "train", lambda rows, v: seen.append(v) or lm.start(v))
    rows = lm.lm_scores(docs).collect()
    v = seen[0]
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(f"often{i}" for i in range(3000)), " ".join(f"rare{i}" for i in range(9000))])], ["text"])
    entries, bounds, *_ = lm._entries(v, batch)
    assert len(set(entries[:3000].tolist())) == 3000
    rare = entries[bounds[1] : bounds[2] - 1]
    assert len(set(rare.tolist())) > 100 and not set(rare.tolist()) & set(entries[:3000].tolist())
    # The words of a shared entry, and one unseen, share it whole.
    for entry in set(rare.tolist()):
        assert (rare == entry).sum() * (2 + lm.SMOOTH) + lm.SMOOTH == pytest.approx(10 ** v.outside[entry - lm.OTHER])
    m = lm.start(v)
    assert np.exp(lm._output(m, np.zeros((v.shape[0] * v.shape[1], lm.HIDDEN), np.float32), np.arange(v.shape[0] * v.shape[1]), False).astype(float)).sum() == pytest.approx(1, abs=1e-3)
    # The untaught network gives every word its counted share, so its score is the counts' own.
    assert all(r.score == pytest.approx(r.base_score, rel=0.01) for r in rows)


def test_language_model_learns_from_every_row(spark):
    v = lm.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1, 1, 1)
    rows = spark.createDataFrame([(str(i), "") for i in range(300)], "key string, text string").repartition(2)
    m = lm.start(v)
    for part in range(8):
        # Rows of each eighth alone change the network.
        found = lm.train(rows.where(F.pmod(F.xxhash64("key"), F.lit(8)) == part), v)
        assert not np.array_equal(found["c"], m["c"]), part


def test_language_id(spark, edge, none):
    en, de = "the cat sat on the mat and then went home ", "der hund lief durch den wald und dann nach haus "
    docs = spark.createDataFrame([(i, en if i % 2 else de, "en" if i % 2 else "de") for i in range(40)] + [(98, "x", None), (99, None, "en")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    pages = spark.createDataFrame(
        [(1, en, "en", "http://www.a.example.org/x"), (2, de, None, "https://u@b.example.de:80/"), (3, None, "de", "http://b.example.de"), (4, "", None, None),
         (5, "1234 5678", None, "junk"), (6, en, "de", "http://a.example.org"), (None, "qzx wvk jjq zzx qwv xkq vvz kqj xzw", None, None)],
        "page_id long, text string, declared string, url string")
    found = {r.page_id: r for r in langid.identify(pages, model, "page_id", "text", F.col("declared"), langid.host_of(F.col("url"))).collect()}
    assert (found[1].lang, found[2].lang, found[3].lang, found[6].lang) == ("en", "de", "de", "en")
    assert found[None].text_lang == "und" and found[4].text_lang is None and found[2].host == "b.example.de"
    assert langid.identify(none, model, "doc_id", "text", F.col("lang"), F.col("source")).count() == 0
    assert langid.identify(edge, model, "doc_id", "text", F.col("lang"), F.col("source")).count() == len(EDGE)


def test_language_id_learns_every_label(spark, monkeypatch):
    r = random.Random(7)
    letters = {f"l{k:02}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for k in range(80)}
    # The last label is the rarest; all others have two rows.
    rows = [(i, " ".join(r.sample(words, 12)), name) for i in range(2) for name, words in letters.items() if i == 0 or name != "l79"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model["languages"] == [*letters, "und"]
    some = spark.createDataFrame([(1, " ".join(letters["l79"])), (2, " ".join(letters["l03"]))], "doc_id long, text string")
    found = langid.identify(some, model, "doc_id", "text", F.lit(None).cast("string"), F.lit(None).cast("string")).collect()
    assert {x.doc_id: x.lang for x in found} == {1: "l79", 2: "l03"}
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 79)
    with pytest.raises(ValueError, match="more than 79"):
        langid.train(docs)


def test_layout(spark):
    assert layout.render("<p>a<p>b <b>c</b>d<ul><li>x<li>y<ol start=3><li>p<li>q</ol><li>z</ul>") == "a\n\nb cd\n\n- x\n- y\n  3. p\n  4. q\n- z"
    assert layout.render("<table><tr><td>1<td>long cell<tr><td>twenty<td>3</table>") == "1       long cell\ntwenty  3"
    assert layout.render("<title>t</title><script>if(a<b)</script>x<div hidden>no</div><i style='display: none'>no</i><!-- no -->y &amp; z<br>u") == "xy & z\nu"
    assert layout.render("<pre>\n a\n  b</pre>c") == " a\n  b\n\nc"
    assert layout.render("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"
    assert layout.render("a < b <'\"> c </p></nothing> d <") .startswith("a < b")
    rows = spark.createDataFrame([(1, None, "old"), (2, "", None), (3, "<p>x", "y")], "page_id long, html string, text string")
    assert [(r.page_id, r.text) for r in layout.extract(rows).orderBy("page_id").collect()] == [(1, None), (2, ""), (3, "x")]


def test_layout_keeps_text_outside_cells():
    assert layout.render("<table><tr>note<td>x</table>") == "note\nx"
    assert layout.render("<table><tbody><div>above</div><tr><td>x<td>y</table>z") == "above\nx  y\n\nz"
    assert layout.render("<table><thead>h<tr><th>a</thead><tfoot><p>foot</p><tr hidden>no<td>no</table>") == "h\n\nfoot\n\na"
    assert layout.render("<table><colgroup><col><tr><td>x</table>") == "x"
    assert layout.render("<table><colgroup><col><td>x<td>y</table>") == "x  y"
    assert layout.render("<table><colgroup><col><tbody><tr><td>x</table>") == "x"
    assert layout.render("<table><colgroup><b>text</b><col></colgroup><tr><td>x</table>") == "text\nx"
    assert layout.render("<div><svg/>shown</div>") == layout.render("<div><math a='b=c'/>shown</div>") == "shown"
    assert layout.render("<svg width=10/>not shown</svg>shown") == layout.render("<svg>no<svg/>no</svg>shown") == "shown"
    assert layout.render("<div>" * 300 + "<svg/>deep<table><tr><td>cell") == "deep\n\ncell"


def test_layout_visibility_depth_and_spans():
    assert layout.render("İ" * 20 + "<script>x</script>abc<b>def</b> ghi") == "İ" * 20 + "abcdef ghi"
    assert layout.render("İ<STYLE>p{}</ſtyle>no</Style><p>next</p>") == "İ\n\nnext"
    assert layout.render("<div style='visibility:hidden'>a<b style='visibility: visible'>B</b>c<hr><img alt=no></div>d") == "B\nd"
    assert layout.render("<div style='display:none'>a<b style='visibility:visible;display:block'>B</b></div>d") == "d"
    assert layout.render("<pre style='visibility:hidden'>a<i style='visibility:visible'>b</i>c</pre>") == "b"
    assert layout.render("<table><tr><td style='visibility:hidden'>wide<td>x<tr style='visibility:hidden'><td>no<td style='visibility:visible'>y</table>") == "  x\n  y"
    inside = "<p hidden>secret</p><noscript>nos</noscript><span style='display:none'>x</span>shown"
    assert layout.render("<div>" * 250 + inside) == layout.render("<b><div>" * 50_000 + inside) == "shown"
    assert layout.render("<table><tr><th colspan=2>ab<th>c<tr><td>1<td>2222<td>3</table>") == "ab       c\n1  2222  3"
    assert layout.render("<table><tr><td rowspan=2>r<td>x<td>y<tr><td>p<td>q<tr><td>s</table>") == "r  x  y\n   p  q\ns"
    assert layout.render("<table><tr><td rowspan=0>r<td>x<tr><td colspan=x>p<tr><td>q</table>") == "r  x\n   p\n   q"
    # However deep tables, lists and quotes are nested, all their text shows.
    for page in ("<table><tr><td>t ", "<ul><li>t ", "<blockquote>t ", "<ol><li><table><td>t<td>t "):
        assert layout.render(page * 300).split().count("t") == 300 * page.count("t<") + 300 * page.count("t ")


def test_chat_trees(spark):
    rows = [("t", 1, None, 0.0, "user", "hi"), ("t", 2, 1, 1.0, "assistant", "a<b\\l"), ("t", 3, 1, 5.0, "assistant", "best"), ("t", 4, 3, 0.0, "user", None),
            ("t", 5, 2, 0.5, "user", "x"), ("t", 9, 77, None, None, "orphan"), ("c", 1, 2, 0.0, "user", "cycle"), ("c", 2, 1, 0.0, "user", "cycle"), ("t", None, 1, 0.0, "user", "no id")]
    rows += [("deep", i, i - 1 if i else None, 0.0, "assistant" if i % 2 else "user", f"turn {i} </turn>") for i in range(600)]
    messages = spark.createDataFrame(rows, "tree string, id long, parent long, score double, role string, text string")
    found = {(r.tree, r.branch): r for r in chat.read_back(chat.format_trees(messages, branches=3)).collect()}
    assert [[t.text for t in found["t", b].turns] for b in (1, 2, 3)] == [["hi", "best", ""], ["hi", "a<b\\l", "x"], ["orphan"]]
    assert [t.text for t in found["deep", 1].turns] == [f"turn {i} </turn>" for i in range(600)]
    assert found["deep", 1].learned_text == "".join(f"turn {i} </turn>" for i in range(1, 600, 2))
    deep = found["deep", 1]
    assert "".join(chat_unescape(deep.formatted[s.start : s.start + s.length]) for s in deep.loss) == deep.learned_text
    assert chat.format_trees(messages.limit(0)).count() == 0 and not any(t == "c" for t, _ in found)


def chat_unescape(text):
    return text.replace("\\l", "<").replace("\\e", "\\")


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (900, 16)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (None, x[0].tolist()), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16), (905, [1.0, 2.0]), (5, x[5].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    found = ann.nearest(table, 10, 20).toPandas()
    exact_ = x.astype(np.float64) @ x.astype(np.float64).T
    hit = 0
    for q in range(0, 900, 20):
        got = found[found.query_id == q].sort_values("rank")
        score = exact_[q].copy()
        score[q] = -np.inf
        best = np.lexsort((np.arange(900), -np.round(score, 9)))[:10]
        hit += len(set(best) & set(got.vec_id))
        assert got["rank"].tolist() == list(range(1, 11)) and got.score.tolist() == pytest.approx([exact_[q][v] for v in got.vec_id])
    assert hit >= 0.9 * 10 * 45
    # Equal vectors have equal products, so they come by id; a longer vector may stand before them.
    near = found[found.query_id == 100].sort_values("rank").vec_id.tolist()
    same = [v for v in near if 100 < v < 140]
    assert same == list(range(101, 101 + len(same))) and len(same) >= 8
    assert ann.nearest(table.limit(0), 10, 20).count() == 0
    # Products of long vectors are summed in another order for the floor than for the result; none may fall below it.
    rows = [(i, (v * 1e4).tolist()) for i, v in enumerate(rng.normal(0, 1, (400, 64)))]
    long = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 10, 20)
    assert long.groupBy("query_id").count().where("count = 10").count() == 20
    assert ann.nearest(table.where("vec_id in (0, 7)"), 10, 20).count() == 1
