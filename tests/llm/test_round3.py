"""Importance resampling, robust quality rules and hard negatives: edge rows and brute force; SQL of every query that has some."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from dugout.llm import hardneg, importance, outliers, queries, setjoin

from test_operators import EDGE, LONG, documents, fold

FOLDER = os.environ.get("DUGOUT_SF_DIR", "/root/testdata/sf0.001")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_crc_of_any_width():
    r = np.random.default_rng(1)
    for width in [*range(1, 12), 255, 256, 257, 600, 70_001]:
        rows = r.integers(1, 256, (3, width), dtype=np.uint8)
        assert importance.crc_rows(rows).tolist() == [zlib.crc32(x.tobytes()) for x in rows]


def resampled(rows, target, longest, buckets, percent, least):
    """(doc_id, words, features, weight, score) and the drawn ones in order, by plain loops."""

    def grams(text):
        w = re.findall(rb"[0-9a-z\x80-\xff]+", fold(text).encode())
        return w, [b" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    here, there = Counter(), Counter()
    for texts, count in ((rows, here), (target, there)):
        for _, text in texts:
            count.update(zlib.crc32(g) % buckets for g in grams(text)[1])
    s_all, t_all = sum(here.values()), sum(there.values())
    out = []
    for name, text in rows:
        w, f = grams(text)
        b = [zlib.crc32(g) % buckets for g in f]
        weight = sum(math.floor(1000 * math.log((there[x] + 1) * (s_all + buckets) / ((here[x] + 1) * (t_all + buckets)))) for x in b)
        h = int(hashlib.sha256(f"2024:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
        out.append((name, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    return out, able[: percent * len(able) // 100]


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (3, 97)])
def test_importance(spark, longest, buckets):
    r = random.Random(longest)
    pool = ["Straße", "über", "a1", "B", "日本", "x" * 700, *(f"w{i}" for i in range(60))]
    rows = [x[:2] for x in EDGE] + [(100 + i // 2 if i % 7 == 0 else 1000 + i, " - ".join(r.choices(pool, k=r.randint(0, 60)))) for i in range(300)]
    rows += [(7, LONG), (2000, rows[40][1]), (2000, rows[40][1])]
    target = [(0, None), (1, ""), (2, "w1 w2 w3 über"), (3, "w1 W1, straße!")]
    docs = documents(spark, [(*x, None, None) for x in rows]).repartition(7)
    got = importance.resample(docs, documents(spark, [(*x, None, None) for x in target]), carry=("text", "n"), longest=longest, buckets=buckets, percent=40, least_words=3)
    assert got.columns == ["doc_id", "text", "n", "n_words", "n_features", "weight", "score", "rank"]
    got = got.collect()
    want, drawn = resampled(rows, target, longest, buckets, 40, 3)
    assert sorted([(x.doc_id, x.n_words, x.n_features, x.weight, x.score) for x in got], key=str) == sorted(want, key=str)
    line = sorted((x for x in got if x["rank"] is not None), key=lambda x: x["rank"])
    assert [x["rank"] for x in line] == list(range(1, len(drawn) + 1))
    assert [(x.doc_id, x.n_words, x.n_features, x.weight, x.score) for x in line] == drawn
    assert {(x.doc_id, x.text) for x in got} == set(rows)


def test_importance_of_nothing(spark):
    none, some = documents(spark, []), documents(spark, EDGE)
    assert importance.resample(none, none).count() == 0
    assert importance.resample(none, some).count() == 0
    assert importance.resample(some, none).count() == len(EDGE)


def base(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    places, covered = defaultdict(list), set()
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    for at in places.values():
        for i in at if len(at) > 1 else ():
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(re.findall(r"[!\"'()+,\-./:;=?@\[\\\]^_`{}~]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered)


def verdicts(rows):
    """kept of each row, by numpy: the estimates of the module's note, group by group."""
    found, vectors = [], {}
    for at, (_, text, lang, source) in enumerate(rows):
        n, chars, symbols, marks, lines, dups, repeats = base(text)
        bad = n < 20 or 100 * repeats > 30 * n
        found.append(not bad)
        if not bad:
            v = [math.log(chars / n), math.sqrt(symbols / chars), math.sqrt(marks / chars), math.sqrt(dups / max(lines, 1)), math.sqrt(repeats / n)]
            vectors[at] = (lang or "", source or "", [math.floor(x * 1024 + 0.5) for x in v])
    sizes = Counter((x[0], x[1]) for x in vectors.values())
    pool = Counter()
    for (lang, _), n in sizes.items():
        pool[lang] += n if n < outliers.LEAST else 0
    rest = sum(n for n in pool.values() if n < outliers.LEAST)
    groups = defaultdict(list)
    for at, (lang, source, _) in vectors.items():
        if sizes[lang, source] >= outliers.LEAST:
            groups[lang, source].append(at)
        elif pool[lang] >= outliers.LEAST:
            groups[lang, None].append(at)
        elif rest >= outliers.LEAST:
            groups[None].append(at)
    floor = np.diag([(f * 1024) ** 2 for f in outliers.FLOORS])
    far = {}
    for members in groups.values():
        x = np.array([vectors[at][2] for at in members], float)

        def estimate(part):
            mean = part.mean(0)
            cov = part.T @ part / len(part) - np.outer(mean, mean) + floor
            return mean, np.linalg.inv(cov), np.linalg.slogdet(cov)[1]

        def squared(known, x=x):
            return np.einsum("ni,ij,nj->n", x - known[0], known[1], x - known[0])

        def step(known, x=x, squared=squared, estimate=estimate):
            bins = np.floor(np.log(1 + np.maximum(squared(known), 0)) * 100)
            return estimate(x[bins <= np.sort(bins)[math.ceil(0.75 * len(x)) - 1]])

        known = (np.median(x, 0), np.linalg.inv(floor), 0.0)
        for _ in range(outliers.EARLY):
            known = step(known)
        for _ in range(outliers.STEPS - outliers.EARLY):
            after = step(known)
            if not after[2] < known[2] - 1e-6:
                break
            known = after
        far |= dict(zip(members, squared(known) / outliers.CONSISTENT, strict=True))
    return [k and far.get(at, 0.0) <= outliers.CUT for at, k in enumerate(found)], far


def noisy(r, kind):
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 8))) for _ in range(r.randint(20, 90))]
    if kind == "symbols":
        words = [w + r.choice(["$$$", "%%%", "###"]) for w in words]
    if kind == "lines":
        return "\n".join([" ".join(words[:4])] * 4 + [" ".join(words[i : i + 6]) for i in range(0, len(words), 6)])
    return " ".join(words) + "."


def test_quality_rules(spark, monkeypatch):
    monkeypatch.setattr(outliers, "STARTS", 0)  # the plain path below has the medians alone
    r = random.Random(2)
    rows = list(EDGE and [x[:4] for x in EDGE])
    for i in range(400):
        kind = r.choices(["plain", "symbols", "lines"], [90, 6, 4])[0]
        rows.append((50 + i % 380, noisy(r, kind), r.choice(["en", "en", "de", None, "fr"]), r.choice(["a", "a", "b", None, f"rare{i}"])))
    rows += [(900, rows[30][1], "en", "a")] * 200
    got = outliers.quality_rules(documents(spark, [(*x, None) for x in rows]).repartition(6)).collect()
    want, _ = verdicts(rows)
    assert Counter((x.doc_id, *(x[s] for s in outliers.STATISTICS), x.kept) for x in got) == Counter((x[0], *base(x[1]), k) for x, k in zip(rows, want, strict=True))
    assert outliers.quality_rules(documents(spark, [])).count() == 0


def test_quality_rules_find_the_odd_ones(spark):
    r = random.Random(4)
    rows = [(i, noisy(r, "symbols" if i % 12 == 0 else "plain"), "en" if i % 3 else "de", "web") for i in range(600)]
    got = outliers.quality_rules(documents(spark, [(*x, None) for x in rows])).collect()
    assert {x.doc_id for x in got if not x.kept} == {x[0] for x in rows if x[0] % 12 == 0}


def test_statistics_of_odd_texts(spark):
    texts = [None, "", " \n\t\x0b", "a b c d e f g h a b c d e f g h", "x " * 30, "l\nl\n\n\n l\nl\r\nm", LONG, "á b   日本 #|<", "a b c d e f g h i " * 3 + "z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", outliers.statistics(outliers.F.col("t")).alias("s")).select("i", "s.*")
    assert [tuple(x)[1:] for x in sorted(df.collect())] == [base(t) for t in texts]


def mined(rows, every):
    """The rows of hard_negatives with its defaults, by plain loops over Python integers."""
    one = {}
    fine = [x for x in rows if x[0] is not None and x[2] is not None and x[1] and all(c is not None and math.isfinite(c) for c in x[1])]
    for name, v, label in fine:
        one[name] = min(one.get(name, (label, [math.floor(256 * c) for c in v])), (label, [math.floor(256 * c) for c in v]))
    widths = Counter(len(q) for _, q in one.values())
    width = max(widths, key=lambda w: (widths[w], w), default=0)
    one = {k: v for k, v in one.items() if len(v[1]) == width}
    out = []
    for a, (label, q) in one.items():
        if a % every:
            continue
        score = {b: sum(x * y for x, y in zip(q, p[1], strict=True)) for b, p in one.items() if b != a}
        line = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in line if one[b][0] == label][:5]:
            found = [b for b in line if one[b][0] != label and 80 * score[p] <= 100 * score[b] <= 100 * score[p]][:5]
            out += [(a, p, i + 1, b, score[p], score[b]) for i, b in enumerate(found)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("size", "scale"), [(20, 1.0), (1, 1.0), (6, 3e5), (6, 1e6)])
def test_hard_negatives(spark, monkeypatch, size, scale):
    monkeypatch.setattr(hardneg, "ROWS", 40)
    monkeypatch.setattr(hardneg, "ANCHORS", 4)
    r = random.Random(size)
    rows = [(i, [scale * r.gauss(0.4, 1) for _ in range(size)], r.randrange(4)) for i in range(300)]
    hot = rows[3][1]
    rows += [(1000 + i, hot, i % 2) for i in range(150)]  # a vector that a third of all rows hold
    rows += [(7, rows[1][1], 0), (8, rows[8][1], rows[8][2]), (None, hot, 1), (5000, None, 1), (5001, hot, None), (5002, [None] * size, 1)]
    rows += [(5010, [float("nan")] * size, 1), (5020, [float("inf")] * size, 1), (5030, [], 1), (5040, [1.0] * (size + 1), 1), (5050, [0.0] * size, 2)]
    df = spark.createDataFrame([(*x, 1, 1, 1) for x in rows], "vec_id long, embedding array<double>, label int, q int, anchor int, score int").repartition(5)
    assert rows_of(hardneg.hard_negatives(df, every=10)) == mined(rows, 10)


def test_hard_negatives_of_nothing_and_of_huge_numbers(spark):
    huge = spark.createDataFrame([(i, [1e300, -1e30, float(i)], i % 2) for i in range(40)], "vec_id long, embedding array<double>, label int")
    found = hardneg.hard_negatives(huge, every=10).collect()
    assert {x.positive_score for x in found} == {2**63 - 1}
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hardneg.hard_negatives(df).count() == 0


def test_products_of_any_size():
    r = random.Random(9)
    for span in (1, 100, 2**20, 2**31, 2**45):
        a, b = ([[r.randint(-span, span // 2) for _ in range(9)] for _ in range(n)] for n in (5, 23))
        got = hardneg.products(np.array(a), np.array(b))
        assert got.tolist() == [[sum(x * y for x, y in zip(p, q, strict=True)) for q in b] for p in a]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    ours, theirs = queries.ALL[name](spark, FOLDER), con.sql(queries.SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    got = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    assert Counter(map(str, map(tuple, ours.select(columns).collect()))) == Counter(map(str, got))


def test_texts_move_after_the_sieve(spark, monkeypatch):
    """No query holds both the shuffles of a sieve and those of the texts, or of the sets."""
    plans, real = [], setjoin.stored

    def noted(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(setjoin, "stored", noted)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:39])), (3, "a b c d e f g")], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in setjoin.similar_sets(docs).collect()} == {1: 1, 2: 1, 3: 3}
    sieves = [p for p in plans if "Window" in p and "told" in p]
    assert len(sieves) == 2 and not any("_whole_sets" in p or "key1" in p for p in sieves)


def test_sieve_tokens_are_never_stored(spark, monkeypatch):
    """Each sieve reads its sets once and moves their tokens straight away; what is crossing moves with its digest alone."""
    plans, columns, real = [], [], setjoin.stored

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        columns.extend(df.columns)
        return real(df, name)

    monkeypatch.setattr(setjoin, "stored", noted)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:39])), (3, "a b c d e f g"), (4, None)], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in setjoin.similar_sets(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert not {"lone", "told"} & set(columns)
    assert [p.count("_sieve(") for _, p in plans if "told" in p] == [1, 1]
    exploded = [line for name, p in plans if name == "crossing" for line in p.split("\n") if "Generate explode(tokens" in line]
    assert exploded and not any("rank" in line or "home" in line for line in exploded)
