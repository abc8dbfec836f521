"""Difference of two marts and mergeable thresholds against plain Python."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from dugout.operators import boards, differ

SCHEMA = "league STRING, day INT, game STRING, side STRING, lp INT, text STRING"


def test_difference(spark, monkeypatch):
    monkeypatch.setattr(differ, "BUCKETS", 4)
    r = random.Random(8)
    before = [("kbo", d, f"g{g}", s, r.choice([None, 1, 2]), r.choice([None, "", "x"])) for d in range(3) for g in range(30) for s in "ab"]
    after = [x for x in before if r.random() > 0.05]
    after = [(*x[:4], 7, x[5]) if r.random() < 0.1 else (*x[:5], "y") if r.random() < 0.1 else x for x in after]
    after += [("kbo", 5, "new", "a", 1, "x"), ("kbo", 5, "new", "a", 1, "x")]
    before += [("kbo", 6, "twice", "a", 1, "x"), ("kbo", 6, "twice", "a", 1, "x")]
    after += [("kbo", 6, "twice", "a", 1, "x"), ("kbo", 6, "twice", "a", 2, "x")]
    want = Counter()
    old, new = defaultdict(list), defaultdict(list)
    for rows, into in ((before, old), (after, new)):
        for x in rows:
            into[x[:4]].append(x[4:])
    for key in old.keys() | new.keys():
        gone, come = Counter(old[key]) - Counter(new[key]), Counter(new[key]) - Counter(old[key])
        pair = [list(c.elements()) for c in (gone, come)]
        for i in range(max(map(len, pair))):
            if i >= len(pair[0]):
                want[(*key, "added", "")] += 1
            elif i >= len(pair[1]):
                want[(*key, "removed", "")] += 1
            else:
                names = ",".join(n for n, a, b in zip(("lp", "text"), pair[0][i], pair[1][i]) if a != b)
                want[(*key, "changed", names)] += 1
    frames = [spark.createDataFrame(x, SCHEMA) for x in (before, after)]
    found = differ.mart_difference(*frames, ("league", "day"), ("game", "side"), ("lp", "text"))
    assert Counter(map(tuple, found.collect())) == want
    assert differ.mart_difference(frames[0], frames[0], ("league", "day"), ("game", "side"), ("lp", "text")).count() == 0


def test_thresholds_of_states(spark):
    r = random.Random(5)
    rows = [(f"2026-05-0{1 + i % 2}", f"g{i % 5}", i, f"n{i}", "LG", r.randint(-20, 60), "batter", None, r.choice(["유격수", "좌익수", "지명타자"]), None) for i in range(60)]
    schema = "d STRING, game_id STRING, row_id INT, name STRING, team STRING, lp INT, kind STRING, role STRING, position STRING, roster_cost INT"
    df = spark.createDataFrame(rows, schema).withColumn("game_date", F.to_date("d")).drop("d")
    want = sorted(map(tuple, boards.thresholds(df).collect()))
    stale = boards.pool_states(df.withColumn("lp", F.col("lp") + 100))
    for order in (("g3", "g0", "g1", "g4", "g2"), ("g0", "g1", "g2", "g3", "g4")):
        states = stale
        for game in order:
            fresh = df.where(F.col("game_id") == game)
            states = boards.replace_states(states, fresh.select("game_date", "game_id").distinct(), boards.pool_states(fresh))
        merged = boards.merge_states(boards.merge_states(states.where("game_id <= 'g2'")).unionByName(states.where("game_id > 'g2'").drop("game_id")))
        assert sorted(map(tuple, boards.thresholds_of(merged).collect())) == want
        assert sorted(map(tuple, boards.thresholds_of(states).collect())) == want
