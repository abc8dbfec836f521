from collections import Counter, defaultdict
import random

import pytest
from pyspark.sql import functions as F

from dugout.model import FIELD_POSITIONS, RELAY_EVENTS
from dugout.operators import relay
from dugout.plans.bindings import SENTENCES
from relay_model import read_game


def random_games(count, seed):
    rng = random.Random(seed)
    rows = []
    for g in range(count):
        half, inn, no = "0", 1, 0
        for _ in range(rng.randint(20, 90)):
            no += 1
            for sub in range(rng.randint(1, 4)):
                sentence = rng.choice(SENTENCES)
                mine, theirs = ("V", "H") if half == "0" else ("H", "V")
                text = sentence
                for mark, value in {
                    "{b}": mine + str(rng.randint(1, 9)), "{r}": mine + str(rng.randint(1, 9)),
                    "{f}": theirs + str(rng.randint(1, 9)), "{p}": theirs + "P" + str(rng.randint(0, 3)),
                    "{q}": theirs + "P0", "{i}": str(inn),
                }.items():
                    text = text.replace(mark, value)
                base = [str(rng.choice([0, 0, rng.randint(1, 5)])) for _ in range(3)]
                rows.append((f"g{g}", no, sub, inn, half, rng.choice([0, 1, 2, None]), base, rng.randint(0, 5), rng.randint(0, 5), text))
                if sentence == SENTENCES[0]:
                    half = "1" if half == "0" else "0"
                    inn += half == "0"
    return rows


@pytest.mark.parametrize("width", [3, 1000])
def test_windows_equal_a_sequential_reading(spark, width):
    rows = random_games(25, seed=width)
    names = ["game_id", "no", "sub", "inn", "half", "out", "base", "home_score", "away_score", "text"]
    shuffled = rows[:]
    random.Random(0).shuffle(shuffled)
    events = spark.createDataFrame(shuffled, RELAY_EVENTS)
    defense = {h: {p: f"{s}{i + 1}" for i, p in enumerate(FIELD_POSITIONS)} for h, s in (("0", "H"), ("1", "V"))}
    starters = {"0": "HP0", "1": "VP0"}
    games = sorted({r[0] for r in rows})
    starting = spark.createDataFrame(
        [(g, h, starters[h], defense[h]) for g in games for h in "01"],
        "game_id STRING, half STRING, pitcher STRING, defense MAP<STRING,STRING>",
    )
    facts = relay.relay_facts(events, starting, lambda df: df.cache(), groups_per_chunk=width)
    credits, earned, margins = defaultdict(Counter), defaultdict(Counter), defaultdict(dict)
    for r in facts.credits.collect():
        credits[r.game_id][(r["name"], r.role, r.tag, r.points, r.inn, r.n)] += 1
    for r in facts.earned.collect():
        earned[r.game_id][(r["name"], r.inn, r.runner)] += 1
    for r in facts.margins.collect():
        margins[r.game_id][r["name"]] = r.margin
    by_game = defaultdict(list)
    for r in rows:
        by_game[r[0]].append(dict(zip(names, r)))
    for g in games:
        c, e, m = read_game(by_game[g], defense, starters)
        assert credits[g] == c, (credits[g] - c, c - credits[g])
        assert earned[g] == e
        assert margins[g] == m


def test_ungrounded_grounder_is_worth_nothing(spark):
    rows = [
        ("g", 1, 0, 1, "0", 1, ["0", "0", "0"], 0, 0, "이 : 2루수 앞 땅볼로 출루"),
        ("g", 2, 0, 1, "0", 1, ["0", "0", "0"], 0, 0, "박 : 2루수 앞 땅볼로 출루"),
        ("g", 2, 1, 1, "0", 2, ["0", "0", "0"], 0, 0, "1루주자 이 : 포스아웃 (유격수->2루수 2루 터치아웃)"),
    ]
    facts = relay.relay_facts(spark.createDataFrame(rows, RELAY_EVENTS), None)
    got = facts.credits.filter(F.col("role") == "bat").select("name", "tag", "points").collect()
    assert [tuple(r) for r in got] == [("박", "PLAY:GO", -10)]
