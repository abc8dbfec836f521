import itertools
import random

from dugout.model import DH, RELIEVER, ROSTER_FIELD_SLOTS, STARTER
from dugout.operators import roster


def brute(batters, pitchers, budget):
    groups = [[x for x in batters if x[2] == s] for s in ROSTER_FIELD_SLOTS]
    starters = [x for x in pitchers if x[2] == STARTER]
    relievers = [x for x in pitchers if x[2] == RELIEVER]
    arms = {}
    for a in itertools.combinations(starters, 2):
        for c in itertools.combinations(relievers, 3):
            cost, value = sum(x[4] for x in a + c), sum(x[3] for x in a + c)
            arms[cost] = max(arms.get(cost, -10**9), value)
    best = None
    for field in itertools.product(*groups):
        for hitter in batters:
            if hitter in field:
                continue
            cost, value = sum(x[4] for x in field) + hitter[4], sum(x[3] for x in field) + hitter[3]
            for c, v in arms.items():
                if cost + c <= budget and (best is None or (value + v, -cost - c) > best):
                    best = (value + v, -cost - c)
    return best and (best[0], -best[1])


def test_best_roster_equals_brute_force(spark):
    rng = random.Random(1)
    batters, pitchers = [], []
    days = [f"d{i}" for i in range(8)]
    for d in days:
        n = 0
        for s in ROSTER_FIELD_SLOTS:
            for _ in range(rng.randint(1, 2)):
                n += 1
                batters.append((d, f"b{n}", s, rng.randint(-20, 100), rng.randint(0, 4)))
        if rng.random() < 0.5:
            batters.append((d, "only", DH, rng.randint(-20, 100), rng.randint(0, 4)))
        pitchers += [(d, f"s{k}", STARTER, rng.randint(-20, 100), rng.randint(0, 4)) for k in range(rng.randint(1, 4))]
        pitchers += [(d, f"r{k}", RELIEVER, rng.randint(-20, 100), rng.randint(0, 4)) for k in range(rng.randint(3, 4))]
    b = spark.createDataFrame(batters, "game_date STRING, player STRING, position STRING, lp INT, roster_cost INT")
    p = spark.createDataFrame(pitchers, "game_date STRING, player STRING, role STRING, lp INT, roster_cost INT")
    pool = roster.candidates(b, p)
    got = {(r.day, r.budget): r for r in roster.best_rosters(pool, [22, 30]).collect()}
    feasible = {r.day: r.feasible for r in roster.feasibility(pool).collect()}
    for d in days:
        for budget in (22, 30):
            want = brute([x for x in batters if x[0] == d], [x for x in pitchers if x[0] == d], budget)
            r = got.get((d, budget))
            assert (want is None) == (r is None)
            if want is None:
                continue
            assert feasible[d] and want == (r.total_lp, r.total_cost)
            assert len({x.player for x in r.roster}) == 14
            assert (sum(x.lp for x in r.roster), sum(x.cost for x in r.roster)) == want
            slots = sorted([*ROSTER_FIELD_SLOTS, DH] + [STARTER] * 2 + [RELIEVER] * 3)
            assert sorted(x.slot for x in r.roster) == slots


def test_budgets_out_of_range_are_refused(spark):
    pool = spark.createDataFrame([], "day string")
    for bad in ([0], [1000], []):
        try:
            roster.best_rosters(pool, bad)
        except ValueError:
            continue
        raise AssertionError(bad)
