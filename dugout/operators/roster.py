"""Best roster under a cost budget, for every day at once.

Players are first reduced to the few best per (day, pool, cost), which is at most
``budget * picks`` rows however many players a day has. What is left of a day fits one row of
arrays indexed by cost, and the knapsack steps are array expressions on that row: no pairs of
players are ever joined.

A cell of a step is one whole number: the points so far, the cost spent before the step, and which
of two ways led here. A pass back over the cells of the winner alone names its players.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dugout.model import DH, RELIEVER, ROSTER_FIELD_SLOTS, STARTER

DEFAULT_BUDGET = 40
LARGEST_BUDGET = 999
STARTERS, RELIEVERS = 2, 3
#: Field slots come first, in their order.
POOLS = (*ROSTER_FIELD_SLOTS, DH, STARTER, RELIEVER)
PICK = "STRUCT<slot: STRING, player: STRING, lp: INT, cost: INT>"
#: Best points of some picks of one pool, and the places of those picks in its list, 12 bits each and counted from 1.
CHOICE = "STRUCT<lp: INT, code: BIGINT>"
CODE_BITS = 12
#: points << 11 | cost spent before << 1 | way.
CELLS = "ARRAY<BIGINT>"
CELL_BITS = 11


def candidates(batters: DataFrame, pitchers: DataFrame, day: str = "game_date") -> DataFrame:
    """Everybody with a cost, with the pool they are picked for.

    Batters: (day, player, position, board_position?, lp, roster_cost). Pitchers: with role.
    A batter outside the eight field slots can only be the designated hitter.
    """
    own = (
        F.coalesce(F.nullif(F.col("board_position"), F.lit("")), F.col("position"))
        if "board_position" in batters.columns else F.col("position")
    )
    cost = F.col("roster_cost").cast("int").alias("cost")
    lp = F.coalesce(F.col("lp"), F.lit(0)).cast("int").alias("lp")
    fielders = batters.filter(F.col("roster_cost").isNotNull()).select(
        F.col(day).alias("day"), "player", lp, cost,
        F.when(own.isin(*ROSTER_FIELD_SLOTS), own).otherwise(DH).alias("pool"),
    )
    arms = pitchers.filter(
        F.col("roster_cost").isNotNull() & F.col("role").isin(STARTER, RELIEVER)
    ).select(F.col(day).alias("day"), "player", lp, cost, F.col("role").alias("pool"))
    return fielders.unionByName(arms)


def feasibility(pool: DataFrame) -> DataFrame:
    """Per day: whether every slot can be filled at all, and why not."""
    counts = pool.groupBy("day").agg(
        *[F.count_if(F.col("pool") == s).alias(f"n_{i}") for i, s in enumerate(ROSTER_FIELD_SLOTS)],
        F.count_if(F.col("pool") == STARTER).alias("starters"),
        F.count_if(F.col("pool") == RELIEVER).alias("relievers"),
    )
    empty = F.least(*[F.col(f"n_{i}") for i in range(len(ROSTER_FIELD_SLOTS))]) == 0
    few = (F.col("starters") < STARTERS) | (F.col("relievers") < RELIEVERS)
    return counts.select(
        "day", (~empty & ~few).alias("feasible"),
        F.when(empty, "empty_slot").when(few, "few_pitchers").alias("reason"),
    )


def _picks_needed() -> Column:
    return F.when(F.col("pool") == RELIEVER, RELIEVERS).otherwise(2)


def best_per_cost(pool: DataFrame, budget: int) -> DataFrame:
    """At most three players per (day, pool, cost): nobody else can be in a best roster."""
    place = Window.partitionBy("day", "pool", "cost").orderBy(F.desc("lp"), "player")
    return (
        pool.filter(F.col("cost") <= budget)
        .withColumn("place", F.row_number().over(place))
        .filter(F.col("place") <= RELIEVERS)
        .filter(F.col("place") <= _picks_needed())
    )


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _choose(items: Column, most: int, budget: int) -> Column:
    """Array of rows: best choice per cost of exactly 0, 1, .. ``most`` of ``items``."""
    free = F.transform(
        F.sequence(F.lit(0), F.lit(budget)),
        lambda c: F.when(c == 0, F.struct(F.lit(0).alias("lp"), F.lit(0).cast("bigint").alias("code"))).cast(CHOICE),
    )
    zero = F.array(free, *[F.array_repeat(F.lit(None).cast(CHOICE), budget + 1)] * most).cast(f"ARRAY<ARRAY<{CHOICE}>>")

    def take(rows: Column, item: Column) -> Column:
        def row(n: int) -> Column:
            kept = F.get(rows, F.lit(n))
            if n == 0:
                return kept
            before = F.get(rows, F.lit(n - 1))

            def better(x: Column, c: Column) -> Column:
                old = F.get(before, c - item["cost"])
                return F.greatest(x, F.when(
                    (c >= item["cost"]) & old.isNotNull(),
                    F.struct(
                        (old["lp"] + item["lp"]).alias("lp"),
                        (F.shiftleft(old["code"], CODE_BITS) + item["place"]).alias("code"),
                    ),
                ).cast(CHOICE))

            return F.transform(kept, better)

        return F.array(*[row(n) for n in range(most + 1)]).cast(f"ARRAY<ARRAY<{CHOICE}>>")

    placed = F.transform(items, lambda x, i: F.struct(x["lp"].alias("lp"), x["cost"].alias("cost"), (i + 1).cast("bigint").alias("place")))
    return F.aggregate(placed, zero, take)


def _points(row: Column) -> Column:
    """Points of a row of choices in the bits of a cell, dearest first."""
    return F.reverse(F.transform(row, lambda x: F.shiftleft(x["lp"].cast("bigint"), CELL_BITS)))


def _spent(cells: Column, way: int) -> Column:
    """Cells as what a next step starts from: the points, the cost as spent before, the way."""
    return F.transform(
        cells, lambda x, c: F.shiftleft(F.shiftright(x, CELL_BITS), CELL_BITS) + (c * 2 + way).cast("bigint")
    )


def _combine(cells: Column, way: int, points: Column, budget: int) -> Column:
    """Best cell for every total cost: one of ``cells`` and one choice, whose ``points`` stand dearest first."""
    def best(start: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(budget)),
            lambda c: F.array_max(F.zip_with(
                F.slice(start, F.lit(1), c + 1), F.slice(points, F.lit(budget + 1) - c, c + 1), lambda x, y: x + y
            )),
        )

    return _bound(_spent(cells, way), best)


def _either(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def cost_tables(pool: DataFrame, budget: int = DEFAULT_BUDGET) -> DataFrame:
    """Per day with a player for every place: what each pool offers and the cells of each step.

    day, lists (items of each pool), chosen (rows of choices of each pool), steps (cells after each field slot,
    with no hitter chosen yet and with one of the slot's two players as hitter), hit, start, relief (cells after the
    hitter, the starters and the relievers).
    """
    best = best_per_cost(pool, budget)
    # The array work is heavy for its bytes: keep the days spread over all tasks, since adaptive
    # execution would merge such small partitions into one.
    tasks = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Bounded lists: at most three players per cost, at most ``budget`` costs.
    lists = best.groupBy("day", "pool").agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("pool").alias("slot"), "player", "lp", "cost"))
        ).cast(f"ARRAY<{PICK}>").alias("items")
    )
    choices = lists.repartition(tasks, "day", "pool").withColumn(
        "rows",
        F.when(F.col("pool") == RELIEVER, F.slice(_choose(F.col("items"), RELIEVERS, budget), 4, 1))
        .when(F.col("pool") == STARTER, F.slice(_choose(F.col("items"), STARTERS, budget), 3, 1))
        .otherwise(F.slice(_choose(F.col("items"), 2, budget), 2, 2)),
    )
    days = choices.groupBy("day").agg(
        *[
            F.first(F.when(F.col("pool") == s, F.struct("items", "rows")), ignorenulls=True).alias(f"pool_{i}")
            for i, s in enumerate(POOLS)
        ]
    )
    count = len(ROSTER_FIELD_SLOTS)
    pools = [F.col(f"pool_{i}") for i in range(len(POOLS))]
    ready = days.repartition(tasks, "day")
    for i in (*range(count), count + 1, count + 2):
        ready = ready.filter(pools[i].isNotNull())
    nobody = F.array_repeat(F.lit(None).cast(CHOICE), budget + 1)
    lists = F.array(*[p["items"] for p in pools])
    chosen = F.array(*[
        F.coalesce(p["rows"], F.array(nobody)) if i == count else p["rows"] for i, p in enumerate(pools)
    ])
    ready = ready.select("day", lists.alias("lists"), chosen.alias("chosen"))
    free = F.transform(F.sequence(F.lit(0), F.lit(budget)), lambda c: F.when(c == 0, F.lit(0)).cast("bigint"))
    none = F.array_repeat(F.lit(None).cast("bigint"), budget + 1)
    step = f"STRUCT<free: {CELLS}, taken: {CELLS}>"
    state = f"STRUCT<free: {CELLS}, taken: {CELLS}, steps: ARRAY<{step}>>"
    start = F.struct(free.alias("free"), none.alias("taken"), F.array().cast(f"ARRAY<{step}>").alias("steps")).cast(state)
    offers = F.transform(
        F.slice("chosen", 1, count),
        lambda rows: F.struct(_points(F.get(rows, F.lit(0))).alias("one"), _points(F.get(rows, F.lit(1))).alias("two")),
    )

    def add_slot(so_far: Column, offer: Column) -> Column:
        new = F.struct(
            _combine(so_far["free"], 0, offer["one"], budget).alias("free"),
            _either(
                _combine(so_far["taken"], 0, offer["one"], budget), _combine(so_far["free"], 1, offer["two"], budget)
            ).alias("taken"),
        )
        return _bound(new, lambda n: F.struct(
            n["free"].alias("free"), n["taken"].alias("taken"), F.array_append(so_far["steps"], n).alias("steps")
        )).cast(state)

    batting = ready.select("day", "lists", "chosen", F.aggregate(offers, start, add_slot).alias("field"))

    def offered(place: int) -> Column:
        return _points(F.get(F.get(F.col("chosen"), F.lit(place)), F.lit(0)))

    def with_pool(name: str, cells: str, place: int, df: DataFrame) -> DataFrame:
        return df.withColumn(name, _bound(offered(place), lambda points: _combine(F.col(cells), 0, points, budget)))

    hit = _bound(offered(count), lambda points: _either(_spent(F.col("field.taken"), 0), _combine(F.col("field.free"), 1, points, budget)))
    out = batting.withColumn("hit", hit).withColumn("steps", F.col("field.steps")).drop("field")
    out = with_pool("start", "hit", count + 1, out)
    return with_pool("relief", "start", count + 2, out)


def _before(cell: Column) -> Column:
    return F.shiftright(cell, 1).bitwiseAND(F.lit((1 << CELL_BITS - 1) - 1).cast("bigint")).cast("int")


def _way(cell: Column) -> Column:
    return cell.bitwiseAND(F.lit(1).cast("bigint")) == 1


def _named(place: Column, number: Column, cost: Column, hitter: Column) -> Column:
    """The players of one choice; ``hitter``: the second of them is the designated hitter."""
    code = F.get(F.get(F.get(F.col("chosen"), place), number), cost)["code"]
    items = F.get(F.col("lists"), place)
    places = F.filter(
        F.transform(
            F.array(*[F.lit(k * CODE_BITS) for k in range(RELIEVERS)]),
            lambda by: F.call_function("shiftright", code, by).bitwiseAND(F.lit((1 << CODE_BITS) - 1).cast("bigint")).cast("int"),
        ),
        lambda at: at > 0,
    )
    return F.transform(places, lambda at, i: _bound(F.get(items, at - 1), lambda p: F.struct(
        F.when(hitter & (i == 1), F.lit(DH)).otherwise(p["slot"]).alias("slot"),
        p["player"].alias("player"), p["lp"].alias("lp"), p["cost"].alias("cost"),
    ).cast(PICK)))


def best_rosters(
    pool: DataFrame, budgets: Sequence[int] = (DEFAULT_BUDGET,)
) -> DataFrame:
    """Highest total per (day, budget), the cheapest one on equal totals, with its players; budgets are 1..999."""
    budgets = [int(b) for b in budgets]
    if not budgets or min(budgets) < 1 or max(budgets) > LARGEST_BUDGET:
        raise ValueError(f"budgets must be 1..{LARGEST_BUDGET}: {budgets}")
    tables = cost_tables(pool, max(budgets))
    limit = F.explode(F.array(*[F.lit(b) for b in sorted(set(budgets))])).alias("budget")
    totals = F.transform(
        F.slice("relief", F.lit(1), F.col("budget") + 1),
        lambda x, c: F.when(x.isNotNull(), F.struct(F.shiftright(x, CELL_BITS).cast("int").alias("lp"), (-c).alias("cheap"))),
    )
    won = tables.select("*", limit).withColumn("best", F.array_max(totals)).filter(F.col("best").isNotNull())
    # Back from the last step to the first: what each place cost, and what was spent before it.
    count = len(ROSTER_FIELD_SLOTS)
    won = won.withColumn("at_relief", -F.col("best.cheap"))
    for cells, at, before in (("relief", "at_relief", "at_start"), ("start", "at_start", "at_hit")):
        won = won.withColumn(before, _before(F.get(F.col(cells), F.col(at))))
    won = won.withColumn("hit_cell", F.get(F.col("hit"), F.col("at_hit")))
    won = won.withColumn("at_field", _before(F.col("hit_cell"))).withColumn("own_hitter", _way(F.col("hit_cell")))
    one = "STRUCT<place: INT, cost: INT, two: BOOLEAN>"
    state = f"STRUCT<at: INT, taken: BOOLEAN, picks: ARRAY<{one}>>"
    start = F.struct(
        F.col("at_field").alias("at"), (~F.col("own_hitter")).alias("taken"), F.array().cast(f"ARRAY<{one}>").alias("picks")
    ).cast(state)

    def back(so_far: Column, place: Column) -> Column:
        step = F.get(F.col("steps"), place)
        cell = F.when(so_far["taken"], F.get(step["taken"], so_far["at"])).otherwise(F.get(step["free"], so_far["at"]))

        def earlier(c: Column) -> Column:
            two = so_far["taken"] & _way(c)
            pick = F.struct(place.alias("place"), (so_far["at"] - _before(c)).alias("cost"), two.alias("two"))
            return F.struct(
                _before(c).alias("at"), (so_far["taken"] & ~two).alias("taken"),
                F.array_prepend(so_far["picks"], pick.cast(one)).alias("picks"),
            )

        return _bound(cell, earlier).cast(state)

    won = won.withColumn("field", F.aggregate(F.sequence(F.lit(count - 1), F.lit(0), F.lit(-1)), start, back)["picks"])
    no = F.lit(False)
    roster = F.concat(
        F.flatten(F.transform("field", lambda p: _named(p["place"], p["two"].cast("int"), p["cost"], p["two"]))),
        F.when(F.col("own_hitter"), _named(F.lit(count), F.lit(0), F.col("at_hit") - F.col("at_field"), no))
        .otherwise(F.array().cast(f"ARRAY<{PICK}>")),
        _named(F.lit(count + 1), F.lit(0), F.col("at_start") - F.col("at_hit"), no),
        _named(F.lit(count + 2), F.lit(0), F.col("at_relief") - F.col("at_start"), no),
    )
    return won.select("day", "budget", F.col("best.lp").alias("total_lp"), F.col("at_relief").alias("total_cost"), roster.alias("roster"))


def roster_rows(rosters: DataFrame) -> DataFrame:
    """One row per pick, in slot order."""
    place = None
    for i, slot in enumerate(POOLS):
        place = F.when(F.col("slot") == slot, i) if place is None else place.when(F.col("slot") == slot, i)
    picks = rosters.select("day", "budget", F.posexplode("roster").alias("pick", "p")).select(
        "day", "budget", "pick", "p.*"
    )
    return picks.withColumn("slot_no", place)
