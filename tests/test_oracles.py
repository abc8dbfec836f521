"""Every registered query against its SQL. The play-by-play ones are slow; DUGOUT_ALL=1 runs them too."""

import os

import duckdb
import pytest

from dugout.plans import day_queries, oracles, queries as q

FOLDER = os.environ.get("DUGOUT_SF_DIR", "/root/testdata/sf0.001")
SLOW = {
    "pitcher_in_charge", "fielder_asof", "prev_base", "inherited_runners", "earned_run_origin", "entry_margins",
    "line_credits", "scored_batters", "scored_pitchers", "er_cut", "inning_totals", "ledger_cap",
    "position_events", "field_rule_modes", "category_totals",
}
ALL = q.ALL | day_queries.ALL
SQL = oracles.oracle_sql() | day_queries.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(SQL) == set(ALL)


@pytest.mark.parametrize("name", [n for n in ALL if os.environ.get("DUGOUT_ALL") or n not in SLOW])
def test_query_equals_sql(spark, duck, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    ours = ALL[name](spark, FOLDER).toPandas()
    theirs = duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    rows = [sorted(map(str, d[columns].itertuples(index=False, name=None))) for d in (ours, theirs)]
    assert rows[0] == rows[1]
