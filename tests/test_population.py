"""Thresholds, rates, shrinkage and percentiles on small populations."""

import random

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from levelfield.catalog import PLAYER_METRICS, metric
from levelfield.operators import percentiles, prefix, ranking, rates

METRICS = (
    metric("goals", "Goals", "t"),
    metric("fouls_committed", "Fouls", "t", reads="less"),
    metric("clearances", "Clearances", "t", reads="style"),
)
SCHEMA = (
    "league string, season string, team string, player string, position_group string, "
    "minutes int, goals double, fouls_committed double, clearances double"
)


def rows(goals, fouls=None, clearances=None, group="MF", season="2526", league="A", minutes=900):
    n = len(goals)
    fouls, clearances = fouls or [1.0] * n, clearances or [1.0] * n
    return [
        (league if isinstance(league, str) else league[i], season, "T", f"{season}p{i}", group,
         minutes, float(goals[i]), float(fouls[i]), float(clearances[i]))
        for i in range(n)
    ]


def ranked(make, data, **options):
    df = percentiles.population_percentiles(make(SCHEMA, data), METRICS, 450, **options)
    return {(r.player, r.metric): r for r in df.collect()}


def test_full_population_before_any_view(make):
    leagues = ["ESP", "ESP", "B", "B", "C", "C", "D", "D", "E", "E"]
    got = ranked(make, rows([2, 18, 10, 12, 14, 16, 17, 19, 20, 22], league=leagues))
    assert got["2526p0", "goals"].percentile_per90 == pytest.approx(10)


def test_season_and_group_are_populations(make):
    weak = rows([10, 1, 2, 3, 4], season="2425")
    strong = rows([10, 11, 12, 13, 14])
    got = ranked(make, weak + strong)
    assert got["2425p0", "goals"].percentile_per90 > got["2526p0", "goals"].percentile_per90
    moved = rows([1, 2, 3, 4]) + rows([1], group="DF", season="2526", league="Z")[0:1]
    moved[-1] = (*moved[-1][:3], "lone", *moved[-1][4:])
    assert ranked(make, moved)["lone", "goals"].percentile_per90 == 100.0


def test_filter_comes_before_ranking(make):
    data = rows([1, 2, 3, 4]) + [("A", "2526", "T", "brief", "MF", 60, 9.0, 1.0, 1.0)]
    got = ranked(make, data)
    assert ("brief", "goals") not in got
    assert len({p for p, _ in got}) == 4


def test_inversion_only_where_low_is_good(make):
    got = ranked(make, rows([1] * 5, fouls=[10, 20, 30, 40, 50], clearances=[10, 20, 30, 40, 50]))
    fouls = [got[f"2526p{i}", "fouls_committed"].percentile_per90 for i in range(5)]
    clearances = [got[f"2526p{i}", "clearances"].percentile_per90 for i in range(5)]
    assert fouls == [80.0, 60.0, 40.0, 20.0, 0.0]
    assert clearances == [20.0, 40.0, 60.0, 80.0, 100.0]


def test_without_possession_no_adjusted_value(make):
    sensitive = (metric("goals", "Goals", "t", "chances"),)
    df = percentiles.population_percentiles(make(SCHEMA, rows([1, 2])), sensitive, 450).collect()
    assert all(r.per90 is not None and r.padj is None and r.percentile_padj is None for r in df)


def test_empty_population_keeps_its_columns(make):
    df = percentiles.population_percentiles(make(SCHEMA, rows([1], minutes=10)), METRICS, 450)
    assert df.count() == 0 and "percentile_shrunk" in df.columns


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["a", "b", None]),
            st.one_of(st.none(), st.sampled_from([0.0, 0.0, 0.0, 1.5, 2.0]), st.floats(-50, 50)),
        ),
        min_size=1,
        max_size=120,
    )
)
def test_ranking_equals_pandas(spark, data):
    frame = pd.DataFrame(data, columns=["g", "v"])
    expected = frame.groupby("g", dropna=False)["v"].rank(pct=True) * 100
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(data)],
                               "i int, g string, v double")
    out = ranking.percentile_within(df, ["g"], {"v": "p"})
    got = {r.i: r.p for r in out.collect()}
    assert len(got) == len(data)
    for i, want in enumerate(expected):
        assert (got[i] is None) == pd.isna(want)
        assert got[i] is None or got[i] == pytest.approx(want, abs=1e-9)


def test_ranking_spreads_one_population(spark):
    """One group over many range partitions, a third of it tied."""
    random.seed(3)
    values = [0.0] * 700 + [random.random() for _ in range(1300)]
    df = spark.createDataFrame([(i, v, -v) for i, v in enumerate(values)], "i int, v double, w double")
    df = df.withColumn("g", F.lit("g"))
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.i: (r.p, r.q) for r in ranking.percentile_within(
            df, ["g"], {"v": "p", "w": "q"}).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    frame = pd.DataFrame({"v": values})
    for i, (p, q) in enumerate(zip(frame.v.rank(pct=True) * 100, (-frame.v).rank(pct=True) * 100)):
        assert got[i] == pytest.approx((p, q), abs=1e-9)


def test_running_sums_cut_a_group_anywhere(spark):
    rows = [(k % 2, k, k % 7) for k in range(500)]
    df = spark.createDataFrame(rows, "g int, at int, n int").repartition(5)
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.g, r.at): (r.n_upto, r.n_total) for r in prefix.running_sums(df, ["g"], ["at"], ["n"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    for g, at, _ in rows:
        own = [n for h, a, n in rows if h == g]
        assert got[g, at] == (sum(n for h, a, n in rows if h == g and a <= at), sum(own))


PLAYERS = ("league string, season string, team string, player string, position_group string, "
           "minutes int, tackles double, goals double")
TEAMS = ("league string, season string, team string, perspective string, "
         "passes_attempted double, possession_pct double")
SENSITIVE = (
    metric("tackles", "Tackles", "t", "chances"),
    metric("goals", "Goals", "t"),
)


def test_rate_and_zero_minutes(make):
    df = make(PLAYERS, [("L", "s", "D", "a", "MF", 1800, 40.0, 4.0),
                        ("L", "s", "D", "b", "MF", 0, 40.0, 4.0)])
    got = {r.player: r for r in rates.per_90(df, SENSITIVE).collect()}
    assert got["a"].tackles_p90 == 2.0 and got["b"].tackles_p90 is None


def test_possession_share_clip_and_adjustment(make):
    teams = make(TEAMS, [
        ("L", "s", "Dominador", "for", 650.0, None), ("L", "s", "Dominador", "against", 350.0, None),
        ("L", "s", "Replegado", "for", 10.0, None), ("L", "s", "Replegado", "against", 990.0, None),
    ])
    share = {r.team: r.possession_pct for r in rates.team_possession(teams).collect()}
    assert share == {"Dominador": 65.0, "Replegado": 25.0}
    published = teams.withColumn("possession_pct", F.lit(80.0))
    assert {r.possession_pct for r in rates.team_possession(published).collect()} == {75.0}
    players = make(PLAYERS, [
        ("L", "s", "Dominador", "a", "MF", 1800, 40.0, 4.0),
        ("L", "s", "Replegado", "b", "MF", 1800, 40.0, 2.0),
        ("L", "s", "Otro", "c", "MF", 1800, 40.0, 2.0),
    ])
    adjusted = rates.possession_adjust(
        rates.per_90(players, SENSITIVE), SENSITIVE, rates.team_possession(teams))
    got = {r.player: r.tackles_padj for r in adjusted.collect()}
    assert got["a"] == pytest.approx(2 * 50 / 35) and got["a"] > got["b"]
    assert got["c"] is None and "goals_padj" not in adjusted.columns


def test_threshold_falls_early_and_never_to_zero(make):
    df = make("season string, minutes int",
              [("full", 3400), ("early", 400), ("start", 1), ("none", 0)])
    got = {r.season: r.min_minutes for r in rates.adaptive_threshold(df).collect()}
    assert got == {"full": 450, "early": 120, "start": 1, "none": 450}


def test_shrinkage(make):
    schema = ("league string, season string, team string, player string, position_group string, "
              "minutes int, np_xg double")
    data = [("L", "s", "T", "long", "FW", 2500, 1.0 * 2500 / 90),
            ("L", "s", "T", "brief", "FW", 100, 1.0 * 100 / 90)]
    data += [("L", "s", "T", f"p{i}", "FW", 2000, 0.2 * 2000 / 90) for i in range(8)]
    data += [("L", "s", "T", "back", "DF", 900, 0.01 * 10)]
    metric = tuple(m for m in PLAYER_METRICS if m.name == "np_xg")
    shrunk = rates.shrunk_rates(rates.per_90(make(schema, data), metric), metric)
    got = {r.player: r.np_xg_shrunk for r in shrunk.collect()}
    assert got["brief"] < 0.6 and got["brief"] < got["long"] and got["long"] > 0.75
    assert got["back"] == pytest.approx(0.01)
    half = make("minutes int", [(750,), (0,)]).select(rates.weight("minutes", 750).alias("w"))
    assert [r.w for r in half.collect()] == [0.5, 0.0]


def test_fixtures_join_orders_and_buyers_alike_at_every_size(spark):
    """Neither orders nor customers are broadcast where their files happen to be small."""
    from levelfield.plans.workspace import workspace

    plan = workspace(spark, "/root/testdata/sf0.001").matches()._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and ("l_orderkey" in line or "o_custkey" in line)]
    assert joins and not any("Broadcast" in line for line in joins), plan
