"""Similarity, templates, insights, matches and conceded shots."""

import random

import pytest
from pyspark.sql import functions as F

from levelfield.operators import events, insights, profiles, similarity

LONG = ("league string, season string, team string, player string, position_group string, "
        "minutes int, metric string, percentile_per90 double")
AXES = ("np_xg", "shots", "xa", "key_passes", "xg_buildup")


def neighbourhood(make, drop=()):
    people = {
        "Referencia": ("FW", 900, (90, 88, 30, 32, 25)),
        "Gemelo": ("FW", 900, (88, 86, 32, 30, 27)),
        "Pobre": ("FW", 900, (30, 28, 8, 9, 6)),
        "Creador": ("FW", 900, (20, 18, 95, 94, 90)),
        "Central": ("DF", 900, (88, 86, 32, 30, 27)),
        "Suplente": ("FW", 80, (89, 87, 31, 31, 26)),
    }
    return make(LONG, [
        ("L", "s", "T", name, group, minutes, metric, float(value))
        for name, (group, minutes, values) in people.items()
        for metric, value in zip(AXES, values, strict=True) if metric not in drop
    ])


def nearest(make, **options):
    df = similarity.nearest_profiles(neighbourhood(make, options.pop("drop", ())),
                                     {"player": "Referencia"}, AXES, min_minutes=450, **options)
    return df.collect()


def test_nearest_profile(make):
    got = nearest(make)
    assert [r.player for r in got][0] == "Gemelo"
    assert {r.player for r in got} == {"Gemelo", "Pobre", "Creador"}
    assert got[0].similarity == 98.0 and got[0].minutes == 900
    assert nearest(make, drop=AXES[:2]) == []
    assert len(nearest(make, n=1)) == 1


def test_ambiguous_name_is_refused(make):
    df = neighbourhood(make)
    twice = df.unionByName(df.where("player = 'Referencia'").withColumn("team", F.lit("U")))
    with pytest.raises(similarity.AmbiguousEntityError):
        similarity.nearest_profiles(twice, {"player": "Referencia"}, AXES)
    told = similarity.nearest_profiles(twice, {"player": "Referencia", "team": "T"}, AXES)
    assert told.count() == 5
    assert similarity.nearest_profiles(twice, {"player": "Nadie"}, AXES).count() == 0


def test_template_orders_and_reports_missing(make):
    profile = make(
        "league string, season string, team string, player string, position_group string, "
        "metric string, percentile double",
        [("L", "s", "T", "p", "FW", "b", 140.0), ("L", "s", "T", "p", "FW", "a", 12.5),
         ("L", "s", "T", "q", "FW", "a", 40.0)])
    axes = make("position_group string, axis int, metric string, label string, family string",
                [("FW", 0, "a", "A", "x"), ("FW", 1, "b", "B", "x"), ("FW", 2, "c", "C", "y")])
    charted = profiles.profile_on_template(profile, axes)
    got = charted.where("player = 'p'").orderBy("axis").collect()
    assert [(r.metric, r.percentile, r.missing) for r in got] == [
        ("a", 12, False), ("b", 100, False), ("c", None, True)]
    one, two = F.col("player") == "p", F.col("player") == "q"
    compared = profiles.compare_on_template(charted, one, two)
    shared = {r.metric: r.shared for r in compared.collect()}
    assert shared == {"a": True, "b": False, "c": False}
    assert profiles.largest_gap(compared).first().width == 28


def test_insights(make):
    players = make("league string, season string, team string, player string, entity_id string, "
                   "np_goals double, np_xg double",
                   [("L", "s", "T", "Racha", "1", 8.0, 2.0), ("L", "s", "T", "Normal", "2", 4.0, 4.1),
                    ("L", "s", "T", "Chiripa", "3", 1.0, 0.05)])
    assert insights.overperformer(players).first().player == "Racha"
    pct = make(LONG.replace("minutes int, ", ""), [
        ("L", "s", "T", "Normal", "FW", "yellow_cards", 99.0),
        ("L", "s", "T", "Normal", "FW", "shots", 40.0),
        ("L", "s", "T", "Racha", "FW", "shots", 95.0)])
    ages = make("entity_id string, age int", [("1", 20), ("2", 18)])
    assert insights.young_standout(players, ages, pct, ["shots"]).first().player == "Racha"


MATCH = ("season string, entity_id string, game_id string, match_label string, position string, "
         "minutes bigint, goals bigint, xg double, assists bigint, xa double")


def test_trajectory_ignores_arrival_order(make):
    data = [("s", "e", str(i), f"2026-08-1{i} A-B", "FW", 90, g, x, 0, 0.0)
            for i, (g, x) in enumerate([(1, 0.5), (0, 0.4), (2, 0.9)])]
    for rows in (data, data[::-1]):
        got = events.cumulative_trajectory(make(MATCH, rows)).orderBy("match_label").collect()
        assert [r.cumulative_goals for r in got] == [1, 1, 3]
        assert [r.cumulative_xg for r in got] == [0.5, 0.9, 1.8]


def test_busy_entity_is_cut_without_changing_totals(make):
    random.seed(4)
    data = [("s", "hot" if i % 3 else f"e{i % 7}", str(i),
             f"2026-{1 + i % 12:02d}-{1 + i % 27:02d} g{i}", "FW", 90, random.randint(0, 3),
             random.choice([None, 0.25, 0.5]), 0, 0.1) for i in range(400)]
    got = {r.match_label: (r.cumulative_goals, r.cumulative_xg)
           for r in events.cumulative_trajectory(make(MATCH, data)).collect()}
    assert len(got) == 400
    totals = {}
    for row in sorted(data, key=lambda r: (r[1], r[3])):
        goals, xg = totals.get(row[1], (0, 0.0))
        totals[row[1]] = (goals + row[6], xg + (row[7] or 0.0))
        assert got[row[3]] == (totals[row[1]][0], pytest.approx(totals[row[1]][1], abs=1e-3))


def test_form(make):
    weak_then_strong = [("s", "e", f"{i:02d}", f"2026-08-{i + 1:02d} A", "FW", 90, 0,
                         0.1 if i < 5 else 0.9, 0, 0.0) for i in range(10)]
    few = [("s", "f", str(i), f"2026-08-0{i} A", "FW", 0, 0, 0.1, 0, 0.0) for i in range(1, 4)]
    got = {r.entity_id: r for r in events.entity_form(make(MATCH, weak_then_strong + few)).collect()}
    assert got["e"].recent_xg90 == 0.9 and got["e"].season_xg90 == 0.5
    assert got["e"].delta_xg90 == 0.4 and not got["e"].few_matches
    assert got["f"].few_matches and got["f"].recent_xg90 is None


def test_conceded_equals_pairing(make):
    random.seed(5)
    data = [("s", str(random.randint(0, 15)), random.choice("ABC"), random.choice([0.1, 0.25, None]),
             random.choice(["Penalty", "Open", None]), random.choice(["Goal", "Miss"]))
            for _ in range(200)]
    schema = ("season string, game_id string, team string, xg double, situation string, "
              "result string")
    got = {r.team: r for r in events.conceded_summary(make(schema, data)).collect()}
    for team in "ABC":
        games = {g for _, g, t, *_ in data if t == team}
        shots = [r for r in data if r[1] in games and r[2] != team]
        open_play = [r for r in shots if r[4] != "Penalty"]
        assert got[team].shots == len(shots)
        assert got[team].matches == len({r[1] for r in shots})
        assert got[team].goals_conceded == sum(r[5] == "Goal" for r in shots)
        assert got[team].xg_conceded == pytest.approx(sum(r[3] or 0 for r in shots), abs=1e-3)
        assert got[team].xg_per_shot == pytest.approx(
            sum(r[3] or 0 for r in open_play) / len(open_play), abs=1e-3)
