"""Roles and styles."""

import random

import pytest

from levelfield import catalog
from levelfield.catalog import KEYS
from levelfield.operators import clusters, kmeans, teams

SCHEMA = ("league string, season string, team string, player string, position_group string, "
          "minutes int, xg_chain double, np_xg double, xa double, xg_buildup double, "
          "shots double, key_passes double, np_goals double")


def squad(n=60, group="FW"):
    random.seed(6)
    data = []
    for i in range(n):
        shot, create = random.random(), random.random()
        build = 1.0 + random.random()
        total = shot + create + build
        data.append(("L", "s", "T", f"{group}{i}", group, 900, total, shot, create, build,
                     1 + 10 * random.random(), 1 + 8 * random.random(), 2 * shot * random.random()))
    return data


def test_shares_sum_to_one_and_zero_denominator_is_null(make):
    data = squad(5) + [("L", "s", "T", "z", "FW", 900, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    for r in clusters.role_features(make(SCHEMA, data)).collect():
        shares = (r.shot_share, r.creation_share, r.buildup_share)
        assert shares == (None,) * 3 if r.player == "z" else sum(shares) == pytest.approx(1)


def test_constant_column_standardises_to_zero(make):
    df = make("g string, a double, b double", [("x", 1.0, 5.0), ("x", 3.0, 5.0), ("x", None, 5.0)])
    got = clusters.standardise(df, ["a", "b"], ["g"]).collect()
    assert sorted(r.a for r in got) == [-1.0, 0.0, 1.0] and {r.b for r in got} == {0.0}
    assert sorted(r.a for r in clusters.standardise(df, ["a"]).collect()) == [-1.0, 0.0, 1.0]


def test_naming_is_one_to_one_and_optimal():
    names = list(catalog.ARCHETYPES)
    centroids = [[s.get(c, 0.0) for c in clusters.ROLE_COLUMNS] for s in catalog.ARCHETYPES.values()]
    table = clusters.archetype_similarity(centroids)
    assert clusters.name_clusters(table) == names
    assert clusters.name_clusters(table[::-1]) == names[::-1]
    assert clusters.archetype_similarity([[0.0] * 6])[0] == [0.0] * 12


def test_roles_lose_nobody_and_repeat(make):
    data = squad(40) + squad(5, "DF") + squad(3, "GK")
    data += [(*row[:3], f"n{i}", None, *row[5:]) for i, row in enumerate(squad(2))]
    df = make(SCHEMA, data)
    first, second = (
        {tuple(r[k] for k in KEYS): r.detailed_position
         for r in clusters.assign_all_roles(df, restarts=2).collect()} for _ in range(2))
    assert first == second and len(first) == 50
    named = {k[3]: v for k, v in first.items()}
    assert all(named[f"FW{i}"] for i in range(40))
    assert all(named[p] is None for p in named if not p.startswith("FW"))
    for group in ("GK", "DF"):
        with pytest.raises(ValueError):
            clusters.assign_roles(df, group)


def test_seasons_are_fitted_alone(make):
    """Another season, however different, changes no role of this one."""
    own = squad(40)
    other = [(r[0], "t", *r[2:6], *[v * 9 + 1 for v in r[6:]]) for r in squad(40)]
    alone, both = (
        {r.player: (r.cluster, r.detailed_position) for r in clusters.fit_roles(make(SCHEMA, rows), 2)[0]
         .where("season = 's'").collect()} for rows in (own, own + other))
    assert alone == both


def test_fit_is_a_fixed_point_and_not_worse_than_one_restart(make):
    rows, described, quality = clusters.fit_roles(make(SCHEMA, squad(80)), 4)
    held = clusters.misplaced(rows, described, clusters.ROLE_COLUMNS, clusters.ROLE_FIT).first()
    assert (held.rows, held.clusters, held.nearer_elsewhere, held.off_centre) == (80, 12, 0, 0)
    assert -1 <= quality.first().silhouette <= 1

    def cost(df, centres):
        table = {r.cluster: r for r in centres.collect()}
        return sum(sum((r[c] - table[r.cluster][c]) ** 2 for c in clusters.ROLE_COLUMNS) for r in df.collect())

    one, centres, _ = clusters.fit_roles(make(SCHEMA, squad(80)), 1)
    assert cost(rows, described) <= cost(one, centres) + 1e-9


TEAM = ("league string, season string, team string, perspective string, matches_played double, "
        "goals double, xg double, np_xg double, deep_completions double, ppda double")


def gradient(n=10):
    rows = []
    for i in range(n):
        rows.append(("L", "s", f"t{i}", "for", 38.0, 60.0 - 3 * i, 58.0 - 3 * i, 55.0 - 3 * i,
                     400.0 - 25 * i, 6 + 1.5 * i))
        rows.append(("L", "s", f"t{i}", "against", 38.0, 30.0 + 2 * i, 32.0 + 2 * i, 30.0 + 2 * i,
                     200.0 + 20 * i, 12.0))
    return rows


def test_style_features_and_extremes(make):
    df = make(TEAM, gradient())
    got = {r.team: r for r in teams.style_features(df).collect()}
    assert got["t0"].pressing == -6.0 and got["t0"].territory == pytest.approx(400 / 38)
    styled, centres, quality = clusters.cluster_styles(df, 2, restarts=1)
    labels = {r.team: r.style for r in styled.collect()}
    assert labels["t0"] != labels["t9"] and centres.count() == 2
    assert -1 <= quality.first().silhouette <= 1
    with pytest.raises(ValueError):
        clusters.cluster_styles(df, 11)
    with pytest.raises(ValueError):
        clusters.cluster_styles(df.where("perspective = 'for'"))


POINTS = "g string, id int, x double, y double"


def _cost(points, centres):
    return sum(min((x - a) ** 2 + (y - b) ** 2 for a, b in centres) for x, y in points)


def test_fit_finds_far_clusters_over_many_blocks(make, monkeypatch):
    monkeypatch.setattr(kmeans, "BLOCK", 16)
    rng = random.Random(8)
    at = [(0, 0), (50, 0), (0, 50), (50, 50), (25, 100)]
    rows = [(g, i, at[i % 5][0] + rng.random(), at[i % 5][1] + rng.random()) for g in "ab" for i in range(300)]
    assigned, centres, quality = kmeans.fit(make(POINTS, rows).repartition(5), ["x", "y"], 5, ["g"], ["id"], 3, 1)
    of = {}
    for r in assigned.collect():
        of.setdefault((r.g, r.id % 5), set()).add(r.cluster)
    assert all(len(c) == 1 for c in of.values()) and len(of) == 10
    told = quality.collect()
    assert all(r.settled and r.silhouette > 0.95 for r in told)
    for r in told:
        own = [(c.x, c.y) for c in centres.collect() if c.g == r.g]
        assert r.cost == pytest.approx(_cost([(x, y) for g, _, x, y in rows if g == r.g], own), rel=1e-6)


def test_silhouette_says_nothing_where_every_point_is_a_cluster(make):
    rows = [("a", i, float(i), 0.0) for i in range(4)] + [("b", i, float(i // 3), 0.0) for i in range(6)]
    _, centres, quality = kmeans.fit(make(POINTS, rows), ["x", "y"], 4, ["g"], ["id"], 2, 1)
    told = {r.g: r.silhouette for r in quality.collect()}
    assert told["a"] is None and told["b"] is not None
    assert centres.groupBy("g").count().collect()[0]["count"] == 4


def test_a_fit_that_does_not_end_is_told(make, monkeypatch):
    monkeypatch.setattr(kmeans, "MAX_STEPS", 1)
    rng = random.Random(8)
    rows = [("a", i, rng.random(), rng.random()) for i in range(200)]
    _, _, quality = kmeans.fit(make(POINTS, rows), ["x", "y"], 8, ["g"], ["id"], 1, 1)
    assert [(r.settled, r.steps) for r in quality.collect()] == [(False, 1)]


def test_silhouette_equals_the_pairwise_definition(make):
    rng = random.Random(4)
    rows = [("g", i, rng.random(), rng.random(), rng.randrange(3) if i else 9) for i in range(40)]
    df = make(POINTS + ", cluster int", rows)
    got = kmeans.silhouette(df, ["x", "y"], ["g"]).first().silhouette

    def mean(r, cluster):
        far = [(r[2] - q[2]) ** 2 + (r[3] - q[3]) ** 2 for q in rows if q[4] == cluster and q is not r]
        return sum(far) / len(far) if far else None

    values = []
    for r in rows:
        a, b = mean(r, r[4]), min(mean(r, c) for c in {q[4] for q in rows} - {r[4]})
        values.append(0.0 if a is None else (b - a) / max(a, b))
    assert got == pytest.approx(sum(values) / len(values))
