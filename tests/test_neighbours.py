"""Neighbours of every entity against brute force, with small blocks and gaps."""

import random

import numpy as np
import pytest

from levelfield.operators import neighbours

METRICS = ["a", "b", "c", "d", "e", "f"]
SCHEMA = "league string, season string, team string, player string, position_group string, minutes int, metric string, percentile_per90 double"


def _table(seed, n=260):
    rng = random.Random(seed)
    out = {}
    for k in range(n):
        key = (f"L{k % 3}", rng.choice(["1", "2"]), f"T{rng.randrange(5)}", f"P{k:04d}", rng.choice(["DF", "MF", None]))
        kind = rng.random()
        if kind < 0.3:
            axes = [50.0] * 6  # a third of the profiles are alike: ties only
        elif kind < 0.6:
            axes = [rng.choice([None, 10.0 * rng.randrange(11)]) for _ in METRICS]
        else:
            axes = [rng.random() * 100 for _ in METRICS]
        out[key] = (rng.choice([None, 100, 900]), axes)
    return out


def _rows(table):
    return [(*key, minutes, m, v) for key, (minutes, axes) in table.items() for m, v in zip(METRICS, axes)]


def _brute(table, n, least):
    out = set()
    for t, (_, own) in table.items():
        known = [k for k, v in enumerate(own) if v is not None]
        if t[4] is None or len(known) < 4:
            continue
        found = []
        for c, (minutes, axes) in table.items():
            if c[:4] == t[:4] or (c[1], c[4]) != (t[1], t[4]) or (minutes or 0) < least:
                continue
            far = sum((own[k] - axes[k]) ** 2 for k in known if axes[k] is not None) ** 0.5
            found.append((round(far, 9), c[:4], minutes))
        for place, (far, c, minutes) in enumerate(sorted(found)[:n], 1):
            out.add((*t[:4], place, c[0], c[2], c[3], minutes, round(far, 6)))
    return out


@pytest.mark.parametrize(("block", "least"), [(1024, 0), (7, 0), (3, 500)])
def test_all_neighbours_equal_brute_force(make, monkeypatch, block, least):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    table = _table(block + least)
    df = make(SCHEMA, _rows(table) + _rows(table)[:40])  # repeated rows count once
    got = neighbours.all_neighbours(df, METRICS, n=4, min_minutes=least).collect()
    told = {
        (r.league, r.season, r.team, r.player, r.place, r.near_league, r.near_team, r.near_player, r.near_minutes, round(r.distance, 6))
        for r in got
    }
    assert len(told) == len(got) and told == _brute(table, 4, least)
    assert all(0 <= r.similarity <= 100 for r in got)


def test_no_rows_and_too_few_axes(make):
    assert neighbours.all_neighbours(make(SCHEMA, []), METRICS).collect() == []
    lone = [("L", "1", "T", "P", "DF", 9, m, 50.0) for m in METRICS]
    few = [("L", "1", "T", "Q", "DF", 9, m, 50.0) for m in METRICS[:3]]
    got = neighbours.all_neighbours(make(SCHEMA, lone + few), METRICS).collect()
    assert [(r.player, r.near_player, r.distance) for r in got] == [("P", "Q", 0.0)]


def test_boxes_hold_every_row_once():
    rng = np.random.default_rng(1)
    vectors = rng.random((1000, 4))
    vectors[rng.random((1000, 4)) < 0.1] = np.nan
    rows = list(neighbours.boxes(vectors, 64))
    assert max(map(len, rows)) <= 64 and sorted(np.concatenate(rows)) == list(range(1000))


def test_far_boxes_are_not_met(make, monkeypatch):
    """Two far clusters of one group: their blocks never meet, and no plan has a cross join."""
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = random.Random(3)
    rows = []
    for k in range(128):
        base = 10.0 if k % 2 else 80.0
        rows += [("L", "1", "T", f"P{k:03d}", "DF", 9, m, base + rng.random()) for m in METRICS]
    sizes = []
    real = neighbours.materialise

    def seen(df, name, by=None):
        if name == "meetings":
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        out = real(df, name, by)
        if name == "meetings":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "materialise", seen)
    assert neighbours.all_neighbours(make(SCHEMA, rows), METRICS, n=3).count() == 128 * 3
    assert sizes[0] <= 2 * 6 * 6  # of 14 x 13 or more pairs of blocks


@pytest.mark.parametrize(("cell", "least"), [(16, 0), (2, 500)])
def test_copies_of_a_profile_are_searched_once(make, monkeypatch, cell, least):
    """600 entities of 30 profiles: the work is that of 30, the answers are those of all."""
    monkeypatch.setattr(neighbours, "BLOCK", 4)
    monkeypatch.setattr(neighbours, "CELL", cell)
    rng = random.Random(5)
    kinds = [[rng.choice([None, 100 * rng.random()]) if k < 2 else 100 * rng.random() for k in range(6)] for _ in range(30)]
    keys = [(f"L{k % 3}", "1", f"T{rng.randrange(5)}", f"P{k:04d}", "DF") for k in range(600)]
    table = {key: (rng.choice([None, 100, 900]), kinds[k % 30]) for k, key in enumerate(keys)}
    blocks = []
    real = neighbours.materialise

    def seen(df, name, by=None):
        out = real(df, name, by)
        if name == "blocks":
            blocks.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "materialise", seen)
    got = neighbours.all_neighbours(make(SCHEMA, _rows(table)), METRICS, n=4, min_minutes=least).collect()
    told = {
        (r.league, r.season, r.team, r.player, r.place, r.near_league, r.near_team, r.near_player, r.near_minutes, round(r.distance, 6))
        for r in got
    }
    assert len(told) == len(got) and told == _brute(table, 4, least)
    assert blocks[0] <= 30  # of 150 or more, were every copy in them
