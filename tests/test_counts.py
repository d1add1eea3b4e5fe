"""Stored value counts: loads add up to the ranking of the whole table."""

from __future__ import annotations

from pathlib import Path

import pytest

from levelfield.operators.ranking import percentile_within
from levelfield.sources.counts import PercentileCounts

KEYS, BASES = ["season", "grp", "metric"], ["per90", "padj"]
SCHEMA = "id int, season string, grp string, metric string, per90 double, padj double"


def rows_of(season, start, n=40):
    return [
        (start + k, season, "ab"[k % 2] if k % 7 else None, "m", float(k * 37 % 11), float(k % 5) if k % 3 else None)
        for k in range(n)
    ]


def answer(df):
    names = ["id", *[f"percentile_{b}" for b in BASES]]
    return sorted((r.id, *[None if r[n] is None else round(r[n], 9) for n in names[1:]]) for r in df.select(names).collect())


def whole(df):
    return answer(percentile_within(df, KEYS, {b: f"percentile_{b}" for b in BASES}))


def files(path, kind):
    return {p: p.stat().st_mtime_ns for p in Path(path, kind).rglob("*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    return PercentileCounts(spark, str(tmp_path / "counts"), KEYS, BASES)


def test_loads_add_up(spark, table):
    seasons = [None, "", "2021", "20/21"]
    rows = [r for k, s in enumerate(seasons) for r in rows_of(s, 1000 * k)]
    every = spark.createDataFrame(rows + rows[:9], SCHEMA)
    table.load(every.where("id % 3 = 0"))
    table.load(every.where("id % 3 <> 0"))
    assert answer(table.ranked(every)) == whole(every)


def test_a_load_rewrites_its_season_only(spark, table):
    old = spark.createDataFrame(rows_of("2020", 0) + rows_of("2021", 100), SCHEMA)
    assert len(table.load(old)) == 2
    before = {kind: files(table.path, kind) for kind in ("counts", "shares")}
    new = spark.createDataFrame(rows_of("2021", 200, 25), SCHEMA)
    assert len(table.load(new)) == 1
    for kind, held in before.items():
        after = files(table.path, kind)
        assert {p: after[p] for p in held} == held
        folders = {p.parent.name for p in after.keys() - held.keys()}
        assert folders == {"__part=x" + "2021".encode().hex().upper()}
    assert answer(table.ranked(old.union(new))) == whole(old.union(new))


def test_rows_that_left(spark, table):
    rows = rows_of("2020", 0)
    every = spark.createDataFrame(rows, SCHEMA)
    table.load(every)
    moved = [(i, s, g, m, v + 1, w) for i, s, g, m, v, w in rows[:10]]
    table.load(spark.createDataFrame(moved, SCHEMA), removed=spark.createDataFrame(rows[:10], SCHEMA))
    now = spark.createDataFrame(moved + rows[10:], SCHEMA)
    assert answer(table.ranked(now)) == whole(now)
    table.load(removed=now)
    assert all(r[1:] == (None, None) for r in answer(table.ranked(now)))


def test_rows_never_added_stop_the_load(spark, table):
    every = spark.createDataFrame(rows_of("2020", 0), SCHEMA)
    table.load(every)
    with pytest.raises(Exception, match="never added"):
        table.load(removed=spark.createDataFrame([(1, "2020", "a", "m", 99.0, None)], SCHEMA))
    assert answer(table.ranked(every)) == whole(every)


def test_nothing_loaded(spark, table):
    none = spark.createDataFrame([], SCHEMA)
    assert table.load(none) == [] and table.load() == []
    assert table.ranked(none).count() == 0
    blank = spark.createDataFrame([(1, "2020", "a", "m", None, None)], SCHEMA)
    assert table.load(blank) == []
    assert answer(table.ranked(blank)) == [(1, None, None)]
