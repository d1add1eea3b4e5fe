"""Neighbours of every entity in one answer."""

from __future__ import annotations

from pyspark.sql import DataFrame

from levelfield import catalog
from levelfield.catalog import DEMO_METRICS, KEYS
from levelfield.operators import neighbours
from levelfield.plans.population import rounded
from levelfield.plans.registry import query
from levelfield.plans.sqlbase import settled, using
from levelfield.plans.workspace import Workspace

K = ", ".join(KEYS)
_DIRECTED = list(catalog.directed(DEMO_METRICS))


def _all_sql(basis: str, n: int, min_minutes: int) -> str:
    axes = ", ".join(f"'{m}'" for m in _DIRECTED)
    return f"""
        select league, season, team, player, position_group, cast(place as int) as place,
          near_league, near_team, near_player, near_minutes, {settled("distance", 6)} as distance,
          {settled("(1 - distance / (100 * sqrt(axes))) * 100", 1)} as similarity
        from (
          select *, row_number() over (partition by {K}, position_group
            order by cast(distance as decimal(28, 9)), near_league, near_team, near_player) as place
          from (
            select t.league, t.season, t.team, t.player, t.position_group, max(t.axes) as axes,
              c.league as near_league, c.team as near_team, c.player as near_player,
              max(c."minutes") as near_minutes,
              sqrt(sum(pow(coalesce(c.percentile_{basis} - t.percentile_{basis}, 0), 2))) as distance
            from (select *, count(percentile_{basis}) over (partition by {K}, position_group) as axes
                  from percentiles where metric in ({axes})) t
            join percentiles c on c.metric = t.metric and c.season = t.season
              and c.position_group = t.position_group
              and (c.league, c.team, c.player) <> (t.league, t.team, t.player)
            where t.axes >= 4 and coalesce(c."minutes", 0) >= {min_minutes}
            group by all))
        where place <= {n}
        """


@query("all_neighbours", using("percentiles", _all_sql("per90", 6, 0)))
def all_neighbours(ws: Workspace) -> DataFrame:
    return rounded(neighbours.all_neighbours(ws.percentiles, _DIRECTED))


@query("all_regular_neighbours", using("percentiles", _all_sql("shrunk", 2, 400)))
def all_regular_neighbours(ws: Workspace) -> DataFrame:
    """On the rates corrected for small samples, among entities with enough exposure."""
    return rounded(neighbours.all_neighbours(ws.percentiles, _DIRECTED, "shrunk", 2, 400))
