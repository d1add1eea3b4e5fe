"""Population queries: thresholds, rates, shrinkage, percentiles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelfield import catalog
from levelfield.catalog import DEMO_METRICS, KEYS
from levelfield.operators import percentiles, rates, teams
from levelfield.plans.registry import query
from levelfield.plans.sqlbase import RATED, settled, using
from levelfield.plans.workspace import CONFIGURED_MINUTES, THRESHOLD_RATIO, Workspace
from levelfield.session import materialise, shared_folder
from levelfield.sources.counts import PercentileCounts

_RATED = list(RATED)


def rounded(df: DataFrame, decimals: int = 6, *columns: str) -> DataFrame:
    """Round every double so row order cannot show in the last bits."""
    names = columns or [f.name for f in df.schema if f.dataType.typeName() == "double"]
    return df.withColumns({n: rates.settled(F.col(n), decimals) for n in names})


_PERCENTILE_COLUMNS = """
  select league, season, team, player, position_group, "minutes", metric, label, value,
    per90, padj, shrunk, higher_is_better, cast(round(cast(percentile_per90 as decimal(28, 9)), 6) as double) as percentile_per90,
    cast(round(cast(percentile_padj as decimal(28, 9)), 6) as double) as percentile_padj, cast(round(cast(percentile_shrunk as decimal(28, 9)), 6) as double) as percentile_shrunk
  from percentiles
"""


@query("population_percentiles", using("percentiles", _PERCENTILE_COLUMNS))
def population_percentiles(ws: Workspace) -> DataFrame:
    return rounded(ws.compute_percentiles())


def _loaded_in_two(ws: Workspace) -> tuple[PercentileCounts, DataFrame]:
    """Stored counts after two loads, half of the teams each, and all their rows."""
    wide = percentiles.rated_population(ws.players, DEMO_METRICS, ws.thresholds, ws.possession)
    long = materialise(percentiles.metrics_long(wide, DEMO_METRICS), "metrics_long")
    keys = [*catalog.POPULATION_KEYS["position"], "metric"]
    stored = PercentileCounts(ws.spark, f"{shared_folder(ws.spark)}/counts-{uuid.uuid4().hex}", keys)
    for half in (0, 1):
        stored.load(long.where(F.pmod(F.xxhash64("team"), F.lit(2)) == half))
    return stored, long


@query("stored_percentiles", using("percentiles", _PERCENTILE_COLUMNS))
def stored_percentiles(ws: Workspace) -> DataFrame:
    """The percentiles of ``population_percentiles``, from counts two loads have merged."""
    stored, long = _loaded_in_two(ws)
    ranked = stored.ranked(long)
    direction = F.col("higher_is_better")
    return rounded(
        ranked.withColumns(
            {f"percentile_{b}": percentiles.orient(F.col(f"percentile_{b}"), direction) for b in catalog.BASES}
        )
    )


@query(
    "stored_value_counts",
    using(
        "metrics_long",
        " union all ".join(
            f"""select season, position_group, metric, '{b}' as basis, count({b}) as n
            from metrics_long group by season, position_group, metric having count({b}) > 0"""
            for b in catalog.BASES
        ),
    ),
)
def stored_value_counts(ws: Workspace) -> DataFrame:
    """Rows behind every stored population, metric and basis after two loads."""
    stored, long = _loaded_in_two(ws)
    groups = ["season", "position_group", "metric", "basis"]
    return stored.counts(long).groupBy(*groups).agg(F.sum("n").alias("n"))


@query(
    "build_entities",
    using(
        "players",
        f"""select {", ".join(KEYS)}, entity_id, position_raw, position_group, "minutes",
        matches_played, {", ".join(_RATED)} from players""",
    ),
)
def build_entities(ws: Workspace) -> DataFrame:
    return ws._build_players().select(
        *KEYS, "entity_id", "position_raw", "position_group", "minutes", "matches_played", *_RATED
    )


@query("adaptive_threshold", using("thresholds", "select * from thresholds"))
def adaptive_threshold(ws: Workspace) -> DataFrame:
    df = rates.adaptive_threshold(ws.players, CONFIGURED_MINUTES, THRESHOLD_RATIO)
    return df.withColumn("max_minutes", F.col("max_minutes").cast("bigint"))


@query(
    "eligible_population",
    using("eligible", f'select {", ".join(KEYS)}, position_group, "minutes" from eligible'),
)
def eligible_population(ws: Workspace) -> DataFrame:
    return rates.eligible(ws.players, ws.thresholds).select(*KEYS, "position_group", "minutes")


@query(
    "exposure_rates",
    using(
        "players",
        f"""select {", ".join(KEYS)}, "minutes", {", ".join(
            f'''case when "minutes" > 0 then
            {settled(f'cast({m} as double) / ("minutes" / 90.0::double)', 6)} end as {m}_p90'''
            for m in _RATED)} from players""",
    ),
)
def exposure_rates(ws: Workspace) -> DataFrame:
    df = rates.per_90(ws.players, DEMO_METRICS)
    return rounded(df.select(*KEYS, "minutes", *[f"{m}_p90" for m in _RATED]))


@query(
    "team_possession",
    using(
        "possession",
        "select league, season, team, cast(round(cast(possession_pct as decimal(28, 9)), 6) as double) as possession_pct from possession",
    ),
)
def team_possession(ws: Workspace) -> DataFrame:
    return rounded(rates.team_possession(ws.teams))


@query(
    "possession_adjust",
    using(
        "eligible possession",
        f"""select {", ".join(KEYS)}, cast(round(cast(possession_pct as decimal(28, 9)), 6) as double) as possession_pct,
        {settled('cast(tackles as double) / ("minutes" / 90.0::double)', 6)} as tackles_p90,
        {settled('cast(tackles as double) / ("minutes" / 90.0::double)'
                 ' * (50 / (100 - possession_pct))', 6)} as tackles_padj
        from eligible left join possession using (league, season, team)""",
    ),
)
def possession_adjust(ws: Workspace) -> DataFrame:
    wide = rates.per_90(rates.eligible(ws.players, ws.thresholds), DEMO_METRICS)
    adjusted = rates.possession_adjust(wide, DEMO_METRICS, ws.possession)
    return rounded(adjusted.select(*KEYS, "possession_pct", "tackles_p90", "tackles_padj"))


@query(
    "shrunk_rates",
    using(
        "metrics_long",
        f"""select {", ".join(KEYS)}, {", ".join(
            f"max(shrunk) filter (metric = '{m}') as {m}_shrunk" for m in _RATED)}
        from metrics_long group by all""",
    ),
)
def shrunk_rates(ws: Workspace) -> DataFrame:
    wide = rates.per_90(rates.eligible(ws.players, ws.thresholds), DEMO_METRICS)
    shrunk = rates.shrunk_rates(wide, DEMO_METRICS)
    return rounded(shrunk.select(*KEYS, *[f"{m}_shrunk" for m in _RATED]))


@query(
    "metrics_long",
    using(
        "metrics_long",
        """select league, season, team, player, position_group, "minutes", metric, label,
        value, per90, padj, shrunk, higher_is_better from metrics_long""",
    ),
)
def metrics_long(ws: Workspace) -> DataFrame:
    wide = percentiles.rated_population(ws.players, DEMO_METRICS, ws.thresholds, ws.possession)
    return rounded(percentiles.metrics_long(wide, DEMO_METRICS))


@query(
    "percentiles_wide",
    using(
        "percentiles",
        f"""select {", ".join(KEYS)}, {", ".join(
            f"cast(round(cast(max(percentile_per90) filter (metric = '{m}') as decimal(28, 9)), 6) as double) as {m}" for m in _RATED)}
        from percentiles group by all""",
    ),
)
def percentiles_wide(ws: Workspace) -> DataFrame:
    return rounded(percentiles.percentiles_wide(ws.percentiles, _RATED))


@query(
    "reliability",
    using(
        "players",
        " union all ".join(
            f"""select {", ".join(KEYS)}, '{m}' as metric, case when "minutes" > 0
            then {settled(f'"minutes" / ("minutes" + {half}.0::double)', 3)} else 0 end
            as reliability from players"""
            for m, (_, _, half, _) in RATED.items()
        ),
    ),
)
def reliability(ws: Workspace) -> DataFrame:
    cells = [
        F.struct(F.lit(m).alias("metric"), rates.reliability("minutes", m).alias("reliability"))
        for m in _RATED
    ]
    return ws.players.select(*KEYS, F.inline(F.array(*cells)))


@query(
    "slow_metrics",
    using(
        "metrics_long",
        """select metric, cast(case when metric in ('goals', 'np_goals') then 1400 else 1100 end
          as int) as half_life,
        cast(round(cast(avg("minutes" / ("minutes" + case when metric in ('goals', 'np_goals')
          then 1400.0::double else 1100.0::double end)) as decimal(28, 9)), 6) as double) as mean_weight
        from metrics_long where metric in ('assists', 'goals', 'np_goals') group by metric""",
    ),
)
def slow_metrics(ws: Workspace) -> DataFrame:
    """Metrics that do not settle in a long season, with the weight they reach here."""
    slow = {m: k for m, k in catalog.HALF_LIFE.items() if k >= catalog.SLOW_HALF_LIFE}
    played = rates.eligible(ws.players, ws.thresholds)
    cells = [
        F.struct(
            F.lit(m).alias("metric"),
            F.lit(k).alias("half_life"),
            rates.weight("minutes", k).alias("w"),
        )
        for m, k in sorted(slow.items())
    ]
    long = played.select(F.inline(F.array(*cells)))
    return long.groupBy("metric", "half_life").agg(rates.settled(F.avg("w"), 6).alias("mean_weight"))


@query(
    "population_size",
    using(
        "percentiles",
        """select season, position_group, count(distinct (player, team)) as population_size
        from percentiles group by all""",
    ),
)
def population_size(ws: Workspace) -> DataFrame:
    return percentiles.population_size(ws.percentiles, "position_group")


@query(
    "population_context",
    using(
        "players thresholds",
        """select season, count(distinct league) as leagues, any_value(max_minutes) as max_minutes,
        any_value(min_minutes) as min_minutes, cast(200 as int) as configured_min_minutes
        from players join thresholds using (season) group by season""",
    ),
)
def population_context(ws: Workspace) -> DataFrame:
    df = percentiles.population_context(ws.players, CONFIGURED_MINUTES, THRESHOLD_RATIO)
    return df.withColumn("max_minutes", F.col("max_minutes").cast("bigint"))


@query(
    "percentile_stats",
    using(
        "percentiles",
        """select count(distinct (league, season, team, player)) as entities,
        count(distinct metric) as metrics,
        count(distinct (season, position_group)) as populations from percentiles""",
    ),
)
def percentile_stats(ws: Workspace) -> DataFrame:
    return percentiles.percentile_stats(ws.percentiles, ("season", "position_group"))


@query(
    "build_teams",
    using(
        "teams",
        """select league, season, team, perspective, matches_played, xg, np_xg, goals,
        deep_completions, passes_attempted, ppda from teams""",
    ),
)
def build_teams(ws: Workspace) -> DataFrame:
    return ws._build_teams()


@query(
    "team_season_rollup",
    using(
        "teams",
        """select league, season, team, perspective, matches_played as matches, xg, np_xg, goals,
        deep_completions, ppda from teams""",
    ),
)
def team_season_rollup(ws: Workspace) -> DataFrame:
    return rounded(teams.season_rollup(ws.matches()), 4)
