"""Profile queries: lookups, comparisons, changes, similarity and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelfield import catalog
from levelfield.catalog import DEMO_METRICS, KEYS
from levelfield.operators import insights, percentiles, profiles, similarity
from levelfield.plans.population import rounded
from levelfield.plans.registry import query
from levelfield.plans.sqlbase import percentile_sql, settled, using
from levelfield.plans.workspace import CONFIGURED_MINUTES, THRESHOLD_RATIO, Workspace

K = ", ".join(KEYS)
_DIRECTED = catalog.directed(DEMO_METRICS)
_DIRECTED_SQL = ", ".join(f"'{m}'" for m in _DIRECTED)


def _profile(ws: Workspace) -> DataFrame:
    return profiles.entity_profile(ws.percentiles)


def _charted(ws: Workspace) -> DataFrame:
    return profiles.profile_on_template(_profile(ws), ws.axes)


@query(
    "entity_search",
    using(
        "players",
        f"""select {K}, position_group, "minutes" from players
        where season = '1998' and position_group = 'MF'
          and regexp_matches(player, 'customer#0+[1-4]', 'i')
        order by "minutes" desc, {K} limit 50 offset 5""",
    ),
)
def entity_search(ws: Workspace) -> DataFrame:
    page = profiles.search(
        ws.players, "1998", position_group="MF", name="customer#0+[1-4]", offset=5
    )
    return page.select(*KEYS, "position_group", "minutes")


@query(
    "lookup_by_name",
    using(
        "percentiles",
        f"""select {K}, metric, cast(round(cast(percentile_per90 as decimal(28, 9)), 6) as double) as percentile_per90 from percentiles
        where case when exists (select 1 from percentiles where lower(player) = '00000007')
          then lower(player) = '00000007' else contains(lower(player), '00000007') end""",
    ),
)
def lookup_by_name(ws: Workspace) -> DataFrame:
    found = profiles.by_name(ws.percentiles, "00000007")
    return rounded(found.select(*KEYS, "metric", "percentile_per90"))


@query(
    "ambiguous_entities",
    using(
        "fixtures",
        """select season, player, count(distinct team) as teams
        from (select season, home_league as player, home_team as team from fixtures
          union all select season, away_league, away_team from fixtures)
        group by season, player having count(distinct team) > 1""",
    ),
)
def ambiguous_entities(ws: Workspace) -> DataFrame:
    """A customer has one team, so leagues play the name and their teams the stints."""
    played = ws.matches()
    sides = [
        played.select("season", F.col(f"{s}_league").alias("player"), F.col(f"{s}_team").alias("team"))
        for s in ("home", "away")
    ]
    return profiles.ambiguous_entities(sides[0].unionByName(sides[1]))


@query(
    "entity_profile",
    using(
        "profile",
        f"""select {K}, position_group, metric, label, total, per90, padj,
        cast(round(cast(percentile as decimal(28, 9)), 6) as double) as percentile, higher_is_better, team_dependent,
        cast(place as int) as place from profile""",
    ),
)
def entity_profile(ws: Workspace) -> DataFrame:
    return rounded(_profile(ws))


@query(
    "extreme_metrics",
    using(
        "profile",
        f"""select {K}, metric, label, percentile, kind,
        concat_ws('; ', case when team_dependent then 'team_dependent' end,
          case when population_size < 50 then 'small_population' end) as note,
        cast(rank as int) as rank
        from (
          select * exclude (percentile), whole as percentile,
            case when higher_is_better is null then 'rasgo' when whole >= 90 then 'fortaleza'
              else 'debilidad' end as kind,
            row_number() over (partition by {K} order by abs(whole - 50) desc, place) as rank
          from (select *, cast(round_even(percentile, 0) as int) as whole from profile)
          where whole >= 90 or whole <= 10)
        join (select season, position_group, count(distinct (player, team)) as population_size
              from percentiles group by all) using (season, position_group)
        where rank <= 6""",
    ),
)
def extreme_metrics(ws: Workspace) -> DataFrame:
    return profiles.extreme_metrics(_profile(ws), ws.population_sizes)


@query(
    "profile_summary",
    using(
        "profile",
        f"""select {K}, max(part) filter (n = 1) as best, max(part) filter (n = 2) as second
        from (select *, lower(label) || ' (' || cast(round_even(percentile, 0) as int) || ')' as part,
            row_number() over (partition by {K} order by percentile desc, place) as n
          from profile where higher_is_better and percentile is not null)
        where n <= 2 group by {K}""",
    ),
)
def profile_summary(ws: Workspace) -> DataFrame:
    return profiles.profile_summary(_profile(ws))


@query(
    "entity_strengths",
    using(
        "percentiles",
        f"""select {K}, metric, label, cast(round(cast(percentile_per90 as decimal(28, 9)), 6) as double) as percentile_per90,
        cast(place as int) as place from (
          select *, row_number() over (partition by {K}
            order by percentile_per90 desc, metric) as place
          from percentiles where percentile_per90 >= 85 and higher_is_better)
        where place <= 4""",
    ),
)
def entity_strengths(ws: Workspace) -> DataFrame:
    return rounded(profiles.entity_strengths(ws.percentiles))


@query(
    "metric_leaders",
    using(
        "percentiles",
        f"""select season, metric, cast(place as int) as place, league, team, player,
        cast(round(cast(percentile_per90 as decimal(28, 9)), 6) as double) as percentile_per90 from (
          select *, row_number() over (partition by season, metric
            order by percentile_per90 desc nulls last, {K}) as place from percentiles)
        where place <= 6""",
    ),
)
def metric_leaders(ws: Workspace) -> DataFrame:
    return rounded(profiles.metric_leaders(ws.percentiles))


@query(
    "family_profile",
    using(
        "percentiles families",
        f"""select {K}, family, {settled("avg(percentile_per90)", 1)} as percentile
        from percentiles join families using (metric)
        where percentile_per90 is not null group by {K}, family""",
    ),
)
def family_profile(ws: Workspace) -> DataFrame:
    return profiles.family_profile(ws.percentiles)


@query(
    "profile_on_template",
    using("charted", f"select {K}, axis, metric, label, family, percentile, missing from charted"),
)
def profile_on_template(ws: Workspace) -> DataFrame:
    return _charted(ws)


_PAIR = """
  pair as (
    select axis, metric, label, family, max(percentile) filter (n = 1) as percentile_a,
      max(percentile) filter (n = 2) as percentile_b
    from charted join targets using (league, season, team, player) group by all)
"""


@query(
    "compare_on_template",
    using(
        "charted targets",
        """select *, percentile_b - percentile_a as gap,
        percentile_a is not null and percentile_b is not null as shared from pair""",
        _PAIR,
    ),
)
def compare_on_template(ws: Workspace) -> DataFrame:
    return profiles.compare_on_template(_charted(ws), ws.is_target(0), ws.is_target(1))


@query(
    "largest_gap",
    using(
        "charted targets",
        """select label, percentile_a, percentile_b, abs(percentile_b - percentile_a) as width
        from pair where abs(percentile_b - percentile_a) >= 10
        order by width desc, label desc limit 1""",
        _PAIR,
    ),
)
def largest_gap(ws: Workspace) -> DataFrame:
    return profiles.largest_gap(compare_on_template(ws))


@query(
    "common_axes",
    using(
        "charted targets",
        """select metric, case when percentile_a is not null and percentile_b is not null
          then 'shared' else 'missing' end as status from pair""",
        _PAIR,
    ),
)
def common_axes(ws: Workspace) -> DataFrame:
    return profiles.common_axes(_charted(ws), ws.is_target(0), ws.is_target(1))


@query(
    "compare_entities",
    using(
        "percentiles targets",
        """select metric, label, cast(round(cast(max(percentile_per90) filter (n = 1) as decimal(28, 9)), 6) as double) as percentile_a,
        cast(round(cast(max(percentile_per90) filter (n = 2) as decimal(28, 9)), 6) as double) as percentile_b,
        cast(round(cast(max(percentile_per90) filter (n = 1) - max(percentile_per90) filter (n = 2) as decimal(28, 9)), 6) as double) as gap
        from percentiles join targets using (league, season, team, player) group by metric, label
        having max(position_group) filter (n = 1) = max(position_group) filter (n = 2)
          and gap is not null""",
    ),
)
def compare_entities(ws: Workspace) -> DataFrame:
    return rounded(
        profiles.compare_entities(ws.percentiles, ws.is_target(0), ws.is_target(1))
    )


_CHANGE = """
  previous as materialized (
    select season, lag(season) over (order by season) as previous
    from (select distinct season from players)),
  whole as materialized (
    select player, season, team, metric, label, cast(round_even(percentile, 0) as int) as p
    from profile),
  change as (
    select n.player, n.season, n.team, n.metric, n.label, x.previous, b.p as before, n.p as after,
      n.p - b.p as change
    from whole n join previous x using (season)
    join whole b on b.player = n.player and b.season = x.previous and b.metric = n.metric
    where n.p is not null and b.p is not null)
"""


@query(
    "season_change",
    using(
        "players profile",
        "select player, previous, metric, season, team, label, before, after, change from change",
        _CHANGE,
    ),
)
def season_change(ws: Workspace) -> DataFrame:
    changes = profiles.season_change(_profile(ws), ws.players)
    return changes.select(
        "player", "previous", "metric", "season", "team", "label", "before", "after", "change"
    )


@query(
    "biggest_change",
    using(
        "players profile",
        """select player, season, team, metric, label, before, after, change from change
        qualify row_number() over (partition by player, season, team
          order by abs(change) desc, metric desc) = 1""",
        _CHANGE,
    ),
)
def biggest_change(ws: Workspace) -> DataFrame:
    return profiles.biggest_change(season_change(ws))


@query(
    "profile_caveats",
    using(
        "players thresholds percentiles",
        f"""select {K}, position_group, population_size, concat_ws(',',
          case when leagues < 5 then 'few_leagues' end,
          case when min_minutes < 200 then 'lowered_threshold' end,
          case when population_size < 50 then 'fragile_population' end,
          case when position_group = 'DF' then 'mixed_group' end,
          case when position_group <> 'GK' then 'no_role' end) as caveats
        from (select distinct {K}, position_group from percentiles)
        join (select season, count(distinct league) as leagues from players group by season)
          using (season)
        join thresholds using (season)
        join (select season, position_group, count(distinct (player, team)) as population_size
              from percentiles group by all) using (season, position_group)""",
    ),
)
def profile_caveats(ws: Workspace) -> DataFrame:
    context = percentiles.population_context(ws.players, CONFIGURED_MINUTES, THRESHOLD_RATIO)
    entities = (
        ws.percentiles.select(*KEYS, "position_group")
        .distinct()
        .join(context, "season")
        .join(ws.population_sizes, ["season", "position_group"], "left")
        .withColumn("detailed_position", F.lit(None).cast("string"))
    )
    return profiles.profile_caveats(entities).select(
        *KEYS,
        "position_group",
        "population_size",
        F.array_join("caveats", ",").alias("caveats"),
    )


@query(
    "entity_report_rows",
    using(
        "profile families",
        f"""select {K}, cast(line as int) as line, label, total, per90,
        cast(round(cast(percentile as decimal(28, 9)), 6) as double) as percentile from (
          select *, row_number() over (partition by {K} order by place) as line
          from profile where metric in (select metric from families) and percentile is not null)
        where line <= 10""",
    ),
)
def entity_report_rows(ws: Workspace) -> DataFrame:
    return rounded(profiles.report_rows(_profile(ws)))


def _nearest_sql(basis: str, population: str, n: int, source: str = "percentiles") -> str:
    return f""", scored as (
          select c.league, c.season, c.team, c.player, max(c."minutes") as "minutes",
            sqrt(sum(pow(coalesce(c.percentile_{basis} - t.percentile_{basis}, 0), 2))) as distance,
            (1 - distance / (100 * sqrt(max(t.axes)))) * 100 as similarity,
            list(c.metric order by abs(coalesce(c.percentile_{basis} - t.percentile_{basis}, 0)),
              c.metric) as near
          from (select *, count(*) over () as axes from {source} p
                join targets g using (league, season, team, player)
                where n = 1 and percentile_{basis} is not null and metric in ({_DIRECTED_SQL})) t
          join {source} c on c.metric = t.metric and c.season = t.season
            and c.{population} = t.{population}
            and (c.league, c.team, c.player) <> (t.league, t.team, t.player)
          group by c.league, c.season, c.team, c.player having max(t.axes) >= 4),
        nearest as (
        select league, season, team, player, "minutes", round(similarity, 1) as similarity,
          near[1] || ', ' || near[2] as closest, near[-1] || ', ' || near[-2] as furthest
        from scored order by distance, league, season, team, player limit {n})
        """


def _nearest_query(basis: str, n: int, body: str = "select * from nearest", extra: str = "") -> str:
    whole = using(
        f"percentiles targets {extra}", _nearest_sql(basis, "position_group", n) + body
    )
    return whole.replace("\n, scored", ",\nscored")


@query("nearest_profiles", _nearest_query("per90", 6))
def nearest_profiles(ws: Workspace) -> DataFrame:
    target = ws.targets()[0].asDict()
    return similarity.nearest_profiles(ws.percentiles, target, _DIRECTED)


@query("nearest_shrunk", _nearest_query("shrunk", 6))
def nearest_shrunk(ws: Workspace) -> DataFrame:
    """Neighbours on the rates corrected for small samples."""
    target = ws.targets()[0].asDict()
    return similarity.nearest_profiles(ws.percentiles, target, _DIRECTED, basis="shrunk")


@query("report_comparables", _nearest_query("per90", 5))
def report_comparables(ws: Workspace) -> DataFrame:
    """The five comparables of a report."""
    target = ws.targets()[0].asDict()
    return similarity.nearest_profiles(
        ws.percentiles, target, _DIRECTED, n=catalog.REPORT_COMPARABLES
    )


@query(
    "neighbour_families",
    _nearest_query(
        "per90",
        6,
        f"""select {K}, cast(place as int) as place, family,
          {settled("avg(percentile_per90)", 1)} as percentile
        from percentiles join families using (metric) join (
          select {K}, row_number() over (order by similarity desc, {K}) as place from nearest
          union all select {K}, 0 from targets where n = 1) using ({K})
        where percentile_per90 is not null group by {K}, place, family""",
        "families",
    ),
)
def neighbour_families(ws: Workspace) -> DataFrame:
    """Family profile of the target and of each of its neighbours."""
    target = ws.targets()[0].asDict()
    return similarity.with_families(ws.percentiles, nearest_profiles(ws), target)


@query(
    "nearest_in_role",
    using(
        "players metrics_long targets",
        _nearest_sql("per90", "detailed_position", 6, "roled") + "select * from nearest",
        f"""roled as (
          select * exclude (raw), case when higher_is_better = false then 100 - raw else raw end
            as percentile_per90
          from (select *, {percentile_sql("per90", "season, detailed_position")} as raw
            from metrics_raw join (select {K}, position_raw as detailed_position from players)
              using ({K})))""",
    ).replace("\n, scored", ",\nscored"),
)
def nearest_in_role(ws: Workspace) -> DataFrame:
    """Neighbours within the same stated role, on percentiles against that role."""
    stated = ws.players.withColumn("detailed_position", F.col("position_raw"))
    ranked = ws.stored(
        "role_percentiles",
        lambda: percentiles.population_percentiles(
            stated, DEMO_METRICS, ws.thresholds, ws.possession, catalog.POPULATION_KEYS["role"]
        ),
        "season",
    )
    target = ws.targets()[0].asDict()
    return similarity.nearest_profiles(ranked, target, _DIRECTED, population="detailed_position")


@query(
    "search_by_role",
    using(
        "players",
        f"""select {K}, position_raw as detailed_position, "minutes" from players
        where season = '1998' and position_raw = 'M F S'
        order by "minutes" desc, {K} limit 50""",
    ),
)
def search_by_role(ws: Workspace) -> DataFrame:
    """A page of the entities of one role; here the role is the one the source states."""
    stated = ws.players.withColumn("detailed_position", F.col("position_raw"))
    page = profiles.search(stated, "1998", role="M F S")
    return page.select(*KEYS, "detailed_position", "minutes")


_BASES_SQL = " union all ".join(
    f"""select {K}, metric, '{b}' as basis, cast(place as int) as place, percentile from (
      select {K}, metric, {settled(f"percentile_{b}", 6)} as percentile,
        row_number() over (partition by {K} order by percentile_{b} desc nulls last, metric) as place
      from percentiles where metric in ('yellow_cards', 'red_cards')
        or (position_group <> 'GK' and metric not in ('fouls_committed', 'tackles')))"""
    for b in ("padj", "shrunk")
)


@query("profile_on_bases", using("percentiles", _BASES_SQL))
def profile_on_bases(ws: Workspace) -> DataFrame:
    """Profiles on the adjusted and on the shrunk rates."""
    parts = [
        profiles.entity_profile(ws.percentiles, basis).select(
            *KEYS, "metric", F.lit(basis).alias("basis"), "place", "percentile"
        )
        for basis in ("padj", "shrunk")
    ]
    return rounded(parts[0].unionByName(parts[1]))


@query(
    "report_extremes",
    using(
        "profile",
        f"""select {K}, metric, percentile, cast(rank as int) as rank from (
          select {K}, metric, whole as percentile,
            row_number() over (partition by {K} order by abs(whole - 50) desc, place) as rank
          from (select *, cast(round_even(percentile, 0) as int) as whole from profile)
          where whole >= 90 or whole <= 10) where rank <= 4""",
    ),
)
def report_extremes(ws: Workspace) -> DataFrame:
    """The four extremes of a report."""
    found = profiles.extreme_metrics(
        _profile(ws), ws.population_sizes, limit=catalog.REPORT_EXTREMES
    )
    return found.select(*KEYS, "metric", "percentile", "rank")


@query(
    "biggest_differences",
    using(
        "percentiles targets",
        f"""select metric, label, {settled("a", 6)} as percentile_a, {settled("b", 6)} as percentile_b,
          {settled("a - b", 6)} as gap
        from (select metric, label, max(percentile_per90) filter (n = 1) as a,
            max(percentile_per90) filter (n = 2) as b,
            max(position_group) filter (n = 1) = max(position_group) filter (n = 2) as together
          from percentiles join targets using (league, season, team, player) group by metric, label)
        where together and a - b is not null order by abs(a - b) desc, metric limit 3""",
    ),
)
def biggest_differences(ws: Workspace) -> DataFrame:
    """The three differences a short answer names."""
    return rounded(
        profiles.compare_entities(
            ws.percentiles, ws.is_target(0), ws.is_target(1), catalog.SHORT_DIFFERENCES
        )
    )


@query(
    "overperformer",
    using(
        "players",
        f"""select season, league, team, player, cast(np_goals as bigint) as np_goals, np_xg,
          cast(round(cast(np_goals - np_xg as decimal(28, 9)), 6) as double) as difference
        from players where np_xg >= 1 and np_goals - np_xg > 0
        qualify row_number() over (partition by season
          order by np_goals - np_xg desc, {K}) = 1""",
    ),
)
def overperformer(ws: Workspace) -> DataFrame:
    return rounded(insights.overperformer(ws.players))


@query(
    "young_standout",
    using(
        "players profiles percentiles",
        f"""select p.season, p.league, p.team, p.player, age, b.metric,
          cast(round(cast(b.percentile as decimal(28, 9)), 6) as double) as percentile
        from players p join profiles using (entity_id)
        join (select {K}, max(percentile_per90) as percentile,
                first(metric order by percentile_per90 desc nulls last, metric) as metric
              from percentiles where metric in ({_DIRECTED_SQL}) group by {K}) b
          using ({K})
        where age <= 21 and b.percentile >= 90
        qualify row_number() over (partition by p.season
          order by age, p.league, p.season, p.team, p.player) = 1""",
    ),
)
def young_standout(ws: Workspace) -> DataFrame:
    ages = ws.profiles.select("entity_id", "age")
    return rounded(insights.young_standout(ws.players, ages, ws.percentiles, _DIRECTED))


@query(
    "sharpest_contrast",
    using(
        "percentiles families",
        f"""select season, league, team, player, high_family, cast(round(cast(high as decimal(28, 9)), 6) as double) as high, low_family,
          cast(round(cast(low as decimal(28, 9)), 6) as double) as low
        from (select {K}, count(*) as n, max(m) as high, min(m) as low,
            first(family order by m desc, family desc) as high_family,
            first(family order by m, family) as low_family
          from (select {K}, family, avg(percentile_per90) as m
                from percentiles join families using (metric) group by all) group by {K})
        where n = 3
        qualify row_number() over (partition by season
          order by cast(round(cast(high - low as decimal(28, 9)), 6) as double) desc, {K}) = 1""",
    ),
)
def sharpest_contrast(ws: Workspace) -> DataFrame:
    return rounded(insights.sharpest_contrast(ws.percentiles))


@query(
    "metric_catalog",
    using(
        "metrics_long",
        """select metric, label, higher_is_better, metric = 'tackles' as possession_sensitive,
          metric in ('xg_chain', 'xg_buildup') as team_dependent, count(value) as measured
        from metrics_long group by all""",
    ),
)
def metric_catalog(ws: Workspace) -> DataFrame:
    """The rated metrics, how to read them and how many entities have each."""
    sensitive = [m.name for m in DEMO_METRICS if "chances" in m.traits]
    dependent = [m.name for m in DEMO_METRICS if "team" in m.traits]
    return ws.percentiles.groupBy("metric", "label", "higher_is_better").agg(
        F.first(F.col("metric").isin(*sensitive)).alias("possession_sensitive"),
        F.first(F.col("metric").isin(*dependent)).alias("team_dependent"),
        F.count("value").alias("measured"),
    )


@query(
    "template_axes",
    using(
        "percentiles families",
        """select position_group, axis, metric, label, family, count(*) as entities
        from percentiles join families using (metric)
        where position_group in ('DF', 'MF', 'FW') group by all""",
    ),
)
def template_axes(ws: Workspace) -> DataFrame:
    """Chart axes per group with the entities that can be drawn on them."""
    present = ws.percentiles.groupBy("position_group", "metric").agg(
        F.count("*").alias("entities")
    )
    return ws.axes.join(present, ["position_group", "metric"])


@query(
    "metric_labels",
    using(
        "percentiles families",
        f"""select {K}, metric, case when metric in ('fouls_committed', 'tackles') then metric
          else label end as label from percentiles""",
    ),
)
def metric_labels(ws: Workspace) -> DataFrame:
    """Metric id → label of the live catalogue, the id itself when unknown."""
    known = F.create_map(
        *[F.lit(x) for m in catalog.PLAYER_METRICS for x in (m.name, m.label)]
    )
    label = F.coalesce(F.try_element_at(known, F.col("metric")), F.col("metric"))
    return ws.percentiles.select(*KEYS, "metric", label.alias("label"))
