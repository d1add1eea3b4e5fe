"""Event queries: shots, conceded shots, matches, form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelfield.functions import parse
from levelfield.operators import events, teams
from levelfield.operators.clusters import STYLE_COLUMNS
from levelfield.plans.population import rounded
from levelfield.plans.registry import query
from levelfield.plans.sqlbase import settled, using
from levelfield.plans.workspace import Workspace
from levelfield.sources import shaping

_SHOT_COLUMNS = (
    "shot_id season game_id match_date entity_id minute xg location_x location_y situation result"
).split()
_SHOT_SQL = """shot_id, season, game_id, strftime(match_date, '%Y-%m-%d') as match_date, entity_id,
  "minute", xg, location_x, location_y, situation, result"""


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("match_date", F.date_format("match_date", "yyyy-MM-dd"))


@query("build_events", using("shots", f"select {_SHOT_SQL} from shots"))
def build_events(ws: Workspace) -> DataFrame:
    return _dated(shaping.build_shots(ws.raw_shots)).select(*_SHOT_COLUMNS)


@query(
    "label_special_events",
    using("shots", """select coalesce(situation, 'none') as situation, count(*) as shots
    from shots group by 1"""),
)
def label_special_events(ws: Workspace) -> DataFrame:
    raw = ws.raw_shots.withColumns(
        {c: F.col(c).cast("double") for c in ("location_x", "location_y")}
    )
    kind = F.coalesce(shaping.label_special_events(), F.lit("none"))
    return raw.groupBy(kind.alias("situation")).agg(F.count("*").alias("shots"))


@query(
    "scan_events",
    using(
        "shots",
        f"""select {_SHOT_SQL} from shots where season = '2024' and entity_id = '8'
        order by shots.match_date, shots."minute", shot_id""",
    ),
)
def scan_events(ws: Workspace) -> DataFrame:
    return _dated(events.entity_shots(ws.shots, "2024", "8")).select(*_SHOT_COLUMNS)


_NP = "filter (situation is distinct from 'Penalty')"
_SUMMARY = f"""
  summary as (
    select season, entity_id, count(*) as shots, count(*) {_NP} as np_shots,
      {settled("sum(coalesce(xg, 0))", 3)} as total_xg,
      {settled(f"coalesce(sum(coalesce(xg, 0)) {_NP}, 0)", 3)} as np_xg,
      count(*) filter (result = 'Goal') as goals,
      {settled(f"sum(coalesce(xg, 0)) {_NP} / nullif(count(*) {_NP}, 0)", 3)} as xg_per_shot
    from shots group by season, entity_id)
"""


@query(
    "event_summary",
    using("shots", "select *, np_shots < 10 as few_shots from summary", _SUMMARY),
)
def event_summary(ws: Workspace) -> DataFrame:
    return events.event_summary(ws.shots)


@query(
    "actual_vs_expected",
    using(
        "shots",
        f"""select season, entity_id, goals, np_xg, {settled("goals - np_xg", 3)} as difference,
        goals - np_xg >= 0 as above from summary""",
        _SUMMARY,
    ),
)
def actual_vs_expected(ws: Workspace) -> DataFrame:
    df = events.actual_vs_expected(events.event_summary(ws.shots))
    return df.select("season", "entity_id", "goals", "np_xg", "difference", "above")


@query(
    "event_mix",
    using(
        "shots",
        f"""select season, entity_id, coalesce(situation, 'Sin clasificar') as kind,
        count(*) as shots, {settled("avg(coalesce(xg, 0))", 3)} as mean_xg from shots group by all""",
    ),
)
def event_mix(ws: Workspace) -> DataFrame:
    return events.event_mix(ws.shots)


@query(
    "events_conceded",
    using(
        "team_shots",
        """select season, game_id, team, strftime(match_date, '%Y-%m-%d') as match_date, "minute",
          xg, situation, result, shot_id
        from team_shots where team <> 'NATION_7' and game_id in (
          select game_id from team_shots where season = '1997' and team = 'NATION_7')""",
    ),
)
def events_conceded(ws: Workspace) -> DataFrame:
    df = events.events_conceded(ws.team_shots, "1997", "NATION_7")
    return _dated(df).select(
        "season", "game_id", "team", "match_date", "minute", "xg", "situation", "result", "shot_id"
    )


_CONCEDED = f"""
  conceded as (
    select o.season, o.team, count(distinct r.game_id) as matches, count(r.game_id) as shots,
      {settled("coalesce(sum(r.xg), 0)", 3)} as xg_conceded,
      count(*) filter (r.result = 'Goal') as goals_conceded,
      {settled("sum(r.xg) filter (r.situation <> 'Penalty')"
               " / nullif(count(*) filter (r.situation <> 'Penalty'), 0)", 3)} as xg_per_shot
    from (select distinct season, game_id, team from team_shots) o
    left join team_shots r on r.game_id = o.game_id and r.team <> o.team
    group by o.season, o.team)
"""


@query("conceded_summary", using("team_shots", "select * from conceded", _CONCEDED))
def conceded_summary(ws: Workspace) -> DataFrame:
    df = events.conceded_summary(ws.team_shots)
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("shots", "goals_conceded")})


@query(
    "conceded_per_match",
    using(
        "team_shots",
        f"""select season, team, matches,
        {settled("shots / greatest(matches, 1)", 3)} as shots_per_match,
        {settled("xg_conceded / greatest(matches, 1)", 3)} as xg_per_match from conceded""",
        _CONCEDED,
    ),
)
def conceded_per_match(ws: Workspace) -> DataFrame:
    return events.conceded_per_match(conceded_summary(ws))


@query(
    "build_matches",
    using(
        "player_matches",
        """select game_id, entity_id, season, match_label, position, "minutes", goals, shots,
        assists, xg, xa from player_matches""",
    ),
)
def build_matches(ws: Workspace) -> DataFrame:
    raw = ws.raw_matches().withColumnsRenamed({"entity_id": "player_id", "match_label": "game"})
    text = raw.withColumns({c: F.col(c).cast("string") for c in ("minutes", "goals", "xg", "xa")})
    return shaping.build_matches(text).select(
        "game_id", "entity_id", "season", "match_label", "position", "minutes", "goals", "shots",
        "assists", "xg", "xa",
    )


@query(
    "scan_matches",
    using(
        "player_matches",
        """select game_id, match_label, "minutes", goals, xg from player_matches
        where season = '1999' and entity_id = '17'""",
    ),
)
def scan_matches(ws: Workspace) -> DataFrame:
    kept = ws.player_matches.where("season = '1999' and entity_id = '17'")
    return kept.select("game_id", "match_label", "minutes", "goals", "xg")


@query(
    "cumulative_trajectory",
    using(
        "player_matches",
        f"""select season, entity_id, match_label, position, "minutes", goals,
        {settled("coalesce(xg, 0)", 3)} as xg, assists, {settled("xa", 3)} as xa,
        cast(sum(goals) over w as bigint) as cumulative_goals,
        {settled("sum(coalesce(xg, 0)) over w", 3)} as cumulative_xg
        from player_matches
        window w as (partition by season, entity_id order by match_label, game_id
          rows between unbounded preceding and current row)""",
    ),
)
def cumulative_trajectory(ws: Workspace) -> DataFrame:
    return events.cumulative_trajectory(ws.player_matches)


@query(
    "entity_form",
    using(
        "player_matches",
        f"""select season, entity_id, count(*) as matches,
        case when sum("minutes") > 0 then
          {settled('sum(coalesce(xg, 0)) / sum("minutes") * 90', 3)} end as season_xg90,
        count(*) filter (n <= 5) as recent_matches,
        case when sum("minutes") filter (n <= 5) > 0 then {settled(
            'sum(coalesce(xg, 0)) filter (n <= 5) / sum("minutes") filter (n <= 5) * 90', 3)}
          end as recent_xg90,
        cast(sum("minutes") filter (n <= 5) as bigint) as recent_minutes,
        {settled("recent_xg90 - season_xg90", 3)} as delta_xg90, count(*) < 4 as few_matches
        from (select *, row_number() over (partition by season, entity_id
          order by match_label desc, game_id desc) as n from player_matches)
        group by season, entity_id""",
    ),
)
def entity_form(ws: Workspace) -> DataFrame:
    return events.entity_form(ws.player_matches)


_STYLE = """
  style as (
    select f.league, f.season, f.team, -f.ppda as pressing,
      f.deep_completions / f.matches_played as territory,
      f.np_xg / f.matches_played as chance_creation,
      -(a.np_xg / f.matches_played) as chance_prevention,
      (f.goals - f.np_xg) / f.matches_played as finishing,
      f.np_xg / nullif(f.deep_completions, 0) as chance_quality,
      -a.ppda as pressed, -(a.deep_completions / f.matches_played) as box_defence
    from teams f join teams a using (league, season, team)
    where f.perspective = 'for' and a.perspective = 'against')
"""


@query(
    "team_style_features",
    using(
        "teams",
        f"""select league, season, team, {", ".join(f"cast(round(cast({c} as decimal(28, 9)), 6) as double) as {c}" for c in STYLE_COLUMNS)}
        from style""",
        _STYLE,
    ),
)
def team_style_features(ws: Workspace) -> DataFrame:
    return rounded(teams.style_features(ws.teams))


@query(
    "style_map",
    using(
        "teams",
        """select league, season, team, cast(round(cast(territory as decimal(28, 9)), 6) as double) as territory,
        cast(round(cast(-pressing as decimal(28, 9)), 6) as double) as ppda from style
        where territory is not null and pressing is not null""",
        _STYLE,
    ),
)
def style_map(ws: Workspace) -> DataFrame:
    return rounded(teams.style_map(teams.style_features(ws.teams)))


@query(
    "band_metric",
    using(
        "teams",
        """select league, season, team, perspective, ppda,
        case when ppda < 10 then 'high' when ppda > 14 then 'low' else 'medium' end as pressing
        from teams""",
    ),
)
def band_metric(ws: Workspace) -> DataFrame:
    return ws.teams.select(
        "league", "season", "team", "perspective", "ppda",
        teams.pressing_band(F.col("ppda")).alias("pressing"),
    )


@query(
    "territorial_team",
    using(
        "teams",
        """select league, season, team, cast(round(cast(deep_completions / matches_played as decimal(28, 9)), 6) as double) as per_match
        from teams where perspective = 'for' order by deep_completions / matches_played desc,
        league, season, team limit 1""",
    ),
)
def territorial_team(ws: Workspace) -> DataFrame:
    return rounded(teams.territorial_team(ws.teams))


@query(
    "scan_teams",
    using(
        "teams",
        """select league, team, perspective, matches_played, goals from teams
        where season = '1999'""",
    ),
)
def scan_teams(ws: Workspace) -> DataFrame:
    kept = ws.teams.where("season = '1999'")
    return kept.select("league", "team", "perspective", "matches_played", "goals")


@query(
    "json_fields",
    """select event_id, cast(props->>'k' as int) as k,
      coalesce(props->>'missing', 'none') as missing from events""",
)
def json_fields(ws: Workspace) -> DataFrame:
    """Payload fields by name; absent ones are NULL and take a default."""
    read = F.from_json("props", "k int, missing string")
    return ws.table("events").select(
        "event_id", read["k"].alias("k"), F.coalesce(read["missing"], F.lit("none")).alias("missing")
    )


@query(
    "season_codes",
    """with d as (
      select o_orderkey, cast(o_orderdate as date) as day,
        year(o_orderdate) - case when month(o_orderdate) < 7 then 1 else 0 end as y from orders)
    select o_orderkey, lpad(cast(y % 100 as varchar), 2, '0')
        || lpad(cast((y + 1) % 100 as varchar), 2, '0') as code,
      lpad(cast(y % 100 as varchar), 2, '0') || '/'
        || lpad(cast((y + 1) % 100 as varchar), 2, '0') as label,
      y || '-' || (y + 1) as span,
      o_orderkey || 'x' as unchanged
    from d""",
)
def season_codes(ws: Workspace) -> DataFrame:
    code = parse.season_code(F.to_date("o_orderdate"))
    return ws.table("orders").select("o_orderkey", code.alias("code")).select(
        "o_orderkey",
        "code",
        parse.season_label("code").alias("label"),
        parse.season_span("code").alias("span"),
        parse.season_label(F.concat(F.col("o_orderkey").cast("string"), F.lit("x"))).alias(
            "unchanged"
        ),
    )
