"""Common table expressions the oracle queries are put together from.

Written by hand against the raw tables, independently of the Spark plans.
"""

from __future__ import annotations

# name -> (direction, possession sensitive, half-life, label)
RATED = {
    "goals": ("true", False, 1400, "Goles"),
    "np_goals": ("true", False, 1400, "Goles sin penaltis"),
    "np_xg": ("true", False, 750, "xG sin penaltis"),
    "shots": ("true", False, 450, "Tiros"),
    "assists": ("true", False, 1100, "Asistencias"),
    "xa": ("true", False, 700, "xA (asistencias esperadas)"),
    "key_passes": ("true", False, 500, "Pases clave"),
    "xg_chain": ("true", False, 500, "xGChain"),
    "xg_buildup": ("true", False, 550, "xGBuildup"),
    "yellow_cards": ("null", False, 900, "Tarjetas amarillas"),
    "red_cards": ("null", False, 900, "Tarjetas rojas"),
    "fouls_committed": ("false", False, 900, "Faltas"),
    "tackles": ("true", True, 900, "Entradas"),
}
KEYS = "league, season, team, player"

def settled(value: str, decimals: int) -> str:
    """Round a floating-point sum or mean, its noise cut at nine decimals."""
    return f"cast(round(cast({value} as decimal(28, 9)), {decimals}) as double)"


_LINES = """
order_lines as (
  select l_orderkey, sum(l_quantity) as played,
    count(*) filter (l_returnflag = 'R') as goals,
    count(*) filter (l_returnflag = 'R' and l_linenumber <> 1) as np_goals,
    sum(l_discount * l_quantity) as np_xg, count(*) as shots,
    count(*) filter (l_returnflag = 'A') as assists,
    sum(l_tax * l_quantity) as xa,
    count(*) filter (l_linestatus = 'O') as key_passes,
    sum(l_linenumber * l_quantity) as built,
    count(*) filter (l_tax >= 0.06) as yellow_cards,
    count(*) filter (l_discount >= 0.09) as red_cards,
    count(*) filter (l_quantity < 10) as fouls_committed,
    count(*) filter (month(l_shipdate) <= 6) as tackles
  from lineitem group by l_orderkey)
"""

_COUNTS = (
    "goals np_goals shots assists key_passes yellow_cards red_cards fouls_committed tackles"
).split()

_PEOPLE = """
people as (
  select c_custkey, r_name as league, n_name as team, c_name as player, c_mktsegment as segment
  from customer join nation on c_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey)
"""

_PLAYERS = f"""
player_totals as (
  select o_custkey, cast(year(o_orderdate) as varchar) as season,
    cast(sum(played) as bigint) as "minutes", count(*) as matches_played,
    {", ".join(f"cast(sum({c}) as bigint) as {c}" for c in _COUNTS)},
    round(sum(np_xg), 4) as np_xg, round(sum(xa), 4) as xa,
    round(sum(built) / 100.0, 4) as xg_buildup
  from order_lines join orders on l_orderkey = o_orderkey group by all),
players as (
  select league, season, team, player, cast(c_custkey as varchar) as entity_id,
    case segment when 'BUILDING' then 'D S' when 'MACHINERY' then 'M F S'
      when 'AUTOMOBILE' then 'fw,mf' when 'FURNITURE' then 'GK' else 'S' end as position_raw,
    case segment when 'BUILDING' then 'DF' when 'MACHINERY' then 'MF'
      when 'AUTOMOBILE' then 'FW' when 'FURNITURE' then 'GK' end as position_group,
    "minutes", matches_played, {", ".join(_COUNTS)}, np_xg, xa, xg_buildup,
    round(np_xg + xa + xg_buildup, 4) as xg_chain
  from player_totals join people on o_custkey = c_custkey)
"""

_THRESHOLDS = """
thresholds as (
  select season, max("minutes") as max_minutes,
    greatest(1, cast(floor(least(200.0::double, 0.3::double * max("minutes"))) as int)) as min_minutes
  from players group by season)
"""

_ELIGIBLE = """
eligible as (
  select p.* from players p join thresholds t using (season)
  where p."minutes" >= t.min_minutes and position_group is not null)
"""

_SIDES = ("xg", "np_xg", "goals", "deep_completions", "passes_attempted")
_MATCHES = """
fixtures as (
  select cast(year(o_orderdate) as varchar) as season,
    hr.r_name as home_league, hn.n_name as home_team,
    ar.r_name as away_league, an.n_name as away_team,
    l_discount * l_quantity as home_xg, l_tax * l_quantity as away_xg,
    l_discount * (l_quantity - 1) as home_np_xg, l_tax * (l_quantity - 1) as away_np_xg,
    cast(l_returnflag = 'R' as int) as home_goals, cast(l_returnflag = 'A' as int) as away_goals,
    l_linenumber as home_deep_completions, floor(l_quantity / 10) as away_deep_completions,
    l_quantity / l_linenumber as home_ppda, l_linenumber + 5.0::double as away_ppda,
    l_quantity as home_passes_attempted, l_linenumber * 8.0::double as away_passes_attempted
  from lineitem join orders on l_orderkey = o_orderkey
  join supplier on l_suppkey = s_suppkey join nation hn on s_nationkey = hn.n_nationkey
  join region hr on hn.n_regionkey = hr.r_regionkey
  join customer on o_custkey = c_custkey join nation an on c_nationkey = an.n_nationkey
  join region ar on an.n_regionkey = ar.r_regionkey)
"""


def _stack(perspective: str) -> str:
    parts = []
    for side, rival in (("home", "away"), ("away", "home")):
        shown = side if perspective == "for" else rival
        cols = ", ".join(f"{shown}_{m} as {m}" for m in (*_SIDES, "ppda"))
        parts.append(
            f"select {side}_league as league, season, {side}_team as team, {cols} from fixtures"
        )
    return " union all ".join(parts)


_TEAMS = f"""
teams as (
  {" union all ".join(
    f'''select league, season, team, '{p}' as perspective, count(*) as matches_played,
    round(sum(xg), 4) as xg, round(sum(np_xg), 4) as np_xg,
    cast(sum(goals) as double) as goals, cast(sum(deep_completions) as double) as deep_completions,
    cast(sum(passes_attempted) as double) as passes_attempted, round(avg(ppda), 4) as ppda
    from ({_stack(p)}) group by league, season, team''' for p in ("for", "against"))})
"""

_POSSESSION = """
possession as (
  select f.league, f.season, f.team,
    greatest(25.0::double, least(75.0::double,
      f.passes_attempted / (f.passes_attempted + a.passes_attempted) * 100)) as possession_pct
  from teams f join teams a using (league, season, team)
  where f.perspective = 'for' and a.perspective = 'against')
"""

_LONG = """
rated as (
""" + " union all ".join(
    f"""
  select {KEYS}, position_group, "minutes", '{name}' as metric, '{label}' as label,
    cast({name} as double) as value,
    cast({name} as double) / ("minutes" / 90.0::double) as per90,
    {f'cast({name} as double) / ("minutes" / 90.0::double)'
     ' * (50.0::double / (100.0::double - possession_pct))' if sensitive
     else 'cast(null as double)'} as padj,
    cast({direction} as boolean) as higher_is_better, {half}.0::double as half_life
  from eligible left join possession using (league, season, team)"""
    for name, (direction, sensitive, half, label) in RATED.items()
) + f"""),
with_means as (
  select *, avg(per90) over (partition by league, season, position_group, metric) as mean_rate
  from rated),
metrics_raw as (
  select * exclude (mean_rate, half_life),
    ("minutes" / ("minutes" + half_life)) * per90
      + (1.0::double - "minutes" / ("minutes" + half_life)) * mean_rate as shrunk
  from with_means),
metrics_long as (
  select * exclude (per90, padj, shrunk),
    {settled("per90", 6)} as per90, {settled("padj", 6)} as padj,
    {settled("shrunk", 6)} as shrunk
  from metrics_raw)
"""


def percentile_sql(measure: str, keys: str) -> str:
    """Average-tie rank over the non-null values, as two counts."""
    return f"""case when {measure} is not null then
      (rank() over (partition by {keys}, metric order by {measure} nulls last)
       + count({measure}) over (partition by {keys}, metric order by {measure} nulls last
           range between unbounded preceding and current row)) / 2.0::double
      / count({measure}) over (partition by {keys}, metric) * 100 end"""


_PERCENTILES = f"""
ranked as (
  select *, {", ".join(
      f"{percentile_sql(b, 'season, position_group')} as raw_{b}"
      for b in ("per90", "padj", "shrunk"))}
  from metrics_raw),
percentiles as (
  select * exclude (raw_per90, raw_padj, raw_shrunk, per90, padj, shrunk),
    {settled("per90", 6)} as per90, {settled("padj", 6)} as padj,
    {settled("shrunk", 6)} as shrunk,
    {", ".join(
      f"case when higher_is_better = false then 100 - raw_{b} else raw_{b} end as percentile_{b}"
      for b in ("per90", "padj", "shrunk"))}
  from ranked)
"""

_PLAYER_MATCHES = """
player_matches as (
  select cast(o_orderkey as varchar) as game_id, cast(o_custkey as varchar) as entity_id,
    cast(year(o_orderdate) as varchar) as season,
    strftime(o_orderdate, '%Y-%m-%d') || ' ' || lpad(cast(o_orderkey as varchar), 12, '0')
      as match_label,
    o_orderpriority as position, cast(played as bigint) as "minutes", goals, shots, assists,
    case when o_orderstatus <> 'P' then round(np_xg, 4) end as xg, round(xa, 4) as xa
  from order_lines join orders on l_orderkey = o_orderkey)
"""

_RAW_SHOTS = """
raw_shots as (
  select cast(event_id as varchar) as shot_id, strftime(ts, '%Y') as season,
    strftime(ts, '%Y%m%d%H') as game_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as "date",
    cast(user_id as varchar) as player_id, cast(minute(ts) as varchar) as "minute",
    round("value" / 100.0::double, 4) as xg,
    round(0.8::double + cast(props->>'k' as int) / 1000.0::double, 4) as location_x,
    0.5::double as location_y,
    case when event_type <> 'error' then event_type end as situation,
    case when event_type = 'purchase' then 'Goal' else 'MissedShot' end as result
  from events)
"""

_SHOTS = """
shots as (
  select shot_id, season, game_id, cast("date"[:10] as date) as match_date,
    player_id as entity_id, cast("minute" as bigint) as "minute", xg, location_x, location_y,
    case when situation is null and abs(location_x - 0.885::double) <= 0.005::double
      and abs(location_y - 0.5::double) <= 0.005::double then 'Penalty' else situation end
      as situation, result
  from raw_shots)
"""

_VALUATIONS = """
valuations as (
  select cast(o_custkey as varchar) as entity_id, cast(o_orderdate as date) as valuation_date,
    o_orderkey as valuation_id, o_totalprice as market_value from orders),
latest as (
  select entity_id, max(valuation_date) as valuation_date,
    max_by(market_value, (valuation_date, valuation_id)) as market_value
  from valuations group by entity_id)
"""

_PROFILES = """
profiles as (
  select cast(c_custkey as varchar) as entity_id, player as player_name,
    case when c_custkey % 11 <> 0 then cast(c_custkey % 23 + 16 as int) end as age,
    segment as position, team as nationality,
    case when c_custkey % 7 <> 0
      then date '2001-01-15' + cast(c_custkey % 900 as int) end as contract_until
  from people)
"""

_FAMILIES = """
families as (
  select * from (values
    (0, 'np_goals', 'Finalización'), (1, 'np_xg', 'Finalización'), (2, 'shots', 'Finalización'),
    (3, 'assists', 'Creación'), (4, 'xa', 'Creación'), (5, 'key_passes', 'Creación'),
    (6, 'xg_chain', 'Construcción'), (7, 'xg_buildup', 'Construcción')) t(axis, metric, family))
"""

_TARGETS = """
targets as (
  select league, season, team, player,
    row_number() over (order by "minutes" desc, league, season, team, player) as n
  from percentiles where season = '2000' and position_group = 'FW' and metric = 'shots'
  qualify n <= 2)
"""

_PROFILE = """
profile as (
  select league, season, team, player, position_group, metric, label, value as total, per90, padj,
    percentile_per90 as percentile, higher_is_better,
    metric in ('xg_chain', 'xg_buildup') as team_dependent,
    row_number() over (partition by league, season, team, player
      order by percentile_per90 desc nulls last, metric) as place
  from percentiles
  where metric in ('yellow_cards', 'red_cards')
    or (position_group <> 'GK' and metric not in ('fouls_committed', 'tackles')))
"""

_TEAM_SHOTS = """
team_shots as (
  select cast(year(o_orderdate) as varchar) as season, cast(l_orderkey as varchar) as game_id,
    n_name as team, cast(l_shipdate as date) as match_date, l_linenumber as "minute",
    round(l_discount * l_quantity, 2) as xg,
    case when l_linenumber = 1 then 'Penalty' else 'OpenPlay' end as situation,
    case when l_returnflag = 'R' then 'Goal' else 'SavedShot' end as result,
    l_partkey as shot_id
  from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey
  join nation on s_nationkey = n_nationkey)
"""

_CHARTED = """
charted as (
  select p.league, p.season, p.team, p.player, axis, metric, l.label, family,
    cast(greatest(0, least(100, round_even(v.percentile, 0))) as int) as percentile,
    v.percentile is null as missing
  from (select distinct league, season, team, player, position_group from profile
        where position_group in ('DF', 'MF', 'FW')) p
  cross join families
  join (select distinct metric, label from percentiles) l using (metric)
  left join profile v using (league, season, team, player, metric))
"""

# name -> (text, parts it needs), in dependency order.
_PARTS = {
    "order_lines": (_LINES, ()),
    "people": (_PEOPLE, ()),
    "players": (_PLAYERS, ("order_lines", "people")),
    "thresholds": (_THRESHOLDS, ("players",)),
    "eligible": (_ELIGIBLE, ("thresholds",)),
    "fixtures": (_MATCHES, ()),
    "teams": (_TEAMS, ("fixtures",)),
    "possession": (_POSSESSION, ("teams",)),
    "metrics_long": (_LONG, ("eligible", "possession")),
    "percentiles": (_PERCENTILES, ("metrics_long",)),
    "player_matches": (_PLAYER_MATCHES, ("order_lines",)),
    "raw_shots": (_RAW_SHOTS, ()),
    "shots": (_SHOTS, ("raw_shots",)),
    "valuations": (_VALUATIONS, ()),
    "profiles": (_PROFILES, ("people",)),
    "families": (_FAMILIES, ()),
    "targets": (_TARGETS, ("percentiles",)),
    "profile": (_PROFILE, ("percentiles",)),
    "charted": (_CHARTED, ("profile", "families")),
    "team_shots": (_TEAM_SHOTS, ()),
}


def using(names: str, body: str, extra: str = "") -> str:
    """``with`` clause for the named parts (and ``extra`` ones) followed by ``body``."""
    wanted: set[str] = set()

    def need(name: str) -> None:
        for parent in _PARTS[name][1]:
            need(parent)
        wanted.add(name)

    for name in names.split():
        need(name)
    texts = [text.strip() for name, (text, _) in _PARTS.items() if name in wanted]
    if extra:
        texts.append(extra.strip())
    if not texts:
        return body.strip()
    return "with " + ",\n".join(texts) + "\n" + body.strip()
