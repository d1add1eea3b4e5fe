"""Market queries: valuations, squads, scouting, rosters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelfield.catalog import KEYS
from levelfield.functions import parse
from levelfield.operators import clusters, market, profiles, quality, rates, teams
from levelfield.plans.registry import query
from levelfield.plans.sqlbase import settled, using
from levelfield.plans.workspace import Workspace

K = ", ".join(KEYS)
# Fixed value: address of a club crest.
CREST_PATTERN = "https://img.a.transfermarkt.technology/wappen/big/%s.png"
TODAY = "2001-03-01"


def _day(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in columns})


@query(
    "latest_value",
    using(
        "valuations",
        """select entity_id, strftime(valuation_date, '%Y-%m-%d') as valuation_date, market_value
        from latest""",
    ),
)
def latest_value(ws: Workspace) -> DataFrame:
    return _day(ws.latest, "valuation_date")


@query(
    "value_peak",
    using(
        "valuations",
        """select v.entity_id, count(*) as valuations, any_value(l.market_value) as current_value,
        max(v.market_value) as peak_value, current_value < peak_value as below_peak
        from valuations v join latest l using (entity_id) group by v.entity_id""",
    ),
)
def value_peak(ws: Workspace) -> DataFrame:
    return market.value_peak(ws.valuations, ("valuation_date", "valuation_id"))


@query(
    "squad_market",
    using(
        "players profiles valuations",
        f"""select {K}, age, position, market_value
        from players join profiles using (entity_id) join latest using (entity_id)""".replace(
            K, "players.league, players.season, players.team, players.player"
        ),
    ),
)
def squad_market(ws: Workspace) -> DataFrame:
    return market.squad_market(ws.players, ws.profiles, ws.latest)


@query(
    "market_context",
    using(
        "profiles valuations",
        """select entity_id, age, position, nationality,
        strftime(contract_until, '%Y-%m-%d') as contract_until, market_value
        from profiles left join latest using (entity_id)""",
    ),
)
def market_context(ws: Workspace) -> DataFrame:
    return _day(market.market_context(ws.profiles, ws.latest), "contract_until")


def _disclosed(ws: Workspace) -> DataFrame:
    """Latest values; a large one is not disclosed, so that coverage differs between teams."""
    return ws.latest.withColumn(
        "market_value", F.when(F.col("market_value") < 200000, F.col("market_value"))
    )


@query(
    "team_market_value",
    using(
        "players valuations",
        """select league, season, team, strftime(max(valuation_date), '%Y-%m-%d') as valuation_date,
        cast(sum(cast(market_value as decimal(18, 2))) as double) as market_value,
        count(market_value) as squad_size, count(distinct player) as squad_total
        from players left join (select * replace (case when market_value < 200000 then market_value end
          as market_value) from latest) using (entity_id)
        group by league, season, team
        having count(market_value) / count(distinct player) >= 0.7""",
    ),
)
def team_market_value(ws: Workspace) -> DataFrame:
    values = market.team_market_value(ws.players, _disclosed(ws))
    return _day(values, "valuation_date").withColumn(
        "market_value", F.col("market_value").cast("double")
    )


_SQUAD = """
  squad as (
    select p.league, p.season, p.team, p.player, f.age, f.position, l.market_value
    from players p join profiles f using (entity_id) join latest l using (entity_id))
"""


@query(
    "squad_age_value",
    using(
        "players profiles valuations",
        f"""select league, season, team, count(*) as players, {settled("avg(age)", 1)} as mean_age,
        cast(sum(cast(market_value as decimal(18, 2))) as double) as total_value,
        count(*) filter (age <= 23) as young, count(*) filter (age >= 30) as veterans,
        {settled('''coalesce(cast(sum(cast(market_value as decimal(18, 2))) filter (age <= 23)
          as double), 0) / cast(sum(cast(market_value as decimal(18, 2))) as double) * 100''', 4)}
          as young_share
        from squad where age is not null and market_value <> 0 group by league, season, team""",
        _SQUAD,
    ),
)
def squad_age_value(ws: Workspace) -> DataFrame:
    return market.squad_age_value(squad_market(ws))


@query(
    "squad_by_value",
    using(
        "players profiles valuations",
        """select league, season, team, player, age, position, market_value,
          cast(place as int) as place
        from (select *, row_number() over (partition by league, season, team
          order by coalesce(market_value, 0) desc, player) as place from squad)
        where place <= 6""",
        _SQUAD,
    ),
)
def squad_by_value(ws: Workspace) -> DataFrame:
    return market.squad_by_value(squad_market(ws))


_SCOUTED = """
  scouted as (
    select p.league, p.season, p.team, p.player, p.position_group, p."minutes", f.age,
      strftime(contract_until, '%Y-%m-%d') as contract_until,
      case when contract_until is not null then cast(greatest(0,
        (year(contract_until) - 2001) * 12 + month(contract_until) - 3) as int) end as months_left,
      market_value, metric, label, percentile_per90
    from percentiles p
    left join players y using (league, season, team, player)
    left join profiles f on f.entity_id = y.entity_id
    left join latest l on l.entity_id = y.entity_id
    where metric = 'np_xg' and percentile_per90 >= 80)
"""


def _scout(ws: Workspace, **bounds) -> DataFrame:
    context = market.market_context(ws.profiles, ws.latest)
    return market.scouting_search(
        ws.percentiles, ws.players, context, "np_xg", F.lit(TODAY).cast("date"), **bounds
    )


@query(
    "scouting_search",
    using(
        "percentiles profiles valuations players",
        f"""select * exclude (percentile_per90), {settled("percentile_per90", 1)} as percentile
        from scouted where age <= 27 and months_left <= 18 and market_value <= 300000
        order by percentile_per90 desc, {K} limit 25""",
        _SCOUTED,
    ),
)
def scouting_search(ws: Workspace) -> DataFrame:
    hits = _scout(ws, max_age=27, max_months_left=18, max_value=300_000)
    return _day(hits, "contract_until")


@query(
    "context_coverage",
    using(
        "percentiles profiles valuations players",
        """select count(*) as rows, count(*) filter (age is null) as without_context
        from scouted""",
        _SCOUTED,
    ),
)
def context_coverage(ws: Workspace) -> DataFrame:
    return market.context_coverage(_scout(ws, limit=None))


@query(
    "months_left",
    using(
        "profiles",
        """select entity_id, case when contract_until is not null then cast(greatest(0,
        (year(contract_until) - 2001) * 12 + month(contract_until) - 3) as int) end as months_left
        from profiles""",
    ),
)
def months_left(ws: Workspace) -> DataFrame:
    left = parse.months_left("contract_until", F.lit(TODAY).cast("date"))
    return ws.profiles.select("entity_id", left.alias("months_left"))


@query(
    "entity_card",
    using(
        "profiles valuations",
        """select 'profile' as part, nationality as detail, cast(age as double) as amount,
          strftime(contract_until, '%Y-%m-%d') as day from profiles where entity_id = '8'
        union all
        select 'market_value', cast(valuation_id as varchar), market_value,
          strftime(valuation_date, '%Y-%m-%d') from valuations where entity_id = '8'
        union all
        select 'transfers', o_orderpriority, o_totalprice, strftime(o_orderdate, '%Y-%m-%d')
        from orders where o_custkey = 8""",
    ),
)
def entity_card(ws: Workspace) -> DataFrame:
    """The three parts of one entity's card, stacked."""
    moves = ws.table("orders").select(
        F.col("o_custkey").cast("string").alias("entity_id"),
        F.to_date("o_orderdate").alias("transfer_date"),
        F.col("o_orderpriority").alias("kind"),
        F.col("o_totalprice").alias("fee"),
    )
    card = market.entity_card(ws.profiles, ws.valuations, moves, "8")
    shape = {
        "profile": ("nationality", "age", "contract_until"),
        "market_value": ("valuation_id", "market_value", "valuation_date"),
        "transfers": ("kind", "fee", "transfer_date"),
    }
    parts = [
        card[part].select(
            F.lit(part).alias("part"),
            F.col(detail).cast("string").alias("detail"),
            F.col(amount).cast("double").alias("amount"),
            F.date_format(day, "yyyy-MM-dd").alias("day"),
        )
        for part, (detail, amount, day) in shape.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "season_roster",
    using("players", "select season, league, team, player, entity_id from players"),
)
def season_roster(ws: Workspace) -> DataFrame:
    return market.season_roster(ws.players)


@query(
    "stale_entities",
    using(
        "players",
        """select season, league, team, player, entity_id from players
        where entity_id not in (select cast(o_custkey as varchar) from orders
          where o_orderdate > timestamp '2001-08-02' - interval 4000 hour)""",
    ),
)
def stale_entities(ws: Workspace) -> DataFrame:
    read = ws.table("orders").select(
        F.col("o_custkey").cast("string").alias("entity_id"), "o_orderdate"
    )
    now = F.lit("2001-08-02").cast("timestamp")
    return market.stale_entities(ws.players, read, "o_orderdate", now, freshness_hours=4000)


@query(
    "teams_of",
    using("players", "select distinct season, league, team from players"),
)
def teams_of(ws: Workspace) -> DataFrame:
    return teams.teams_of(ws.players)


@query(
    "team_cards",
    using(
        "players",
        """select league, season, team, count(*) as squad_size,
        case when n_nationkey % 5 <> 0 then
          'https://img.a.transfermarkt.technology/wappen/big/' || n_nationkey || '.png' end
          as crest_url
        from players join nation on team = n_name group by all""",
    ),
)
def team_cards(ws: Workspace) -> DataFrame:
    clubs = ws.table("nation").where("n_nationkey % 5 <> 0").select(
        F.col("n_name").alias("team"), F.col("n_nationkey").cast("string").alias("external_id")
    )
    identities = ws.players.select(*teams.TEAM_KEYS).distinct().join(clubs, "team")
    return teams.team_cards(ws.players, identities, CREST_PATTERN)


@query(
    "catalog_values",
    using(
        "players",
        """select distinct 'season' as kind, season as "value" from players
        union all select distinct 'league', league from players""",
    ),
)
def catalog_values(ws: Workspace) -> DataFrame:
    return quality.catalog_values(ws.players)


@query(
    "distinct_keys",
    using("percentiles", f"select distinct {K} from percentiles"),
)
def distinct_keys(ws: Workspace) -> DataFrame:
    return ws.percentiles.select(*KEYS).distinct()


@query(
    "scan_entities",
    using(
        "players",
        """select league, team, player, position_group, "minutes", shots from players
        where season = '1997'""",
    ),
)
def scan_entities(ws: Workspace) -> DataFrame:
    """Every league of one season; leagues are never filtered before ranking."""
    kept = ws.players.where("season = '1997'")
    return kept.select("league", "team", "player", "position_group", "minutes", "shots")


@query(
    "format_amount",
    """select o_orderkey, replace(format('{:,.1f}', o_totalprice * 1000 / 1e6), ',', '.')
    || ' M EUR' as shown from orders""",
)
def format_amount(ws: Workspace) -> DataFrame:
    shown = parse.format_amount(F.col("o_totalprice") * 1000)
    return ws.table("orders").select("o_orderkey", shown.alias("shown"))


@query(
    "unranked_entities",
    using(
        "players eligible",
        f"""select {K}, "minutes" from players where ({K}) not in (select ({K}) from eligible)""",
    ),
)
def unranked_entities(ws: Workspace) -> DataFrame:
    ranked = rates.eligible(ws.players, ws.thresholds)
    return clusters.unranked_entities(ws.players, ranked).select(*KEYS, "minutes")


@query(
    "tool_profile",
    using(
        "percentiles",
        f"""select {K}, max("minutes") as "minutes", count(*) filter (
          percentile_per90 >= 85 and higher_is_better) as strong
        from percentiles where lower(player) = lower('Customer#000000004') group by {K}""",
    ),
)
def tool_profile(ws: Workspace) -> DataFrame:
    """What stands out about one entity, found by name."""
    found = profiles.by_name(ws.percentiles, "customer#000000004")
    strong = (F.col("percentile_per90") >= 85) & F.col("higher_is_better")
    return found.groupBy(*KEYS).agg(
        F.max("minutes").alias("minutes"), F.count_if(strong).alias("strong")
    )
