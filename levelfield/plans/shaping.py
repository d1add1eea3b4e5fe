"""Source queries: readers of text, payloads, raw tables, guards and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelfield import catalog
from levelfield.catalog import DEMO_METRICS, KEYS
from levelfield.functions import parse, text
from levelfield.operators import quality
from levelfield.plans.population import rounded
from levelfield.plans.registry import query
from levelfield.plans.sqlbase import RATED, settled, using
from levelfield.plans.workspace import Workspace
from levelfield.session import spread
from levelfield.sources import payloads, shaping

K = ", ".join(KEYS)


def _day(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in columns})


# --- text ----------------------------------------------------------------------


@query(
    "slugify",
    r"""with t as (select p_partkey, '  ' || p_name || ' % ' || p_brand || '/' || p_type as raw
      from part)
    select p_partkey, trim(regexp_replace(replace(lower(trim(raw)), '%', ' pct'),
        '[^a-z0-9]+', '_', 'g'), '_') as slug,
      regexp_replace(trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')), ' ', '-', 'g')
        || '-1998.png' as file_name
    from t""",
)
def slugify(ws: Workspace) -> DataFrame:
    raw = F.concat(
        F.lit("  "), F.col("p_name"), F.lit(" % "), F.col("p_brand"), F.lit("/"), F.col("p_type")
    )
    return ws.table("part").select(
        "p_partkey",
        parse.slugify(raw).alias("slug"),
        text.file_slug(raw, F.lit("1998")).alias("file_name"),
    )


@query(
    "normalise_name",
    r"""select doc_id, trim(regexp_replace(lower(regexp_replace(
        strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) as folded
    from documents""",
)
def normalise_name(ws: Workspace) -> DataFrame:
    """Folding over whole texts in four languages."""
    return spread(ws.table("documents")).select("doc_id", text.normalise_name("text").alias("folded"))


@query(
    "parse_codes",
    """select c_custkey, cast(c_custkey % 23 + 16 as int) as age,
      case when c_custkey % 5 <> 0 then c_mktsegment end as nation,
      cast(null as int) as no_age
    from customer""",
)
def parse_codes(ws: Workspace) -> DataFrame:
    """Ages written years-days and country codes written after a short code."""
    key = F.col("c_custkey")
    age = F.concat_ws("-", (key % 23 + 16).cast("string"), (key % 365).cast("string"))
    nation = F.when(key % 5 != 0, F.concat(F.lit("es  "), F.lower("c_mktsegment"))).otherwise(" ")
    return ws.table("customer").select(
        "c_custkey",
        parse.parse_age(age).alias("age"),
        parse.parse_nation(nation).alias("nation"),
        parse.parse_age(F.concat(F.lit("n"), age)).alias("no_age"),
    )


@query(
    "position_groups",
    using(
        "players",
        f"""select {K}, case position_raw when 'D S' then 'DF' when 'M F S' then 'MF,FW'
          when 'fw,mf' then 'FW,MF' when 'GK' then 'GK' else '' end as groups, position_group,
          position_raw in ('M F S', 'fw,mf') as hybrid from players""",
    ),
)
def position_groups(ws: Workspace) -> DataFrame:
    return ws.players.select(
        *KEYS,
        F.array_join(parse.split_positions("position_raw"), ",").alias("groups"),
        parse.primary_position("position_raw").alias("position_group"),
        parse.is_hybrid("position_raw").alias("hybrid"),
    )


# How the fee of an order is written, by priority.
_FEES = {
    "1-URGENT": None,
    "2-HIGH": "Free transfer",
    "3-MEDIUM": "End of loan",
    "4-NOT SPECIFIED": "loan transfer",
}


def _amount_text():
    thousands = F.round(F.col("o_totalprice") / 1000, 2)
    return F.concat(F.lit("€"), thousands.cast("decimal(18,2)").cast("string"), F.lit("k"))


def _fee_text():
    fee = None
    for priority, written in _FEES.items():
        here = F.col("o_orderpriority") == priority
        value = F.lit(written).cast("string")
        fee = F.when(here, value) if fee is None else fee.when(here, value)
    return fee.otherwise(_amount_text())


_THOUSANDS_SQL = f"round({settled('o_totalprice / 1000', 2)} * 1000, 2)"
_FEE_SQL = f"""
  fees as (
    select o_orderkey, case when o_orderpriority = '5-LOW' then {_THOUSANDS_SQL} end as amount,
      case o_orderpriority when '2-HIGH' then 'libre' when '3-MEDIUM' then 'fin_cesion'
        when '4-NOT SPECIFIED' then 'cesion' when '5-LOW' then 'traspaso' end as kind
    from orders)
"""


@query("parse_amount", using("", "select o_orderkey, amount from fees", _FEE_SQL))
def parse_amount(ws: Workspace) -> DataFrame:
    fee = F.round(parse.parse_amount(_fee_text()), 2)
    return ws.table("orders").select("o_orderkey", fee.alias("amount"))


@query("classify_transfer", using("", "select o_orderkey, kind from fees", _FEE_SQL))
def classify_transfer(ws: Workspace) -> DataFrame:
    return ws.table("orders").select(
        "o_orderkey", parse.classify_transfer(_fee_text()).alias("kind")
    )


def _date_text():
    day = F.col("o_orderdate")
    return (
        F.when(F.col("o_orderstatus") == "F", F.date_format(day, "yyyy-MM-dd"))
        .when(F.col("o_orderstatus") == "O", F.date_format(day, "MMM d, yyyy"))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("sin fecha"))
        .otherwise(F.date_format(day, " dd/MM/yyyy "))
    )


@query(
    "parse_dates",
    """select o_orderkey, case when o_orderstatus <> 'P' or o_orderpriority <> '5-LOW'
      then strftime(o_orderdate, '%Y-%m-%d') end as day from orders""",
)
def parse_dates(ws: Workspace) -> DataFrame:
    rows = ws.table("orders").select("o_orderkey", parse.parse_date(_date_text()).alias("day"))
    return _day(rows, "day")


# --- payloads ------------------------------------------------------------------


def _history_payloads(ws: Workspace) -> DataFrame:
    """One valuation payload per order: three points, one without a readable date."""

    def point(date, value, club):
        return F.struct(
            (F.col("o_custkey") % 23 + 16).alias("age"),
            date.alias("date"),
            F.lit("1").alias("clubId"),
            club.alias("clubName"),
            value.alias("marketValue"),
        )

    later = F.date_format(F.date_add("o_orderdate", 30), "MMM d, yyyy")
    points = F.array(
        point(_date_text(), _amount_text(), F.col("o_orderpriority")),
        point(later, F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("")),
        point(F.lit("pronto"), F.lit("?"), F.lit("ZZ")),
    )
    payload = F.to_json(
        F.struct(F.col("o_totalprice").alias("marketValue"), points.alias("marketValueHistory"))
    )
    return spread(ws.table("orders")).select(
        F.col("o_orderkey").cast("string").alias("entity_id"), payload.alias("payload")
    )


@query(
    "flatten_history",
    f"""select cast(o_orderkey as varchar) as entity_id,
        strftime(o_orderdate, '%Y-%m-%d') as valuation_date, {_THOUSANDS_SQL} as market_value,
        o_orderpriority as club_at_time, cast(o_custkey % 23 + 16 as int) as age_at_time
      from orders where o_orderstatus <> 'P' or o_orderpriority <> '5-LOW'
    union all
    select cast(o_orderkey as varchar), strftime(o_orderdate + interval 30 day, '%Y-%m-%d'),
        round(o_totalprice, 2), '', cast(o_custkey % 23 + 16 as int) from orders""",
)
def flatten_history(ws: Workspace) -> DataFrame:
    return _day(rounded(payloads.flatten_history(_history_payloads(ws)), 2), "valuation_date")


@query(
    "club_history",
    """select cast(o_orderkey as varchar) as entity_id, o_orderpriority || '|ZZ' as clubs
    from orders""",
)
def club_history(ws: Workspace) -> DataFrame:
    return payloads.club_history(_history_payloads(ws)).select(
        "entity_id", F.array_join("clubs", "|").alias("clubs")
    )


@query(
    "flatten_transfers",
    using(
        "",
        """select cast(o_orderkey as varchar) as entity_id,
          strftime(o_orderdate, '%Y-%m-%d') as transfer_date, o_orderstatus as club_from,
          o_orderpriority as club_to, amount as fee, kind as transfer_type,
          round(o_totalprice, 2) as market_value_at_transfer, '9899' as season
        from orders join fees using (o_orderkey)
        where o_orderstatus <> 'P' or o_orderpriority <> '5-LOW'""",
        _FEE_SQL,
    ),
)
def flatten_transfers(ws: Workspace) -> DataFrame:
    """One payload per order: a completed move, an announced one and one without a club."""

    def move(club_from, upcoming):
        return F.struct(
            F.lit("1").alias("id"),
            F.struct(club_from.alias("name")).alias("clubFrom"),
            F.struct(F.col("o_orderpriority").alias("name")).alias("clubTo"),
            _date_text().alias("date"),
            upcoming.alias("upcoming"),
            F.lit("9899").alias("season"),
            F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("marketValue"),
            _fee_text().alias("fee"),
        )

    moves = F.array(
        move(F.col("o_orderstatus"), F.lit(None).cast("boolean")),
        move(F.col("o_orderstatus"), F.lit(True)),
        move(F.lit(None).cast("string"), F.lit(False)),
    )
    built = spread(ws.table("orders")).select(
        F.col("o_orderkey").cast("string").alias("entity_id"),
        F.to_json(F.struct(moves.alias("transfers"))).alias("payload"),
    )
    return _day(rounded(payloads.flatten_transfers(built), 2), "transfer_date")


@query(
    "flatten_profiles",
    """select cast(c_custkey as varchar) as entity_id, cast(c_custkey as varchar) as external_id,
      c_name as player_name, strftime(date '1970-01-01' + cast(c_custkey % 9000 as int), '%Y-%m-%d')
        as date_of_birth,
      cast(c_custkey % 23 + 16 as int) as age, c_mktsegment as position,
      case when c_custkey % 3 <> 0 then 'N' || c_nationkey end as nationality,
      cast(case when c_custkey % 4 <> 0 then c_custkey % 40 + 160 end as int) as height_cm,
      'right' as foot, cast(null as varchar) as joined_on, cast(null as varchar) as signed_from,
      '2002-06-30' as contract_until
    from customer""",
)
def flatten_profiles(ws: Workspace) -> DataFrame:
    key = F.col("c_custkey")
    nations = F.array(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")), F.lit("Other"))
    born = F.date_add(F.lit("1970-01-01").cast("date"), (key % 9000).cast("int"))
    entry = F.struct(
        key.cast("string").alias("id"),
        F.col("c_name").alias("name"),
        F.date_format(born, "dd/MM/yyyy").alias("dateOfBirth"),
        (key % 23 + 16).alias("age"),
        F.col("c_mktsegment").alias("position"),
        F.when(key % 3 != 0, nations).otherwise(F.array().cast("array<string>")).alias(
            "nationality"
        ),
        F.when(key % 4 != 0, (key % 40 + 160).cast("string")).otherwise("-").alias("height"),
        F.lit("right").alias("foot"),
        F.lit("Jun 30, 2002").alias("contract"),
    )
    built = ws.table("customer").select(
        key.cast("string").alias("entity_id"), F.to_json(entry).alias("payload")
    )
    return _day(payloads.flatten_profiles(built), "date_of_birth", "joined_on", "contract_until")


# --- raw tables ----------------------------------------------------------------

_RAW_METRICS = (
    catalog.metric("quantity", "Quantity", "lines", column="playing_time_qty"),
    catalog.metric("discount", "Discount", "lines", column="prices_discount_pct"),
    catalog.metric("absent", "Absent", "lines", "optional", column="prices_absent"),
)


def _two_level(ws: Workspace) -> DataFrame:
    """Lines with two-level headers, text numbers and a noise column."""
    c = F.col
    return ws.table("lineitem").select(
        F.struct(
            c("l_orderkey").cast("string").alias("player"),
            c("l_linenumber").cast("string").alias("team"),
        ).alias("Unnamed: 0_level_0"),
        F.struct(
            F.when(c("l_returnflag") == "N", "n/a")
            .otherwise(c("l_quantity").cast("string"))
            .alias("Qty"),
            c("l_quantity").alias("90s"),
        ).alias("Playing Time"),
        F.struct(c("l_discount").alias("Discount%"), c("l_tax").alias("Discount %")).alias("Prices"),
        F.struct(c("l_tax").alias("Gls")).alias("Per 90 Minutes"),
    )


@query(
    "flatten_headers",
    """select cast(l_orderkey as varchar) as player, cast(l_linenumber as varchar) as team,
      case when l_returnflag = 'N' then 'n/a' else cast(l_quantity as varchar) end
        as playing_time_qty,
      l_quantity as playing_time_90s, l_discount as prices_discount_pct from lineitem""",
)
def flatten_headers(ws: Workspace) -> DataFrame:
    return shaping.flatten_headers(_two_level(ws))


@query(
    "select_metrics",
    """select cast(l_orderkey as varchar) as player, cast(l_linenumber as varchar) as team,
      case when l_returnflag <> 'N' then l_quantity end as quantity, l_discount as discount,
      cast(null as double) as absent from lineitem""",
)
def select_metrics(ws: Workspace) -> DataFrame:
    named = shaping.flatten_headers(_two_level(ws))
    return shaping.select_metrics(named, _RAW_METRICS, "lines", ("player", "team"))


@query(
    "merge_sources",
    """select cast(coalesce(o_custkey, c_custkey, user_id) as varchar) as player, orders, balance,
      cast(null as bigint) as none, clicks
    from (select o_custkey, count(*) as orders from orders group by 1) o
    full outer join (select c_custkey, c_acctbal as balance from customer) c
      on o_custkey = c_custkey
    full outer join (select user_id, count(*) as clicks from events group by 1) e
      on user_id = coalesce(o_custkey, c_custkey)""",
)
def merge_sources(ws: Workspace) -> DataFrame:
    """Orders, accounts and events of a customer; each source misses some of them."""
    def count(table: str, key: str, name: str) -> DataFrame:
        rows = ws.table(table).groupBy(F.col(key).cast("string").alias("player"))
        return rows.agg(F.count("*").alias(name))

    frames = {
        "orders": count("orders", "o_custkey", "orders"),
        "accounts": ws.table("customer").select(
            F.col("c_custkey").cast("string").alias("player"), F.col("c_acctbal").alias("balance")),
        "empty": count("orders", "o_custkey", "none").where("none < 0"),
        "events": count("events", "user_id", "clicks"),
    }
    return shaping.merge_sources(frames, ["player"])


@query(
    "merged_entities",
    using(
        "",
        """select 'L' as league, cast(l_orderkey % 5 as varchar) as season, 'T' as team,
          cast(l_orderkey as varchar) as player, quantity, discount
        from (select l_orderkey, sum(l_quantity) as quantity from lineitem group by 1)
        full outer join (select l_orderkey, sum(cast(l_discount as decimal(18, 2)))::double as discount
          from lineitem where l_returnflag = 'R' group by 1) using (l_orderkey)""",
    ),
)
def merged_entities(ws: Workspace) -> DataFrame:
    """`player_season` from two raw tables, one of which lacks some of the rows."""
    keys = [
        F.lit("L").alias("league"),
        (F.col("l_orderkey") % 5).cast("string").alias("season"),
        F.lit(" T\t").alias("team"),
        F.col("l_orderkey").cast("string").alias("player"),
    ]
    lines = ws.table("lineitem")
    frames = {
        "time": lines.groupBy(*keys).agg(F.sum("l_quantity").alias("quantity")),
        "prices": lines.where("l_returnflag = 'R'").groupBy(*keys).agg(
            F.sum(F.col("l_discount").cast("decimal(18,2)")).cast("double").alias("discount")),
    }
    metrics = (
        catalog.metric("quantity", "Quantity", "time"),
        catalog.metric("discount", "Discount", "prices"),
    )
    return shaping.build_players(frames, metrics).select(*KEYS, "quantity", "discount")


@query(
    "normalise_keys",
    """select trim(team) as team, trim(player) as player, o_orderkey from (
      select o_orderkey, '  ' || o_orderpriority || ' ' as team,
        case o_orderstatus when 'F' then ' ' when 'P' then null else ' x' || o_custkey end as player
      from orders) where trim(player) <> ''""",
)
def normalise_keys(ws: Workspace) -> DataFrame:
    player = F.when(F.col("o_orderstatus") == "F", F.lit(" ")).when(
        F.col("o_orderstatus") == "O", F.concat(F.lit(" x"), F.col("o_custkey").cast("string"))
    )
    raw = ws.table("orders").select(
        F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" ")).alias("team"),
        player.alias("player"),
        "o_orderkey",
    )
    return shaping.normalise_keys(raw)


@query(
    "add_identity",
    using(
        "players",
        f"""select {K}, position_raw, position_group, entity_id, 'ESP' as nation,
        cast("minutes" % 20 + 17 as int) as age, cast(1980 + "minutes" % 20 as int) as born
        from players""",
    ),
)
def add_identity(ws: Workspace) -> DataFrame:
    raw = ws.players.select(
        *KEYS,
        F.col("position_raw").alias("pos"),
        F.col("entity_id").alias("player_id"),
        F.lit("es ESP").alias("nation"),
        F.concat((F.col("minutes") % 20 + 17).cast("string"), F.lit("-104")).alias("age"),
        (1980 + F.col("minutes") % 20).cast("string").alias("born"),
    )
    return shaping.add_identity(raw).select(
        *KEYS, "position_raw", "position_group", "entity_id", "nation", "age", "born"
    )


@query(
    "build_players",
    using(
        "players",
        f"""select {K}, position_raw, position_group, entity_id, cast(null as varchar) as nation,
        cast(null as int) as age, cast(null as int) as born, "minutes", matches_played,
        {", ".join(f"cast({m} as double) as {m}" for m in list(RATED)[:11])}
        from players""",
    ),
)
def build_players(ws: Workspace) -> DataFrame:
    """Raw season rows, as text, through the whole entity shaping."""
    measures = [m.name for m in catalog.PLAYER_METRICS]
    raw = ws.players.select(
        *[F.concat(F.lit(" "), F.col(k), F.lit(" ")).alias(k) for k in KEYS],
        F.col("position_raw").alias("position"),
        F.col("entity_id").alias("player_id"),
        *[
            F.col(m).cast("string").alias("matches" if m == "matches_played" else m)
            for m in measures
        ],
    )
    return shaping.build_players(raw, catalog.PLAYER_METRICS)


@query(
    "stack_perspectives",
    using(
        "teams",
        """select league, season, team, perspective, matches_played, goals, xg, np_xg,
        deep_completions, ppda from teams""",
    ),
)
def stack_perspectives(ws: Workspace) -> DataFrame:
    """Two source tables per side → both perspectives of every team."""
    raw = ws.teams.withColumnRenamed("matches_played", "matches")
    sides = {
        view: {"team_season": raw.where(F.col("perspective") == view).drop("perspective")}
        for view in ("for", "against")
    }
    return shaping.build_teams(sides["for"], sides["against"], catalog.TEAM_METRICS)


@query(
    "drop_header_rows",
    """select 'ESP-La Liga' as league, o_orderpriority as player, o_orderkey from orders
    where o_orderpriority not in ('5-LOW', '1-URGENT')""",
)
def drop_header_rows(ws: Workspace) -> DataFrame:
    """One priority plays the repeated header line, another the missing name."""
    raw = ws.table("orders").select(
        F.when(F.col("o_orderpriority") == "5-LOW", "Player")
        .when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority"))
        .alias("player"),
        "o_orderkey",
        F.col("o_custkey").alias("Rk"),
        F.lit("Matches").alias("Matches"),
    )
    return shaping.drop_header_rows(raw, "player", "Player", league="ESP-La Liga")


@query(
    "stack_sources",
    """select 'AFRICA' as league, o_orderstatus as season, o_orderkey, o_totalprice
    from orders""",
)
def stack_sources(ws: Workspace) -> DataFrame:
    """One landed table per season, stacked with its tags."""
    landed = ws.table("orders")
    parts = [
        (
            {"league": "AFRICA", "season": status},
            landed.where(F.col("o_orderstatus") == status).select("o_orderkey", "o_totalprice"),
        )
        for status in ("F", "O", "P")
    ]
    return shaping.stack_sources(parts)


@query(
    "dedupe_first",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate[:10] as day from (
      select l_orderkey, l_linenumber, l_partkey, l_suppkey,
        strftime(l_shipdate, '%Y-%m-%d') as l_shipdate,
        row_number() over (partition by l_orderkey, l_linenumber
          order by l_shipdate, l_partkey, l_suppkey) as n from lineitem) where n = 1""",
)
def dedupe_first(ws: Workspace) -> DataFrame:
    lines = ws.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"),
    )
    return shaping.keep_first(
        lines, ["l_orderkey", "l_linenumber"], ["day", "l_partkey", "l_suppkey"]
    )


@query(
    "nan_to_null",
    """select event_id, case when event_type <> 'error' then "value" end as "value" from events""",
)
def nan_to_null(ws: Workspace) -> DataFrame:
    value = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    return shaping.nan_to_null(ws.table("events").select("event_id", value.alias("value")))


# --- guards --------------------------------------------------------------------

_KNOWN = ("AFRICA", "AMERICA", "ASIA")


@query(
    "unsupported_sources",
    using(
        "players",
        """select league, count(*) as rows from players
        where league not in ('AFRICA', 'AMERICA', 'ASIA') group by league""",
    ),
)
def unsupported_sources(ws: Workspace) -> DataFrame:
    return quality.unsupported_sources(ws.players, _KNOWN)


@query(
    "fill_rate",
    """select o_orderpriority, count(*) as rows,
      cast(round(cast(avg(case when o_orderstatus <> 'P' then 1.0 else 0.0 end) as decimal(28, 9)), 6) as double) as fill_rate,
      avg(case when o_orderstatus <> 'P' then 1.0 else 0.0 end) >= 0.5 as complete
    from orders group by o_orderpriority""",
)
def fill_rate(ws: Workspace) -> DataFrame:
    blank = F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(
        F.col("o_totalprice").cast("string")
    )
    raw = ws.table("orders").select(
        "o_orderpriority", blank.alias("price"), F.lit("n/a").alias("never")
    )
    return rounded(quality.fill_rate(raw, ["price", "never"], ["o_orderpriority"]))


@query(
    "missing_population",
    using(
        "players",
        """select distinct c_name as player from customer
        where c_name not in (select player from players)""",
    ),
)
def missing_population(ws: Workspace) -> DataFrame:
    """Every customer is expected; those without an order were never loaded."""
    expected = ws.table("customer").select(F.col("c_name").alias("player"))
    return quality.missing_population(expected, ws.players, "player")


@query(
    "position_quality",
    using(
        "players",
        """select season, count(*) as rows,
        count(*) filter (position_raw in ('M F S', 'fw,mf')) as hybrid,
        count(*) filter (position_raw = 'S') as unknown from players group by season""",
    ),
)
def position_quality(ws: Workspace) -> DataFrame:
    return quality.position_quality(ws.players)


_EXPECTED = {
    source: sorted({m.found[0] for m in (*DEMO_METRICS, *catalog.TEAM_METRICS) if m.found[1] == source})
    for source in ("player_season", "team_season")
}


@query(
    "schema_drift",
    using(
        "players teams",
        " union all ".join(
            f"""select '{source}' as source, count(*) as rows, '{name}' as name,
              true as present,
              count({"matches_played" if name == "matches" else '"' + name + '"'}) as filled from {table}"""
            for source, table in (("player_season", "players"), ("team_season", "teams"))
            for name in _EXPECTED[source]
        ),
    ),
)
def schema_drift(ws: Workspace) -> DataFrame:
    """What the catalogue expects of the stored tables against the rows that hold it."""
    renamed = {"matches_played": "matches"}
    tables = {
        "player_season": ws.players.withColumnsRenamed(renamed),
        "team_season": ws.teams.withColumnsRenamed(renamed),
    }
    return quality.schema_drift(tables, (*DEMO_METRICS, *catalog.TEAM_METRICS))


@query(
    "dry_run_counts",
    using(
        "players teams shots player_matches",
        """select 'players' as output, count(*) as rows from players
        union all select 'teams', count(*) from teams
        union all select 'shots', count(*) from shots
        union all select 'matches', count(*) from player_matches""",
    ),
)
def dry_run_counts(ws: Workspace) -> DataFrame:
    """Transform and count, straight from the raw tables; nothing is written."""
    return quality.dry_run_counts(
        {
            "players": ws._build_players(),
            "teams": ws._build_teams(),
            "shots": shaping.build_shots(ws.raw_shots),
            "matches": ws.raw_matches(),
        }
    )
