"""Identity queries: name scores, squad and club matching, ties, careers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelfield.functions import text
from levelfield.operators import identity, market
from levelfield.plans.population import rounded
from levelfield.plans.registry import query
from levelfield.plans.sqlbase import using
from levelfield.plans.workspace import Workspace

# --- the two sources: parts, and the same parts as another catalogue writes them ---


def _ours(ws: Workspace) -> DataFrame:
    """Parts under their own name; a block is eight of them, however many there are."""
    return ws.table("part").select(
        F.col("p_partkey").cast("string").alias("entity_id"),
        F.concat_ws(" ", "p_name", "p_brand").alias("player_name"),
        F.expr("cast(p_partkey div 8 as string)").alias("block"),
    )


def _theirs(ws: Workspace) -> DataFrame:
    """Every part again: turned round with accents, clipped, or with a suffix."""
    kind = F.col("p_partkey") % 3
    turned = F.translate(F.concat_ws(" ", "p_brand", "p_name"), "aeio", "áéíó")
    plain = F.concat_ws(" ", "p_name", "p_brand")
    name = (
        F.when(kind == 0, turned)
        .when(kind == 1, F.substring(plain, 3, 100))
        .otherwise(F.concat(plain, F.lit(" jr")))
    )
    return ws.table("part").select(
        F.concat(F.lit("x"), F.col("p_partkey").cast("string")).alias("external_id"),
        name.alias("name"),
        F.expr("cast(p_partkey div 8 as string)").alias("block"),
    )


def _sorted_sql(value: str) -> str:
    folded = (
        f"lower(regexp_replace(strip_accents({value}), '[^\\x00-\\x7F]', '', 'g'))"
    )
    words = f"string_split(trim(regexp_replace({folded}, '[^a-z0-9]+', ' ', 'g')), ' ')"
    return f"array_to_string(list_sort(list_filter({words}, lambda w: w <> '')), ' ')"


def _lcs_sql(a: str, b: str) -> str:
    """Longest common subsequence, one table row per character of ``a``."""
    return f"""list_reduce(list_prepend(list_transform(range(length({b}) + 1), lambda z: 0::bigint),
      list_transform(string_split({a}, ''), lambda s: [ascii(s)::bigint])),
      lambda r, x: list_transform(range(length({b}) + 1), lambda j: list_max(list_transform(
        range(j + 1), lambda i: greatest(r[i + 1],
          case when i > 0 and ascii({b}[i]) = x[1] then r[i] + 1 else 0 end)))))[-1]"""


def _ratio_sql(a: str, b: str) -> str:
    return (
        f"case when {a} = {b} then 100 else 200.0::double * {_lcs_sql(a, b)}"
        f" / (length({a}) + length({b})) end"
    )


_SOURCES = rf"""
  ours as (
    select cast(p_partkey as varchar) as entity_id, p_name || ' ' || p_brand as player_name,
      cast(p_partkey // 8 as varchar) as block, {_sorted_sql("p_name || ' ' || p_brand")} as left_name
    from part),
  theirs as (
    select *, {_sorted_sql("name")} as right_name from (
      select 'x' || p_partkey as external_id, cast(p_partkey // 8 as varchar) as block,
        case p_partkey % 3 when 0 then translate(p_brand || ' ' || p_name, 'aeio', 'áéíó')
          when 1 then (p_name || ' ' || p_brand)[3:] else p_name || ' ' || p_brand || ' jr' end
          as name from part)),
  pairs as materialized (
    select *, {_ratio_sql("left_name", "right_name")} as score
    from (select distinct block, left_name from ours)
    join (select distinct block, right_name from theirs) using (block))
"""


@query(
    "token_sort_score",
    using(
        "",
        """select block, left_name, right_name, cast(round(cast(score as decimal(28, 9)), 6) as double) as score from pairs
        where score >= 80""",
        _SOURCES,
    ),
)
def token_sort_score(ws: Workspace) -> DataFrame:
    """Every pair of names inside a block that scores at least 80."""

    def names(df: DataFrame, column: str, out: str) -> DataFrame:
        name = text.sort_tokens(text.normalise_name(column))
        return df.select("block", name.alias(out)).distinct()

    pairs = identity.name_pairs(
        names(_ours(ws), "player_name", "left_name"),
        names(_theirs(ws), "name", "right_name"),
        80.0,
    )
    return rounded(pairs)


_IN_BLOCK = (
    _SOURCES
    + """,
  reached as (
    select block, left_name, external_id, score, max(score) over (partition by block, left_name)
      as best
    from pairs join theirs using (block, right_name) where score >= 80),
  chosen as (
    select block, left_name, any_value(best) as best, count(*) as tied,
      first(external_id order by score desc, external_id) as external_id
    from reached where score >= best - 5 and best >= 85 group by block, left_name),
  squad_match as (
    select entity_id, player_name, external_id, 'squad' as match_method,
      case when tied > 1 then round(least(best, 94.0::double), 2) when tied = 1 then 95.0::double
        end as match_confidence,
      false as reviewed
    from ours left join chosen using (block, left_name))
"""
)


@query("match_in_block", using("", "select * from squad_match", _IN_BLOCK))
def match_in_block(ws: Workspace) -> DataFrame:
    return identity.match_in_block(_ours(ws), _theirs(ws))


@query(
    "resolution_rate",
    using(
        "",
        """select count(*) as entities, count(external_id) as resolved,
        count(*) filter (external_id is not null and match_confidence >= 95) as usable,
        round(count(external_id) / count(*), 3) as rate from squad_match""",
        _IN_BLOCK,
    ),
)
def resolution_rate(ws: Workspace) -> DataFrame:
    return identity.resolution_rate(match_in_block(ws))


_CASCADE = (
    _IN_BLOCK
    + """,
  cascade as (
    select entity_id, player_name, external_id, match_method, match_confidence, reviewed, source
    from (
      select cast(p_partkey as varchar) as entity_id, p_name as player_name,
        'k' || p_partkey as external_id, 'manual' as match_method,
        100.0::double as match_confidence, true as reviewed, 0 as source
      from part where p_size < 10
      union all select *, 1 from squad_match where external_id is not null
      union all select cast(p_partkey as varchar), p_name, 's' || p_partkey, 'fuzzy', 88.0, false, 2
      from part where p_size > 20)
    qualify row_number() over (partition by entity_id order by source) = 1)
"""
)


@query("identity_cascade", using("", "select * from cascade", _CASCADE))
def identity_cascade(ws: Workspace) -> DataFrame:
    """Small sizes are already known; large ones can also be found by search."""

    def stored(where: str, prefix: str, method: str, confidence: float, reviewed: bool):
        return ws.table("part").where(where).select(
            F.col("p_partkey").cast("string").alias("entity_id"),
            F.col("p_name").alias("player_name"),
            F.concat(F.lit(prefix), F.col("p_partkey").cast("string")).alias("external_id"),
            F.lit(method).alias("match_method"),
            F.lit(confidence).alias("match_confidence"),
            F.lit(reviewed).alias("reviewed"),
        )

    return identity.identity_cascade(
        stored("p_size < 10", "k", "manual", 100.0, True),
        match_in_block(ws),
        stored("p_size > 20", "s", "fuzzy", 88.0, False),
    )


# --- search results: the lines of an order are the candidates for its first part ----


def _search(ws: Workspace) -> tuple[DataFrame, DataFrame]:
    c = F.col
    parts = ws.table("part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    nations = ws.table("nation").select("n_nationkey", c("n_name").alias("club_name"))
    sellers = ws.table("supplier").join(nations, c("s_nationkey") == c("n_nationkey"))
    lines = ws.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    candidates = (
        lines.join(parts, c("l_partkey") == c("p_partkey"))
        .join(sellers.select("s_suppkey", "club_name"), c("l_suppkey") == c("s_suppkey"))
        .select(
            c("l_orderkey").cast("string").alias("entity_id"),
            c("l_partkey").cast("string").alias("external_id"),
            "name",
            "club_name",
        )
    )
    wanted = lines.groupBy("l_orderkey").agg(F.min("l_partkey").alias("first_part"))
    people = ws.people().select("c_custkey", "team")
    buyers = ws.table("orders").join(people, c("o_custkey") == c("c_custkey"))
    entities = (
        wanted.join(parts, c("first_part") == c("p_partkey"))
        .join(buyers.select("o_orderkey", "team"), c("l_orderkey") == c("o_orderkey"))
        .select(
            c("l_orderkey").cast("string").alias("entity_id"),
            c("name").alias("player_name"),
            "team",
        )
    )
    return entities, candidates


_SEARCH = f"""
  names as (
    select p_partkey, p_name || ' ' || p_brand as name, {_sorted_sql("p_name || ' ' || p_brand")}
      as sorted from part),
  looked as (
    select cast(l.l_orderkey as varchar) as entity_id, f.name as player_name, f.sorted as a,
      cn.n_name as team, cast(l.l_partkey as varchar) as external_id, p.sorted as b,
      sn.n_name as club_name
    from lineitem l
    join (select l_orderkey, min(l_partkey) as first_part from lineitem group by 1) w
      on w.l_orderkey = l.l_orderkey
    join names f on f.p_partkey = w.first_part join names p on p.p_partkey = l.l_partkey
    join supplier on l.l_suppkey = s_suppkey join nation sn on s_nationkey = sn.n_nationkey
    join orders on o_orderkey = l.l_orderkey join customer on c_custkey = o_custkey
    join nation cn on c_nationkey = cn.n_nationkey),
  name_scores as materialized (
    select a, b, {_ratio_sql("a", "b")} as score from (select distinct a, b from looked)),
  clubs as (select n_name, {_sorted_sql("n_name")} as sorted from nation),
  club_scores as materialized (
    select x.n_name as club_name, y.n_name as team, {_ratio_sql("x.sorted", "y.sorted")} >= 80 as same
    from clubs x cross join clubs y),
  scored as materialized (
    select looked.*, score, same from looked join name_scores using (a, b)
    join club_scores using (club_name, team)),
  tied as (
    select * from (select *, max(score) over (partition by entity_id) as best from scored)
    where score >= best - 5),
  considered as (
    select *, max(score) over (partition by entity_id) as base from (
      select *, bool_or(same) over (partition by entity_id) as any_club from scored)
    where same or not any_club),
  ranked as (
    select entity_id, any_value(player_name) as player_name,
      first(external_id order by score desc, external_id) as external_id,
      any_value(base) - case when not any_value(any_club)
        and count(*) filter (score >= base - 5) > 1 then 15 else 0 end as final
    from considered group by entity_id),
  best_match as (
    select entity_id, player_name, case when final >= 85 then external_id end as external_id,
      case when final >= 95 then 'exact' else 'fuzzy' end as match_method,
      case when final >= 85 then round(final, 2) end as match_confidence, false as reviewed
    from ranked)
"""


@query("identity_match", using("", "select * from best_match", _SEARCH))
def identity_match(ws: Workspace) -> DataFrame:
    entities, candidates = _search(ws)
    return identity.best_match(entities, identity.score_candidates(entities, candidates))


@query(
    "tied_candidates",
    using("", "select entity_id, external_id, cast(round(cast(score as decimal(28, 9)), 6) as double) as score from tied", _SEARCH),
)
def tied_candidates(ws: Workspace) -> DataFrame:
    tied = identity.tied_candidates(identity.score_candidates(*_search(ws)))
    return rounded(tied.select("entity_id", "external_id", "score"))


_HISTORY = (
    _SEARCH
    + """,
  been as (
    select distinct cast(l_partkey as varchar) as external_id, team
    from lineitem join supplier on l_suppkey = s_suppkey
    join nation on s_nationkey = n_nationkey
    join club_scores on club_name = n_name where same and l_returnflag = 'R'),
  verdict as (
    select entity_id, max(t.external_id) filter (n.team is not null) as external_id,
      max(score) filter (n.team is not null) as score
    from tied t left join been n on n.external_id = t.external_id and n.team = t.team
    where entity_id in (select entity_id from best_match where match_confidence < 95)
    group by entity_id having count(*) > 1 and count(n.team) = 1)
"""
)


@query(
    "confirm_by_history",
    using(
        "",
        """select m.entity_id, player_name, coalesce(v.external_id, m.external_id) as external_id,
        case when v.entity_id is not null then 'history' else match_method end as match_method,
        coalesce(cast(round(cast(score as decimal(28, 9)), 6) as double), match_confidence) as match_confidence, reviewed
        from best_match m left join verdict v using (entity_id)""",
        _HISTORY,
    ),
)
def confirm_by_history(ws: Workspace) -> DataFrame:
    """A part's career: the nations whose suppliers had it returned."""
    entities, candidates = _search(ws)
    c = F.col
    nations = ws.table("nation").select("n_nationkey", c("n_name").alias("club"))
    sellers = ws.table("supplier").join(nations, c("s_nationkey") == c("n_nationkey"))
    histories = (
        ws.table("lineitem")
        .where("l_returnflag = 'R'")
        .join(sellers.select("s_suppkey", "club"), c("l_suppkey") == c("s_suppkey"))
        .select(c("l_partkey").cast("string").alias("external_id"), "club")
        .distinct()
    )
    scored = identity.score_candidates(entities, candidates)
    matches = identity.best_match(entities, scored)
    return rounded(identity.confirm_by_history(matches, scored, histories))


# --- clubs ---------------------------------------------------------------------------


def _clubs(ws: Workspace) -> DataFrame:
    """Every part name again as a club, with words more or less."""
    kind = F.col("p_partkey") % 3
    name = (
        F.when(kind == 0, F.concat(F.lit("FC "), F.col("p_name")))
        .when(kind == 1, F.concat_ws(" ", F.lit("Réal"), "p_name", "p_brand"))
        .otherwise(F.concat(F.substring("p_name", 2, 100), F.lit(" "), F.col("p_brand")))
    )
    return ws.table("part").select(
        F.expr("cast(p_partkey div 8 as string)").alias("block"),
        F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("club_id"),
        name.alias("name"),
    )


def _set_ratio_sql(a: str, b: str) -> str:
    """Token-set ratio of two sorted names, from the pieces computed in `pieces`."""
    rests = f"100 - 100.0::double * (la + lb - 2 * {_lcs_sql(a, b)}) / (fa + fb)"
    return f"""case when ls > 0 and (la = 0 or lb = 0) then 100
      when ls = 0 then {rests}
      else greatest({rests}, 100 - 100.0::double * (1 + la) / (ls + fa),
        100 - 100.0::double * (1 + lb) / (ls + fb)) end"""


_CLUB_MATCH = rf"""
  wanted as (
    select distinct cast(p_partkey // 8 as varchar) as block, p_name || ' ' || p_brand as team,
      {_sorted_sql("p_name || ' ' || p_brand")} as left_name from part),
  offered as (
    select *, {_sorted_sql("name")} as right_name from (
      select cast(p_partkey // 8 as varchar) as block, 'c' || p_partkey as club_id,
        case p_partkey % 3 when 0 then 'FC ' || p_name
          when 1 then 'Réal ' || p_name || ' ' || p_brand else p_name[2:] || ' ' || p_brand end
          as name from part)),
  words as (
    select block, left_name, right_name,
      list_distinct(string_split(left_name, ' ')) as wl, list_distinct(string_split(right_name, ' '))
        as wr
    from (select distinct block, left_name from wanted)
    join (select distinct block, right_name from offered) using (block)),
  pieces as (
    select *, length(ab) as la, length(ba) as lb, length(sect) as ls,
      length(sect) + length(ab) + cast(sect <> '' as int) as fa,
      length(sect) + length(ba) + cast(sect <> '' as int) as fb
    from (select *, array_to_string(list_sort(list_filter(wl, lambda w: list_contains(wr, w))), ' ')
        as sect,
      array_to_string(list_sort(list_filter(wl, lambda w: not list_contains(wr, w))), ' ') as ab,
      array_to_string(list_sort(list_filter(wr, lambda w: not list_contains(wl, w))), ' ') as ba
      from words)),
  club_pairs as materialized (
    select block, left_name, right_name, {_set_ratio_sql("ab", "ba")} as set_score,
      {_ratio_sql("left_name", "right_name")} as sort_score from pieces),
  topped as (
    select block, left_name, club_id, set_score, sort_score,
      rank() over (partition by block, left_name order by round(set_score, 9) desc,
        round(sort_score, 9) desc) as n
    from club_pairs join offered using (block, right_name) where set_score >= 70),
  won as (
    select block, left_name, min(club_id) as club_id, any_value(set_score) as set_score,
      any_value(sort_score) as sort_score
    from topped where n = 1 group by block, left_name having count(*) = 1)
"""


@query(
    "match_clubs",
    using(
        "",
        """select block, team, club_id, round(set_score, 4) as set_score,
        round(sort_score, 4) as sort_score from wanted left join won using (block, left_name)""",
        _CLUB_MATCH,
    ),
)
def match_clubs(ws: Workspace) -> DataFrame:
    teams = _ours(ws).select("block", F.col("player_name").alias("team")).distinct()
    return identity.match_clubs(teams, _clubs(ws))


@query(
    "token_set_score",
    using(
        "",
        """select block, left_name, right_name, cast(round(cast(set_score as decimal(28, 9)), 6) as double) as set_score,
        cast(round(cast(sort_score as decimal(28, 9)), 6) as double) as sort_score from club_pairs where set_score >= 70""",
        _CLUB_MATCH,
    ),
)
def token_set_score(ws: Workspace) -> DataFrame:
    def names(df: DataFrame, column: str, out: str) -> DataFrame:
        name = text.sort_tokens(text.normalise_name(column))
        return df.select("block", name.alias(out)).distinct()

    pairs = identity.club_pairs(
        names(_ours(ws), "player_name", "left_name"), names(_clubs(ws), "name", "right_name"), 70.0
    )
    return rounded(pairs)


@query(
    "expand_rosters",
    using(
        "",
        """select team, s_suppkey as member, s_name as name from (
          select n_name as team, n_nationkey as club from nation where n_nationkey % 4 <> 0)
        join supplier on s_nationkey = club""",
    ),
)
def expand_rosters(ws: Workspace) -> DataFrame:
    """Nations as teams, matched to clubs whose squads are their suppliers."""
    nations = ws.table("nation").select(
        F.lit("world").alias("league"), F.col("n_name").alias("team"), "n_nationkey"
    )
    matched = nations.where("n_nationkey % 4 <> 0").select(
        "league", "team", F.col("n_nationkey").cast("string").alias("club_id")
    )
    squads = ws.table("supplier").select(
        F.col("s_nationkey").cast("string").alias("club_id"),
        F.col("s_suppkey").alias("member"),
        F.col("s_name").alias("name"),
    )
    rosters = market.expand_rosters(nations.select("league", "team"), matched, squads)
    return rosters.select("team", "member", "name")
