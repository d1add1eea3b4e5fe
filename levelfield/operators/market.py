"""Dated valuations, market context and squad roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from levelfield import catalog
from levelfield.catalog import KEYS
from levelfield.functions import parse
from levelfield.operators.teams import TEAM_KEYS

YOUNG, VETERAN, LABELLED = 23, 30, 6


def latest_value(
    valuations: DataFrame, key: str = "entity_id", order: Sequence[str] = ("valuation_date",)
) -> DataFrame:
    """Most recent valuation per id; one pre-aggregated pass, no sort."""
    last = F.max_by("market_value", F.struct(*order))
    return valuations.groupBy(key).agg(
        F.max("valuation_date").alias("valuation_date"), last.alias("market_value")
    )


def value_peak(valuations: DataFrame, order: Sequence[str] = ("valuation_date",)) -> DataFrame:
    """Current and highest value per id, and whether it has fallen from the top."""
    known = F.col("market_value").isNotNull()
    current = F.max_by("market_value", F.when(known, F.struct(*order)))
    return (
        valuations.groupBy("entity_id")
        .agg(
            F.count("*").alias("valuations"),
            current.alias("current_value"),
            F.max("market_value").alias("peak_value"),
        )
        .withColumn("below_peak", F.col("current_value") < F.col("peak_value"))
    )


def squad_market(players: DataFrame, profiles: DataFrame, latest: DataFrame) -> DataFrame:
    """Age, position and latest value of every valued squad member."""
    return (
        players.select(*KEYS, "entity_id")
        .join(profiles.select("entity_id", "age", "position"), "entity_id")
        .join(latest.select("entity_id", "market_value"), "entity_id")
        .select(*KEYS, "age", "position", "market_value")
    )


def market_context(profiles: DataFrame, latest: DataFrame) -> DataFrame:
    """Every profile with its latest value, valued or not."""
    return profiles.select(
        "entity_id", "age", "position", "nationality", "contract_until"
    ).join(latest.select("entity_id", "market_value"), "entity_id", "left")


def team_market_value(
    players: DataFrame, latest: DataFrame, min_coverage: float = catalog.MIN_COVERAGE
) -> DataFrame:
    """Sum of latest values per team, published only when most of the squad is valued."""
    squads = players.select(*KEYS, "entity_id").join(latest, "entity_id", "left")
    teams = squads.groupBy(*TEAM_KEYS).agg(
        F.max("valuation_date").alias("valuation_date"),
        F.sum(F.col("market_value").cast("decimal(18,2)")).alias("market_value"),
        F.count("market_value").alias("squad_size"),
        F.count_distinct("player").alias("squad_total"),
    )
    return teams.where(F.try_divide("squad_size", "squad_total") >= min_coverage)


def squad_age_value(squad: DataFrame) -> DataFrame:
    """Mean age, total value and how much of it is young, per team."""
    age, value = F.col("age"), F.col("market_value").cast("decimal(18,2)")
    known = squad.where(age.isNotNull() & (F.col("market_value") != 0))
    return known.groupBy(*TEAM_KEYS).agg(
        F.count("*").alias("players"),
        F.round(F.avg(age), 1).alias("mean_age"),
        F.sum(value).cast("double").alias("total_value"),
        F.count_if(age <= YOUNG).alias("young"),
        F.count_if(age >= VETERAN).alias("veterans"),
        F.round(
            F.sum(F.when(age <= YOUNG, value).otherwise(0)).cast("double")
            / F.sum(value).cast("double")
            * 100,
            4,
        ).alias("young_share"),
    )


def squad_by_value(squad: DataFrame, limit: int = LABELLED) -> DataFrame:
    """Each team's most valuable members."""
    order = Window.partitionBy(*TEAM_KEYS).orderBy(
        F.coalesce("market_value", F.lit(0.0)).desc(), "player"
    )
    return squad.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def entity_card(
    profiles: DataFrame, valuations: DataFrame, transfers: DataFrame, entity_id: str
) -> dict[str, DataFrame]:
    """Profile, dated values and moves of one entity, each in date order."""
    wanted = F.col("entity_id") == entity_id
    return {
        "profile": profiles.where(wanted),
        "market_value": valuations.where(wanted).orderBy("valuation_date"),
        "transfers": transfers.where(wanted).orderBy("transfer_date"),
    }


def scouting_search(
    percentiles: DataFrame,
    players: DataFrame,
    context: DataFrame,
    metric: str,
    today: Column,
    season: str | None = None,
    min_percentile: float = 80.0,
    position_group: str | None = None,
    max_age: int | None = None,
    max_months_left: int | None = None,
    max_value: float | None = None,
    limit: int | None = 25,
) -> DataFrame:
    """Who performs and also fits by age, contract and price.

    Bounds are plain comparisons, so entities with unknown context drop out of
    a bound that is set and stay when it is not.
    """
    kept = percentiles.where(
        (F.col("metric") == metric) & (F.col("percentile_per90") >= min_percentile)
    )
    if season:
        kept = kept.where(F.col("season") == season)
    if position_group:
        kept = kept.where(F.col("position_group") == position_group)
    ids = players.select(*KEYS, "entity_id").dropDuplicates(list(KEYS))
    found = (
        kept.join(ids, list(KEYS), "left")
        .join(context.drop("position"), "entity_id", "left")
        .withColumn("months_left", parse.months_left("contract_until", today))
    )
    for column, bound in (
        ("age", max_age),
        ("months_left", max_months_left),
        ("market_value", max_value),
    ):
        if bound is not None:
            found = found.where(F.col(column) <= bound)
    hits = found.select(
        *KEYS,
        "position_group",
        "minutes",
        "age",
        "contract_until",
        "months_left",
        "market_value",
        "metric",
        "label",
        "percentile_per90",
    )
    ranked = hits.orderBy(F.col("percentile_per90").desc(), *KEYS)
    ranked = ranked if limit is None else ranked.limit(limit)
    return ranked.withColumn("percentile", F.round("percentile_per90", 1)).drop("percentile_per90")


def context_coverage(hits: DataFrame, column: str = "age") -> DataFrame:
    """How many rows lack context, for the caveat."""
    return hits.agg(
        F.count("*").alias("rows"), F.count_if(F.col(column).isNull()).alias("without_context")
    )


def season_roster(
    players: DataFrame,
    season: str | None = None,
    team: str | None = None,
    league: str | None = None,
) -> DataFrame:
    """Everybody with an id, by team and name."""
    kept = players.where(F.col("entity_id").isNotNull())
    for column, value in (("season", season), ("team", team), ("league", league)):
        if value is not None:
            kept = kept.where(F.col(column) == value)
    return kept.select("season", "league", "team", "player", "entity_id").orderBy(
        "season", "team", "player"
    )


def stale_entities(
    players: DataFrame,
    valuations: DataFrame,
    scraped_at: str,
    now: Column,
    freshness_hours: int = 720,
    limit: int | None = None,
    season: str | None = None,
    team: str | None = None,
    league: str | None = None,
) -> DataFrame:
    """Roster members without a value read inside the freshness window."""
    horizon = now - F.make_dt_interval(hours=F.lit(freshness_hours))
    fresh = valuations.where(F.col(scraped_at) > horizon).select("entity_id").distinct()
    due = season_roster(players, season, team, league).join(fresh, "entity_id", "left_anti")
    due = due.orderBy("season", "team", "player")
    return due if limit is None else due.limit(limit)


def expand_rosters(teams: DataFrame, club_matches: DataFrame, squads: DataFrame) -> DataFrame:
    """Team → matched club → its squad members."""
    matched = teams.join(club_matches, ["league", "team"])
    return matched.join(squads, "club_id")
