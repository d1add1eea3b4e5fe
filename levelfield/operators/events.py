"""Shot summaries, conceded shots, form and trajectory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from levelfield import catalog
from levelfield.operators.prefix import running_sums
from levelfield.operators.rates import settled
from levelfield.sources.shaping import PENALTY


def _open_play() -> Column:
    return ~F.col("situation").eqNullSafe(F.lit(PENALTY))


def _xg() -> Column:
    return F.coalesce(F.col("xg"), F.lit(0.0))


def _exact(value: Column) -> Column:
    """As a decimal: sums of these do not depend on the order of the rows."""
    return value.cast("decimal(28, 12)")


def entity_shots(shots: DataFrame, season: str, entity_id: str) -> DataFrame:
    """Shots of one entity and season, in playing order."""
    kept = (F.col("season") == season) & (F.col("entity_id") == entity_id)
    return shots.where(kept).orderBy("match_date", "minute", "shot_id")


def event_summary(shots: DataFrame, by: Sequence[str] = ("season", "entity_id")) -> DataFrame:
    """Total xG, xG without penalties, goals and mean chance quality per entity."""
    np_xg, np_shots = F.sum(F.when(_open_play(), _xg())), F.count_if(_open_play())
    return shots.groupBy(*by).agg(
        F.count("*").alias("shots"),
        np_shots.alias("np_shots"),
        settled(F.sum(_xg()), 3).alias("total_xg"),
        settled(F.coalesce(np_xg, F.lit(0.0)), 3).alias("np_xg"),
        F.count_if(F.col("result") == "Goal").alias("goals"),
        settled(F.try_divide(np_xg, np_shots), 3).alias("xg_per_shot"),
        (np_shots < catalog.MIN_SHOTS).alias("few_shots"),
    )


def actual_vs_expected(summary: DataFrame, goals: Column | None = None) -> DataFrame:
    """Goals minus expected.  The headline keeps penalties in the goals only."""
    df = summary.withColumn("difference", settled(F.col("goals") - F.col("np_xg"), 3))
    return df.withColumn("above", F.col("difference") >= 0)


def event_mix(shots: DataFrame, by: Sequence[str] = ("season", "entity_id")) -> DataFrame:
    """Shots and mean xG by situation, most frequent first."""
    kind = F.coalesce(F.when(F.col("situation") != "", F.col("situation")), F.lit("Sin clasificar"))
    return (
        shots.groupBy(*by, kind.alias("kind"))
        .agg(F.count("*").alias("shots"), settled(F.avg(_xg()), 3).alias("mean_xg"))
        .orderBy(*by, F.col("shots").desc(), "kind")
    )


def events_conceded(shots: DataFrame, season: str, team: str) -> DataFrame:
    """Shots by the rivals in the games where ``team`` has shots."""
    own = shots.where((F.col("season") == season) & (F.col("team") == team))
    games = own.select("game_id").distinct()
    rivals = shots.where(F.col("team") != team)
    return rivals.join(games, "game_id", "left_semi")


def conceded_summary(shots: DataFrame) -> DataFrame:
    """Conceded totals of every team and season.

    What a team concedes in a game is the game's total less its own share, so one
    pre-aggregation and a sum over the teams of a game replace pairing every shot
    with every rival.  xG is summed as a decimal, so the subtraction is exact.
    """
    open_play = _open_play()
    xg = _exact(_xg())
    measures = {
        "shots": F.count("*"),
        "np_shots": F.count_if(open_play),
        "xg": F.sum(xg),
        "np_xg": F.sum(F.when(open_play, xg).otherwise(_exact(F.lit(0)))),
        "goals": F.count_if(F.col("result") == "Goal"),
    }
    shares = shots.groupBy("season", "game_id", "team").agg(
        *[m.alias(n) for n, m in measures.items()]
    )
    game = Window.partitionBy("game_id")
    conceded = shares.withColumns({n: F.sum(n).over(game) - F.col(n) for n in measures})
    return (
        conceded.groupBy("season", "team")
        .agg(
            F.count_if(F.col("shots") > 0).alias("matches"),
            F.sum("shots").alias("shots"),
            settled(F.sum("xg").cast("double"), 3).alias("xg_conceded"),
            F.sum("goals").alias("goals_conceded"),
            settled(
                F.try_divide(F.sum("np_xg").cast("double"), F.sum("np_shots")), 3
            ).alias("xg_per_shot"),
        )
    )


def conceded_per_match(conceded: DataFrame) -> DataFrame:
    played = F.greatest(F.col("matches"), F.lit(1))
    return conceded.select(
        "season",
        "team",
        "matches",
        settled(F.col("shots") / played, 3).alias("shots_per_match"),
        settled(F.col("xg_conceded") / played, 3).alias("xg_per_match"),
    )


def cumulative_trajectory(
    matches: DataFrame, by: Sequence[str] = ("season", "entity_id")
) -> DataFrame:
    """Matches with running goals and xG, in label order (labels start with the date).

    Running totals are decimals over range partitions, so the busiest entity, or the
    busiest day of one, is spread like any other rows.
    """
    filled = matches.select(
        *by,
        "match_label",
        "game_id",
        "position",
        F.coalesce(F.col("minutes"), F.lit(0)).alias("minutes"),
        F.coalesce(F.col("goals").cast("bigint"), F.lit(0)).alias("goals"),
        _exact(_xg()).alias("xg"),
        F.coalesce(F.col("assists"), F.lit(0)).alias("assists"),
        F.coalesce(F.col("xa"), F.lit(0.0)).alias("xa"),
    )
    summed = running_sums(filled, by, ["match_label", "game_id"], ["goals", "xg"])
    return summed.select(
        *by,
        "match_label",
        "position",
        "minutes",
        "goals",
        settled(F.col("xg").cast("double"), 3).alias("xg"),
        "assists",
        settled(F.col("xa"), 3).alias("xa"),
        F.col("goals_upto").alias("cumulative_goals"),
        settled(F.col("xg_upto").cast("double"), 3).alias("cumulative_xg"),
    )


def entity_form(
    matches: DataFrame,
    window: int = catalog.RECENT_MATCHES,
    by: Sequence[str] = ("season", "entity_id"),
) -> DataFrame:
    """xG per 90 over the last ``window`` matches against the entity's own season.

    The row-number filter is applied before the shuffle as well, so at most
    ``window`` rows per entity and task move.
    """
    played = F.coalesce(F.col("minutes").cast("double"), F.lit(0.0))

    def per_90() -> Column:
        minutes = F.sum(played)
        return F.when(minutes > 0, settled(F.sum(_xg()) / minutes * 90.0, 3))

    latest = Window.partitionBy(*by).orderBy(F.col("match_label").desc(), F.col("game_id").desc())
    recent = (
        matches.select(*by, "match_label", "game_id", "minutes", "xg")
        .withColumn("n", F.row_number().over(latest))
        .where(F.col("n") <= window)
        .groupBy(*by)
        .agg(
            F.count("*").alias("recent_matches"),
            per_90().alias("recent_xg90"),
            F.sum(played).cast("bigint").alias("recent_minutes"),
        )
    )
    season = matches.groupBy(*by).agg(
        F.count("*").alias("matches"), per_90().alias("season_xg90")
    )
    return season.join(recent, list(by)).withColumns(
        {
            "delta_xg90": settled(F.col("recent_xg90") - F.col("season_xg90"), 3),
            "few_matches": F.col("matches") < catalog.MIN_MATCHES_FOR_FORM,
        }
    )
