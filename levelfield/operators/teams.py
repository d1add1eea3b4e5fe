"""Team season totals, style features and readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelfield import catalog
from levelfield.operators.rates import number

TEAM_KEYS = ("league", "season", "team")


def season_rollup(
    matches: DataFrame,
    totals: Sequence[str] = ("xg", "np_xg", "goals", "deep_completions"),
    ratios: Sequence[str] = ("ppda",),
) -> DataFrame:
    """Fixtures with ``home_``/``away_`` columns → both perspectives per team season.

    Totals are summed, ratios averaged.  Each fixture becomes two rows that carry
    both sides, so one pre-aggregated shuffle yields the two perspectives.
    """
    measures = [*totals, *ratios]

    def side(own: str, rival: str) -> Column:
        league = f"{own}_league" if f"{own}_league" in matches.columns else "league"
        return F.struct(
            F.col(league).alias("league"),
            F.col("season"),
            F.col(f"{own}_team").alias("team"),
            *[F.col(f"{own}_{m}").cast("double").alias(f"for_{m}") for m in measures],
            *[F.col(f"{rival}_{m}").cast("double").alias(f"against_{m}") for m in measures],
        )

    views = ("for", "against")
    sides = matches.select(F.inline(F.array(side("home", "away"), side("away", "home"))))
    seasons = sides.groupBy(*TEAM_KEYS).agg(
        F.count("*").alias("matches"),
        *[F.sum(f"{v}_{m}").alias(f"{v}_{m}") for v in views for m in totals],
        *[F.avg(f"{v}_{m}").alias(f"{v}_{m}") for v in views for m in ratios],
    )
    rows = [
        F.struct(
            F.lit(v).alias("perspective"), *[F.col(f"{v}_{m}").alias(m) for m in measures]
        )
        for v in views
    ]
    return seasons.select(*TEAM_KEYS, "matches", F.inline(F.array(*rows)))


def style_features(teams: DataFrame) -> DataFrame:
    """Eight features per team season; a higher value always means more of it."""

    def seen(column: str, perspective: str) -> Column:
        return F.max(F.when(F.col("perspective") == perspective, number(column))).alias(
            f"{perspective}_{column}"
        )

    both = teams.groupBy(*TEAM_KEYS).agg(
        F.max(F.when(F.col("perspective") == "for", 1)).alias("has_for"),
        *[
            seen(c, "for")
            for c in ("matches_played", "ppda", "deep_completions", "np_xg", "goals")
        ],
        *[seen(c, "against") for c in ("ppda", "deep_completions", "np_xg")],
    )
    c = F.col
    played = F.when(c("for_matches_played") > 0, c("for_matches_played"))
    arrivals = F.when(c("for_deep_completions") > 0, c("for_deep_completions"))
    return both.where("has_for = 1").select(
        *TEAM_KEYS,
        (-c("for_ppda")).alias("pressing"),
        (c("for_deep_completions") / played).alias("territory"),
        (c("for_np_xg") / played).alias("chance_creation"),
        (-(c("against_np_xg") / played)).alias("chance_prevention"),
        ((c("for_goals") - c("for_np_xg")) / played).alias("finishing"),
        (c("for_np_xg") / arrivals).alias("chance_quality"),
        (-c("against_ppda")).alias("pressed"),
        (-(c("against_deep_completions") / played)).alias("box_defence"),
    )


def territorial_team(teams: DataFrame) -> DataFrame:
    """The team season that reaches the rival's box most often per match."""
    played = number("matches_played")
    rate = F.when(played > 0, number("deep_completions") / played)
    return (
        teams.where("perspective = 'for'")
        .select(*TEAM_KEYS, rate.alias("per_match"))
        .where("per_match is not null")
        .orderBy(F.col("per_match").desc(), *TEAM_KEYS)
        .limit(1)
    )


def team_cards(players: DataFrame, identities: DataFrame, pattern: str) -> DataFrame:
    """Squad size per team and season, with the crest address when the club is known."""
    sizes = players.groupBy(*TEAM_KEYS).agg(F.count("*").alias("squad_size"))
    clubs = identities.select(*TEAM_KEYS, "external_id")
    crest = F.when(F.col("external_id") != "", F.format_string(pattern, "external_id"))
    return (
        sizes.join(clubs, list(TEAM_KEYS), "left")
        .withColumn("crest_url", crest)
        .drop("external_id")
        .orderBy(*TEAM_KEYS)
    )


def teams_of(players: DataFrame, season: str | None = None, league: str | None = None) -> DataFrame:
    """Teams with loaded players."""
    kept = players if season is None else players.where(F.col("season") == season)
    if league is not None:
        kept = kept.where(F.col("league") == league)
    return kept.select("season", "league", "team").distinct().orderBy("season", "league", "team")


def pressing_band(ppda: Column) -> Column:
    """Low passes allowed per defensive action means high pressing."""
    return (
        F.when(ppda < catalog.PPDA_HIGH, "high")
        .when(ppda > catalog.PPDA_LOW, "low")
        .when(ppda.isNotNull(), "medium")
    )


def style_map(styled: DataFrame) -> DataFrame:
    """Points of the style plane: territory against PPDA, complete points only."""
    return styled.select(
        *TEAM_KEYS,
        "territory",
        (-F.col("pressing")).alias("ppda"),
        *[c for c in ("style", "cluster") if c in styled.columns],
    ).dropna(subset=["territory", "ppda"])
