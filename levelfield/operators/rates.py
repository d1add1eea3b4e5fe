"""Exposure thresholds, per-90 rates, possession adjustment and shrinkage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelfield import catalog
from levelfield.catalog import Metric
from levelfield.session import materialise

SHRINK_GROUP = ("league", "season", "position_group")


def number(column: str | Column) -> Column:
    """Lenient numeric read: text that is no number, and NaN, become NULL."""
    value = (F.col(column) if isinstance(column, str) else column).try_cast("double")
    return F.when(~F.isnan(value), value)


def settled(value: Column, decimals: int) -> Column:
    """Round a sum or mean for display.

    The last bits of a floating-point sum depend on row order; settling them at
    nine decimals first keeps halves from rounding either way.
    """
    return F.round(F.round(value, 9), decimals)


def adaptive_threshold(
    players: DataFrame,
    configured: int = catalog.MIN_MINUTES,
    ratio: float = catalog.MIN_MINUTES_RATIO,
    by: Sequence[str] = ("season",),
) -> DataFrame:
    """Exposure threshold per season: lowered while little has been played."""
    most = F.max(number("minutes"))
    lowered = F.least(F.lit(float(configured)), F.lit(ratio) * most).cast("int")
    return players.groupBy(*by).agg(
        most.alias("max_minutes"),
        F.when(most > 0, F.greatest(F.lit(1), lowered))
        .otherwise(F.lit(configured))
        .alias("min_minutes"),
    )


def eligible(players: DataFrame, min_minutes: int | DataFrame) -> DataFrame:
    """Comparable population: enough exposure and a known group.

    ``min_minutes`` is a number or a threshold table keyed by season.
    """
    if isinstance(min_minutes, int):
        kept = players.where(number("minutes") >= min_minutes)
    else:
        limits = min_minutes.select("season", "min_minutes")
        kept = (
            players.join(limits, "season")
            .where(number("minutes") >= F.col("min_minutes"))
            .drop("min_minutes")
        )
    return kept.where(F.col("position_group").isNotNull())


def per_90(players: DataFrame, metrics: Sequence[Metric]) -> DataFrame:
    """Add ``<metric>_p90``; NULL without positive exposure."""
    nineties = number("minutes") / F.lit(90.0)
    rates = {
        f"{m.name}_p90": F.when(nineties > 0, number(m.name) / nineties)
        for m in metrics
        if m.per90 and m.name in players.columns
    }
    return players.withColumns(rates) if rates else players


def team_possession(teams: DataFrame) -> DataFrame:
    """Possession per (league, season, team): published, or else the pass share.

    A season whose source publishes any value keeps to the published ones; which it is,
    is a flag per season inside the plan.
    """
    low, high = (F.lit(v) for v in catalog.POSSESSION_RANGE)
    if not {"possession_pct", "passes_attempted"} & set(teams.columns):
        raise KeyError("possession needs possession_pct or passes_attempted")

    def side(column: str, perspective: str) -> Column:
        value = number(column) if column in teams.columns else F.lit(None).cast("double")
        return F.max(F.when(F.col("perspective") == perspective, value))

    keys = ["league", "season", "team"]
    sides = (
        teams.groupBy(*keys)
        .agg(
            F.max(F.when(F.col("perspective") == "for", 1)).alias("has_for"),
            side("possession_pct", "for").alias("published"),
            side("passes_attempted", "for").alias("own"),
            side("passes_attempted", "against").alias("rival"),
        )
        .where("has_for = 1")
    )
    publishing = sides.groupBy("season").agg((F.count("published") > 0).alias("publishes"))
    total = F.col("own") + F.col("rival")
    share = F.when(total > 0, F.col("own") / total * 100.0)
    value = F.when(F.col("publishes"), F.col("published")).otherwise(share)
    clipped = F.when(value.isNotNull(), F.greatest(low, F.least(high, value)))
    return sides.join(publishing, "season").select(*keys, clipped.alias("possession_pct"))


def possession_adjust(
    players: DataFrame, metrics: Sequence[Metric], possession: DataFrame
) -> DataFrame:
    """Add ``<metric>_padj`` for the metrics that depend on time without the ball."""
    without = F.lit(100.0) - F.col("possession_pct")
    factor = F.when(without > 0, F.lit(catalog.NEUTRAL_POSSESSION) / without)
    adjusted = {
        f"{m.name}_padj": F.col(f"{m.name}_p90") * factor
        for m in metrics
        if "chances" in m.traits and f"{m.name}_p90" in players.columns
    }
    joined = players.join(possession, ["league", "season", "team"], "left")
    return joined.withColumns(adjusted) if adjusted else joined


def weight(minutes: str | Column, half_life: int | Column) -> Column:
    """Share of a value that is the entity's own; one half at ``half_life``."""
    played = number(minutes)
    k = half_life if isinstance(half_life, Column) else F.lit(float(half_life))
    return F.when((played > 0) & (k > 0), played / (played + k)).otherwise(F.lit(0.0))


def reliability(minutes: str | Column, metric: str) -> Column:
    return settled(weight(minutes, catalog.half_life(metric)), 3)


def shrink_value(value: Column, mean: Column, minutes: str | Column, half_life: int) -> Column:
    """Pull ``value`` towards ``mean``; unchanged when the group has no mean."""
    played = F.coalesce(number(minutes), F.lit(0.0))
    w = played / (played + F.lit(float(half_life)))
    return F.when(mean.isNull(), value).otherwise(w * value + (F.lit(1.0) - w) * mean)


def group_means(
    rates: DataFrame, metrics: Sequence[Metric], by: Sequence[str] = SHRINK_GROUP
) -> DataFrame:
    """Mean rate per group: pre-aggregated, so a hot group never meets in one task."""
    return rates.groupBy(*by).agg(
        *[F.avg(f"{m.name}_p90").alias(f"{m.name}_mean") for m in catalog.rated(metrics)]
    )


def shrunk_rates(
    rates: DataFrame, metrics: Sequence[Metric], by: Sequence[str] = SHRINK_GROUP
) -> DataFrame:
    """Add ``<metric>_shrunk`` to a frame that already carries ``_p90`` columns."""
    means = materialise(group_means(rates, metrics, by), "group_means")
    shrunk = {
        f"{m.name}_shrunk": shrink_value(
            F.col(f"{m.name}_p90"), F.col(f"{m.name}_mean"), "minutes", catalog.half_life(m.name)
        )
        for m in catalog.rated(metrics)
    }
    wide = rates.join(means, list(by), "left").withColumns(shrunk)
    return wide.drop(*[f"{m.name}_mean" for m in catalog.rated(metrics)])
