"""The population pipeline: eligible, rated, adjusted, shrunk, ranked.

Ranking always sees every league; a league filter belongs on the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelfield import catalog
from levelfield.catalog import BASES, KEYS, Metric
from levelfield.operators import rates, ranking
from levelfield.session import materialise

CONTEXT = ("position_group", "detailed_position", "minutes")


def metrics_long(wide: DataFrame, metrics: Sequence[Metric]) -> DataFrame:
    """One row per (entity, metric), in one pass over the wide frame."""

    def optional(name: str) -> Column:
        return F.col(name) if name in wide.columns else F.lit(None).cast("double")

    cells = [
        F.struct(
            F.lit(m.name).alias("metric"),
            F.lit(m.label).alias("label"),
            rates.number(m.name).alias("value"),
            F.col(f"{m.name}_p90").alias("per90"),
            optional(f"{m.name}_padj").alias("padj"),
            optional(f"{m.name}_shrunk").alias("shrunk"),
            F.lit(m.higher_is_better).cast("boolean").alias("higher_is_better"),
        )
        for m in catalog.rated(tuple(metrics))
        if m.name in wide.columns
    ]
    context = [c for c in CONTEXT if c in wide.columns]
    return wide.select(*KEYS, *context, F.inline(F.array(*cells)))


def orient(percentile: Column, higher_is_better: Column) -> Column:
    """Turn the scale round where a low value is the good one; style stays as is."""
    return F.when(higher_is_better.eqNullSafe(F.lit(False)), 100.0 - percentile).otherwise(
        percentile
    )


def rated_population(
    players: DataFrame,
    metrics: Sequence[Metric],
    min_minutes: int | DataFrame,
    possession: DataFrame | None = None,
) -> DataFrame:
    """Wide frame of the comparable population with all three bases."""
    wide = rates.per_90(rates.eligible(players, min_minutes), metrics)
    if possession is not None:
        wide = rates.possession_adjust(wide, metrics, possession)
    return rates.shrunk_rates(wide, metrics)


def population_percentiles(
    players: DataFrame,
    metrics: Sequence[Metric],
    min_minutes: int | DataFrame,
    possession: DataFrame | None = None,
    population_keys: Sequence[str] = catalog.POPULATION_KEYS["position"],
) -> DataFrame:
    """Percentile of every entity and metric on each basis, on the raw values."""
    wide = rated_population(players, metrics, min_minutes, possession)
    long = materialise(metrics_long(wide, metrics), "metrics_long")
    ranked = ranking.percentile_within(
        long, [*population_keys, "metric"], {b: f"percentile_{b}" for b in BASES}
    )
    direction = F.col("higher_is_better")
    return ranked.withColumns(
        {f"percentile_{b}": orient(F.col(f"percentile_{b}"), direction) for b in BASES}
    )


def percentiles_wide(
    percentiles: DataFrame, metrics: Sequence[str], basis: str = "per90"
) -> DataFrame:
    """One row per entity, one column per metric."""
    return (
        percentiles.groupBy(*KEYS)
        .pivot("metric", list(metrics))
        .agg(F.first(f"percentile_{basis}", ignorenulls=True))
    )


def percentile_stats(percentiles: DataFrame, population_keys: Sequence[str]) -> DataFrame:
    """How many entities, metrics and populations a run covered."""
    return percentiles.agg(
        F.count_distinct(*KEYS).alias("entities"),
        F.count_distinct("metric").alias("metrics"),
        F.count_distinct(F.struct(*population_keys)).alias("populations"),
    )


def population_size(percentiles: DataFrame, column: str) -> DataFrame:
    """Distinct (entity, team) pairs per season and comparison group."""
    return (
        percentiles.where(F.col(column).isNotNull())
        .select("season", column, "player", "team")
        .distinct()
        .groupBy("season", column)
        .agg(F.count("*").alias("population_size"))
    )


def population_context(
    players: DataFrame,
    configured: int = catalog.MIN_MINUTES,
    ratio: float = catalog.MIN_MINUTES_RATIO,
) -> DataFrame:
    """Leagues and thresholds that support each season's percentiles."""
    leagues = players.groupBy("season").agg(F.count_distinct("league").alias("leagues"))
    limits = rates.adaptive_threshold(players, configured, ratio)
    return leagues.join(limits, "season").withColumn(
        "configured_min_minutes", F.lit(configured)
    )
