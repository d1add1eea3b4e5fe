"""Entities with the percentile profile closest to a given one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from levelfield import catalog
from levelfield.catalog import KEYS
from levelfield.operators.profiles import family_profile

class AmbiguousEntityError(ValueError):
    """A name stands for several stints, which are never averaged."""


NEIGHBOUR = (
    "league string, season string, team string, player string, minutes bigint, "
    "similarity double, closest string, furthest string"
)


def nearest_profiles(
    percentiles: DataFrame,
    target: dict[str, str],
    metrics: Sequence[str],
    basis: str = "per90",
    n: int = catalog.DEFAULT_NEIGHBOURS,
    min_minutes: int = 0,
    population: str = "position_group",
) -> DataFrame:
    """Neighbours of one entity inside its own group, by distance of percentiles.

    ``target`` holds column values that single out the entity (season, player and,
    for several stints, team); a name with several stints is refused.  ``population`` is
    the column both have to share, the position group or the role.  The axes are those the target has; an axis a
    candidate lacks adds no distance.  The target's few axes become literals, so
    one pre-aggregated pass over the population scores every candidate.
    """
    percentile = f"percentile_{basis}"
    own = percentiles.where(F.col("metric").isin(*metrics))
    for column, wanted in target.items():
        own = own.where(F.col(column) == wanted)
    # One row per stint, its axes (at most one per catalogue metric) in an array; a second
    # row is enough to know that the name is ambiguous.
    axis = F.when(F.col(percentile).isNotNull(), F.struct("metric", F.col(percentile).alias("at")))
    stints = own.groupBy(*KEYS, population).agg(F.collect_list(axis).alias("axes")).limit(2).collect()
    if len(stints) > 1:
        raise AmbiguousEntityError(f"{target} names more than one stint; say which team")
    if not stints or stints[0][population] is None or len(stints[0].axes) < catalog.MIN_SHARED_AXES:
        return percentiles.sparkSession.createDataFrame([], NEIGHBOUR)

    stint = [stints[0][k] for k in KEYS]
    season, group = stints[0].season, stints[0][population]
    axes = {a.metric: a["at"] for a in stints[0].axes}
    vector = F.create_map(*[F.lit(x) for m, v in axes.items() for x in (m, float(v))])
    itself = F.struct(*KEYS) == F.struct(*[F.lit(v).alias(k) for k, v in zip(KEYS, stint)])
    difference = F.abs(F.col(percentile) - F.element_at(vector, F.col("metric")))
    candidates = percentiles.where(
        (F.col("season") == season)
        & (F.col(population) == group)
        & (F.coalesce(F.col("minutes"), F.lit(0)) >= min_minutes)
        & F.col("metric").isin(*axes)
        & ~itself
    ).withColumn("d", F.coalesce(difference, F.lit(0.0)))
    worst = 100.0 * len(axes) ** 0.5
    # One entry per axis, so the array is bounded by the catalogue.
    ordered = F.array_sort(F.collect_list(F.struct("d", "metric")))
    profiles = candidates.groupBy(*KEYS).agg(
        F.max("minutes").cast("bigint").alias("minutes"),
        F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("distance"),
        ordered.alias("gaps"),
    )
    names = F.transform("gaps", lambda g: g["metric"])
    best = (
        profiles.withColumn("similarity", F.round((1.0 - F.col("distance") / worst) * 100.0, 1))
        .orderBy(F.col("distance"), *KEYS)
        .limit(n)
    )
    return best.select(
        *KEYS,
        "minutes",
        "similarity",
        F.array_join(F.slice(names, 1, 2), ", ").alias("closest"),
        F.array_join(F.reverse(F.slice(names, -2, 2)), ", ").alias("furthest"),
    )


def with_families(
    percentiles: DataFrame, neighbours: DataFrame, target: dict[str, str], basis: str = "per90"
) -> DataFrame:
    """Family profile of the target (place 0) and of each neighbour, nearest first."""
    own = percentiles
    for column, wanted in target.items():
        own = own.where(F.col(column) == wanted)
    order = Window.orderBy(F.col("similarity").desc(), *KEYS)  # a page of neighbours
    places = neighbours.select(*KEYS, F.row_number().over(order).alias("place"))
    places = places.unionByName(own.select(*KEYS).distinct().withColumn("place", F.lit(0)))
    rows = percentiles.join(places, list(KEYS))
    families = family_profile(rows, basis)
    return families.join(places, list(KEYS))
