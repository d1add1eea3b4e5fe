"""Four findings that greet a season."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelfield import catalog
from levelfield.catalog import KEYS
from levelfield.operators.rates import number, settled


def overperformer(players: DataFrame, min_xg: float = 1.0) -> DataFrame:
    """Who scores most above their chances, season by season."""
    difference = number("np_goals") - number("np_xg")
    best = F.min_by(
        F.struct("league", "team", "player", "np_goals", "np_xg", "difference"),
        F.struct(-F.col("difference"), *KEYS),
    )
    return (
        players.withColumn("difference", difference)
        .where((number("np_xg") >= min_xg) & (F.col("difference") > 0))
        .groupBy("season")
        .agg(best.alias("w"))
        .select("season", "w.*")
    )


def young_standout(
    players: DataFrame,
    ages: DataFrame,
    percentiles: DataFrame,
    metrics: Sequence[str],
    max_age: int = catalog.YOUNG_AGE,
    high: float = catalog.HIGH_PERCENTILE,
) -> DataFrame:
    """The youngest entity already at a high percentile, season by season."""
    aged = players.select(*KEYS, "entity_id").join(
        ages.where(F.col("age") <= max_age), "entity_id"
    )
    p = F.col("percentile_per90")
    best = percentiles.where(F.col("metric").isin(*metrics)).groupBy(*KEYS).agg(
        F.max(p).alias("percentile"),
        F.min_by("metric", F.struct(-p, F.col("metric"))).alias("metric"),
    )
    pick = F.min_by(
        F.struct("league", "team", "player", "age", "metric", "percentile"),
        F.struct("age", *KEYS),
    )
    return (
        aged.join(best.where(F.col("percentile") >= high), list(KEYS))
        .groupBy("season")
        .agg(pick.alias("w"))
        .select("season", "w.*")
    )


def sharpest_contrast(percentiles: DataFrame) -> DataFrame:
    """The entity whose families lie furthest apart, season by season."""
    families = F.create_map(
        *[F.lit(x) for f, ms in catalog.FAMILIES.items() for m in ms for x in (m, f)]
    )
    means = (
        percentiles.withColumn("family", F.try_element_at(families, F.col("metric")))
        .where("family is not null")
        .groupBy(*KEYS, "family")
        .agg(F.avg("percentile_per90").alias("m"))
        .where("m is not null")
    )
    spread = means.groupBy(*KEYS).agg(
        F.count("*").alias("families"),
        F.max("m").alias("high"),
        F.min("m").alias("low"),
        F.max_by("family", F.struct("m", "family")).alias("high_family"),
        F.min_by("family", F.struct("m", "family")).alias("low_family"),
    )
    pick = F.min_by(
        F.struct("league", "team", "player", "high_family", "high", "low_family", "low"),
        F.struct(-settled(F.col("high") - F.col("low"), 6), *KEYS),
    )
    return (
        spread.where(F.col("families") == len(catalog.FAMILIES))
        .groupBy("season")
        .agg(pick.alias("w"))
        .select("season", "w.*")
    )
