"""Guards and reports on what was loaded."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelfield import catalog
from levelfield.catalog import Metric
from levelfield.functions import parse
from levelfield.operators.rates import number


class IncompleteTableError(RuntimeError):
    """A table arrived with its statistics cells empty."""


def supported(df: DataFrame, known: Iterable[str], column: str = "league") -> DataFrame:
    return df.where(F.col(column).isin(*known))


def unsupported_sources(df: DataFrame, known: Iterable[str], column: str = "league") -> DataFrame:
    """Values that will be ignored, with the rows they hold."""
    return df.where(~F.col(column).isin(*known)).groupBy(column).agg(F.count("*").alias("rows"))


def fill_rate(df: DataFrame, statistics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of rows with at least one number in the statistics columns."""
    filled = reduce(lambda a, b: a | b, [number(c).isNotNull() for c in statistics])
    rate = F.avg(F.when(filled, 1.0).otherwise(0.0))
    return df.groupBy(*by).agg(F.count("*").alias("rows"), rate.alias("fill_rate")).withColumn(
        "complete", F.col("fill_rate") >= catalog.MIN_FILL_RATE
    )


def check_complete(df: DataFrame, statistics: Sequence[str]) -> DataFrame:
    """Return ``df``, or raise when almost no row carries a number."""
    rate = fill_rate(df, statistics).first()["fill_rate"] or 0.0
    if rate < catalog.MIN_FILL_RATE:
        raise IncompleteTableError(f"only {rate:.1%} of the rows carry data")
    return df


def missing_population(expected: DataFrame, loaded: DataFrame, column: str = "league") -> DataFrame:
    """Expected leagues with no loaded row."""
    return expected.select(column).distinct().join(
        loaded.select(column).distinct(), column, "left_anti"
    )


def schema_drift(tables: dict[str, DataFrame], metrics: Sequence[Metric]) -> DataFrame:
    """Every expected column of every source table: whether it is there and how many rows
    fill it.  A column that is there but empty has drifted as much as one that is gone."""
    parts = []
    for source, df in tables.items():
        wanted = sorted({m.found[0] for m in metrics if m.found[1] == source})
        cells = [
            F.struct(
                F.lit(c).alias("name"),
                F.lit(c in df.columns).alias("present"),
                (F.count(c) if c in df.columns else F.lit(0).cast("bigint")).alias("filled"),
            )
            for c in wanted
        ]
        counted = df.agg(F.count("*").alias("rows"), F.array(*cells).alias("cells"))
        parts.append(counted.select(F.lit(source).alias("source"), "rows", F.inline("cells")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def position_quality(df: DataFrame, raw: str = "position_raw") -> DataFrame:
    """Rows with several positions and rows whose position is unknown, per season."""
    groups = parse.split_positions(raw)
    return df.groupBy("season").agg(
        F.count("*").alias("rows"),
        F.count_if(F.size(groups) > 1).alias("hybrid"),
        F.count_if(F.size(groups) == 0).alias("unknown"),
    )


def catalog_values(players: DataFrame) -> DataFrame:
    """Distinct loaded seasons and leagues, sorted."""
    kinds = F.inline(
        F.array(
            *[
                F.struct(F.lit(k).alias("kind"), F.col(k).alias("value"))
                for k in ("league", "season")
            ]
        )
    )
    return players.select(kinds).distinct().orderBy("kind", "value")


def dry_run_counts(outputs: dict[str, DataFrame]) -> DataFrame:
    """Row count of every output a load would write, without writing."""
    counts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("output"), "rows")
        for name, df in outputs.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), counts)
