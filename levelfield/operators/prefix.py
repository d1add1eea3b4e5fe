"""Running sums over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from levelfield.session import materialise


def same(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equality of two aliased frames on ``keys``, NULL equal to NULL."""
    pairs = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    return reduce(lambda a, b: a & b, pairs)


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str]
) -> DataFrame:
    """Add ``<name>_upto`` (sum of ``name`` up to and with the row) and ``<name>_total``.

    Rows are dealt by range of (keys, order), so a group that holds most of the rows lies
    in many partitions: the running sum inside each, plus what its earlier partitions
    hold.  Rows that tie in ``order`` should be merged before.  Sums of integers and
    decimals do not depend on how the rows were dealt.
    """
    keys, part = list(keys), "__part"
    dealt = df.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id())
    stored = materialise(dealt, "dealt")
    shares = stored.groupBy(*keys, part).agg(*[F.sum(s).alias(s) for s in sums])
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(
        shares.select(
            *keys,
            part,
            *[F.coalesce(F.sum(s).over(earlier), F.col(s) * 0).alias(f"{s}_before") for s in sums],
            *[F.sum(s).over(whole).alias(f"{s}_total") for s in sums],
        ),
        "offsets",
    )
    inside = Window.partitionBy(*keys, part).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = stored.withColumns({f"{s}_upto": F.sum(s).over(upto) for s in sums})
    joined = running.alias("r").join(offsets.alias("o"), same("r", "o", [*keys, part]))
    return joined.select(
        *[F.col(f"r.{c}") for c in df.columns],
        *[(F.col(f"r.{s}_upto") + F.col(f"o.{s}_before")).alias(f"{s}_upto") for s in sums],
        *[F.col(f"o.{s}_total") for s in sums],
    )
