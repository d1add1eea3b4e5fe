"""Average-tie percentile inside a population, exact at any population size.

The percentile of a value is its average rank among the non-null values of its population
divided by their number.  Equal values are merged before anything is ordered, so a value
that a third of the rows share is one row with a count; the counts are summed up in order
over range partitions, so a population of any size is spread over all tasks; and every
row then looks its value up.  There is one form for every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelfield.operators.prefix import running_sums, same
from levelfield.session import materialise


def percentile_within(df: DataFrame, keys: Sequence[str], measures: dict[str, str]) -> DataFrame:
    """Add one percentile (0..100) per measure; ``measures`` maps input to output.

    The input is read once per measure, so it should be stored where it is dear.
    """
    keys, names = list(keys), list(measures)
    cells = [
        F.struct(F.lit(i).alias("__m"), F.col(m).cast("double").alias("__v"))
        for i, m in enumerate(names)
    ]
    values = (
        df.select(*keys, F.inline(F.array(*cells)))
        .where("__v is not null")
        .groupBy(*keys, "__m", "__v")
        .agg(F.count("*").alias("__n"))
    )
    summed = running_sums(values, [*keys, "__m"], ["__v"], ["__n"])
    both_ends = 2 * (F.col("__n_upto") - F.col("__n")) + F.col("__n") + 1
    share = both_ends / F.lit(2.0) / F.col("__n_total") * 100.0
    shares = materialise(summed.select(*keys, "__m", "__v", share.alias("__share")), "shares")
    result = df
    for i, measure in enumerate(names):
        part = shares.where(F.col("__m") == i)
        matched = same("r", "s", keys) & (F.col(f"r.{measure}").cast("double") == F.col("s.__v"))
        result = (
            result.alias("r")
            .join(part.alias("s"), matched, "left")
            .select("r.*", F.col("s.__share").alias(measures[measure]))
        )
    return result
