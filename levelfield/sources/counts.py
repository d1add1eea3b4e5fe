"""Percentiles that loads keep up to date: stored counts of values, merged by addition.

For every population, metric and basis a table holds each value with the number of rows
that have it.  Counts add up, so a load only needs its own rows: they are counted, added to
the counts of the periods they belong to (taken off for rows that left), and only those
periods are written anew, together with the percentile of each of their values.  The other
periods' files are not touched and not read.  All bases go through one ranking and one
look-up.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levelfield.catalog import BASES
from levelfield.operators.prefix import running_sums, same
from levelfield.session import materialise

_PART, _ROW = "__part", "__row"


def _cells(bases: Sequence[str]) -> Column:
    cells = [F.struct(F.lit(b).alias("basis"), F.col(b).cast("double").alias("value")) for b in bases]
    return F.inline(F.array(*cells))


def value_counts(long: DataFrame, keys: Sequence[str], bases: Sequence[str] = BASES) -> DataFrame:
    """keys, basis, value, n: how often each value occurs; NULL values are left out."""
    values = long.select(*keys, _cells(bases)).where("value IS NOT NULL")
    return values.groupBy(*keys, "basis", "value").agg(F.count("*").alias("n"))


def merged(counts: Iterable[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The sum of several count tables, without the values nothing is left of."""
    every = reduce(DataFrame.unionByName, counts)
    return every.groupBy(*keys, "basis", "value").agg(F.sum("n").alias("n")).where("n <> 0")


def shares(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, basis, value, share: average-tie percentile (0..100) of every value."""
    summed = running_sums(counts, [*keys, "basis"], ["value"], ["n"])
    both_ends = 2 * (F.col("n_upto") - F.col("n")) + F.col("n") + 1
    share = both_ends / F.lit(2.0) / F.col("n_total") * 100.0
    return summed.select(*keys, "basis", "value", share.alias("share"))


class PercentileCounts:
    """Stored counts and percentiles under ``path``, in files of their own per period.

    ``keys`` name a population and its metric, the period (``keys[0]``) first.  A load
    becomes current by one small entry written after its files, so one that dies before
    leaves the tables as they were.  Loads go one after the other; a load that finds its
    number taken fails.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], bases: Sequence[str] = BASES):
        self.spark, self.path, self.keys, self.bases = spark, path, list(keys), list(bases)

    def _part(self) -> Column:
        """The period as a folder name; NULL, empty and odd values stay apart."""
        period = F.col(self.keys[0]).cast("string")
        return F.when(period.isNull(), "none").otherwise(F.concat(F.lit("x"), F.hex(F.encode(period, "UTF-8"))))

    def _entries(self) -> DataFrame | None:
        path = f"{self.path}/state"
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return None
        return self.spark.read.schema("part string, run string, load long").parquet(path)

    def _state(self) -> tuple[int, dict[str, str]]:
        """Number of the last load and the run that wrote each period; a row a period."""
        entries = self._entries()
        if entries is None:
            return 0, {}
        now = entries.groupBy("part").agg(F.max_by("run", "load").alias("run"), F.max("load").alias("load"))
        rows = now.collect()
        return max((r.load for r in rows), default=0), {r.part: r.run for r in rows}

    def _read(self, kind: str, schema: T.StructType, parts: Iterable[str] | None = None) -> DataFrame:
        state = self._state()[1]
        wanted = state if parts is None else {p: state[p] for p in parts if p in state}
        runs: dict[str, list[str]] = {}
        for part, run in wanted.items():
            runs.setdefault(run, []).append(part)
        stored = T.StructType([*schema, T.StructField(_PART, T.StringType())])
        tables = [
            self.spark.read.schema(stored).parquet(f"{self.path}/{kind}/{run}").where(F.col(_PART).isin(own)).drop(_PART)
            for run, own in sorted(runs.items())
        ]
        return reduce(DataFrame.unionByName, tables, self.spark.createDataFrame([], schema))

    def _write(self, kind: str, run: str, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{kind}/{run}"
        df.withColumn(_PART, self._part()).write.partitionBy(_PART).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def load(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> list[str]:
        """Add the rows of ``added``, take off those of ``removed`` (as they were when they
        were added), and return the folders of the periods written.

        Rows taken off that were never added stop the load.  A batch without a value writes
        nothing.
        """
        signed = [
            value_counts(rows, self.keys, self.bases).withColumn("n", F.col("n") * sign)
            for rows, sign in ((added, 1), (removed, -1))
            if rows is not None
        ]
        if not signed:
            return []
        delta = materialise(merged(signed, self.keys), "count-delta")
        parts = sorted(r[0] for r in delta.select(self._part()).distinct().collect())  # one a period
        if not parts:
            return []
        number, run = self._state()[0] + 1, uuid.uuid4().hex
        held = merged([self._read("counts", delta.schema, parts), delta], self.keys)
        sound = F.when(F.col("n") > 0, F.col("n")).otherwise(
            F.raise_error(F.lit("rows taken off that were never added")).cast("long")
        )
        counts = self._write("counts", run, held.withColumn("n", sound))
        self._write("shares", run, shares(counts, self.keys))
        entry = self.spark.createDataFrame([(p, run) for p in parts], "part string, run string")
        entry.coalesce(1).write.mode("error").parquet(f"{self.path}/state/load={number}")
        return parts

    def _schema(self, long: DataFrame, last: str, kind: T.DataType) -> T.StructType:
        of_keys = [long.schema[k] for k in self.keys]
        values = [("basis", T.StringType()), ("value", T.DoubleType()), (last, kind)]
        return T.StructType([*of_keys, *[T.StructField(n, t) for n, t in values]])

    def counts(self, long: DataFrame) -> DataFrame:
        """keys, basis, value, n as they are stored; the keys have the types of ``long``."""
        return self._read("counts", self._schema(long, "n", T.LongType()))

    def ranked(self, long: DataFrame) -> DataFrame:
        """``long`` with ``percentile_<basis>``: each value's place among all that is loaded.

        A NULL value, or one that isn't among those loaded, has none.  Repeated rows answer
        alike, each for itself.
        """
        rows = materialise(long.withColumn(_ROW, F.monotonically_increasing_id()), "ranked-rows")
        asked = rows.select(_ROW, *self.keys, _cells(self.bases)).where("value IS NOT NULL")
        stored = self._read("shares", self._schema(long, "share", T.DoubleType()))
        known = asked.alias("r").join(
            stored.alias("s"), same("r", "s", [*self.keys, "basis"]) & (F.col("r.value") == F.col("s.value"))
        )
        places = known.groupBy(F.col(f"r.{_ROW}").alias(_ROW)).agg(
            *[F.max(F.when(F.col("r.basis") == b, F.col("s.share"))).alias(f"percentile_{b}") for b in self.bases]
        )
        return rows.join(places, _ROW, "left").drop(_ROW)
