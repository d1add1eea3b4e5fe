"""The nearest profiles of every entity at once, exactly.

Equal profiles of a group (a season's position group or role) are one class: its members have
the same neighbours but for themselves, and of a class only its first n + 1 members by key can
be among the n nearest of anybody.  Classes become rows of float matrices, cut into blocks of
classes that lie close together, each with the box that holds them; up to CELL blocks in a row
are a cell.  The blocks of a cell are first searched among themselves, which bounds how far
their neighbours can be; the cell then only meets the blocks of its group whose boxes come
within that bound, nearest box first, and of a block only those classes take part that the
other box can still reach.  A pair of classes costs a share of a matrix product and never
becomes a row; a large group is spread over its cells.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levelfield import catalog
from levelfield.catalog import KEYS
from levelfield.session import materialise

#: Classes of a block.
BLOCK = 1024
#: Blocks of a cell, to which another block is sent once.
CELL = 16
#: Distances that agree to so many decimals are ties, which the keys decide.
DECIMALS = 9
#: Beyond the error of a squared distance by matrix product, and of the decimals.
SLACK = 1e-5

# Sent with the functions, so that workers need no copy of this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def boxes(vectors: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Row numbers of ``vectors``, halved along their widest axis until ``size`` or fewer are left."""
    todo = [np.arange(len(vectors))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            yield np.sort(rows)
            continue
        own = np.where(np.isnan(vectors[rows]), -100.0, vectors[rows])  # profiles that lack an axis keep together
        axis = int(np.argmax(own.max(0) - own.min(0)))
        order = rows[np.argsort(own[:, axis], kind="stable")]
        todo += [order[len(order) // 2 :], order[: len(order) // 2]]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` and ``b`` by one matrix product, to within SLACK;
    an axis that either lacks (NaN) adds nothing."""
    ma, mb = ~np.isnan(a), ~np.isnan(b)
    a, b = np.where(ma, a, 0.0), np.where(mb, b, 0.0)
    return np.hstack([a * a, ma, -2.0 * a]) @ np.hstack([mb, b * b, b]).T


def to_box(vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least distance of each row to anything in the box."""
    gap = np.nan_to_num(np.maximum(np.maximum(low - vectors, vectors - high), 0.0), copy=False, nan=0.0)
    return np.sqrt((gap * gap).sum(1))


def box_of(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest values; an axis that any row lacks has no bounds."""
    whole = ~np.isnan(vectors).any(0)
    return np.where(whole, vectors.min(0), -np.inf), np.where(whole, vectors.max(0), np.inf)


class Nearest:
    """The ``n`` nearest candidates so far of each class of a block, ties by id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, n: int):
        self.own, self.vectors, self.n = ids, vectors, n
        self.low, self.high = box_of(vectors) if len(ids) else (None, None)
        self.far = np.full((len(ids), n), np.inf)
        self.ids = np.full((len(ids), n), np.iinfo(np.int64).max)

    def limit(self) -> float:
        """No candidate further than this can get in anywhere."""
        return float(self.far[:, -1].max()) if len(self.far) else -np.inf

    def meet(self, ids: np.ndarray, counts: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """``ids``: the first members of each class of a block, ``counts`` of them each."""
        near = np.flatnonzero(to_box(self.vectors, low, high) <= self.far[:, -1] + SLACK)
        starts = np.cumsum(counts) - counts
        other = np.flatnonzero(counts)
        if len(near) and len(other):
            reach = to_box(vectors[other], *box_of(self.vectors[near]))
            other = other[reach <= self.far[near, -1].max() + SLACK]
        if not len(near) or not len(other):
            return
        a, b = self.vectors[near], vectors[other]
        close = products(a, b)
        worst = self.far[near, -1] ** 2
        free = np.flatnonzero(np.isinf(worst))
        if len(free) and len(other) > self.n:
            worst[free] = np.partition(close[free], self.n - 1, axis=1)[:, self.n - 1]
        row, at = np.nonzero(close <= worst[:, None] + SLACK)
        if not len(row):
            return
        far = np.zeros(len(row))
        for k in range(a.shape[1]):
            gap = a[row, k] - b[at, k]
            far += np.nan_to_num(gap * gap, copy=False, nan=0.0)
        far = np.round(np.sqrt(far), DECIMALS)
        # Every class stands for its first members.
        size, first = counts[other][at], starts[other][at]
        member = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        touched, row = np.unique(row, return_inverse=True)
        touched = near[touched]
        held, place = np.nonzero(np.isfinite(self.far[touched]))
        rows = np.r_[np.repeat(row, size), held]
        fars = np.r_[np.repeat(far, size), self.far[touched][held, place]]
        found = np.r_[ids[member], self.ids[touched][held, place]]
        order = np.lexsort((found, fars, rows))
        rows, fars, found = rows[order], fars[order], found[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = nth < self.n
        self.far[touched], self.ids[touched] = np.inf, np.iinfo(np.int64).max
        self.far[touched[rows[keep]], nth[keep]] = fars[keep]
        self.ids[touched[rows[keep]], nth[keep]] = found[keep]


def _blocks(classes: DataFrame, axes: int) -> DataFrame:
    """g, cell, block, low, high, ids, counts, members, vectors: the blocks of every group.

    Rows are dealt to ranges of the group and the mean percentile, and cut inside a task.
    ``low`` and ``high`` are the box; an axis that any profile lacks has no bounds.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            if not held:
                return
            table = pa.Table.from_batches(held)
            ids = table.column(1).to_numpy()
            lists = table.column(2).combine_chunks()
            counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            members, starts = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(counts) - counts
            flat = table.column(3).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            vectors = flat.reshape(len(ids), axes)
            for place, rows in enumerate(boxes(vectors, BLOCK)):
                cell = number if place % CELL == 0 else cell
                own, size = vectors[rows], counts[rows]
                low, high = box_of(own)
                first = np.repeat(starts[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                data = (ids[rows], size, members[first], own)
                columns = [[now], [cell], [number], [low], [high], *[[d.tobytes()] for d in data]]
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
            held.clear()

        bounds = pa.list_(pa.float64())
        types = [pa.string(), pa.int64(), pa.int64(), bounds, bounds, *[pa.binary()] * 4]
        names = ["g", "cell", "block", "low", "high", "ids", "counts", "members", "vectors"]
        for batch in batches:
            groups = batch.column(0).to_pylist()
            at = 0
            for i, name in enumerate(groups):
                if name != now:
                    if i > at:
                        held.append(batch.slice(at, i - at))
                    yield from flush()
                    now, at = name, i
            if at < len(groups):
                held.append(batch.slice(at))
        yield from flush()

    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = F.filter("vector", lambda v: ~F.isnan(v))
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, x: s + x), F.size(known))
    rows = classes.select("g", "cid", "members", "vector", mean.alias("mean"))
    dealt = rows.repartitionByRange(parts, "g", "mean", "cid").sortWithinPartitions("g")
    schema = (
        "g string, cell long, block long, low array<double>, high array<double>, "
        "ids binary, counts binary, members binary, vectors binary"
    )
    return dealt.drop("mean").mapInArrow(cut, schema)


_TASK = ("cell", "kind", "bound", "block", "low", "high", "ids", "counts", "members", "vectors")


def _searched(tasks: DataFrame, n: int, axes: int, summary: bool) -> DataFrame:
    """``tasks``: _TASK in order of cell, kind and bound; the rows of kind 0 are the blocks of
    the cell itself, those of kind 1 the blocks it meets.

    With ``summary`` block and limit, else cid, place, neighbour, distance.
    """
    least = catalog.MIN_SHARED_AXES

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, within = None, False
        own: list[tuple[int, Nearest, tuple]] = []  # of a cell: block, what it has found, its content

        def among() -> None:
            """The blocks of the cell meet, each itself first."""
            for turn in range(len(own)):
                for i, (_, near, _) in enumerate(own):
                    reach(near, own[(i + turn) % len(own)][2])

        def reach(near: Nearest, content: tuple) -> None:
            if len(near.own):
                gap = np.maximum(np.maximum(content[3] - near.high, near.low - content[4]), 0.0)
                if np.sqrt((gap * gap).sum()) <= near.limit() + SLACK:
                    near.meet(*content)

        def answer(block: int, near: Nearest) -> pa.RecordBatch:
            if summary:
                return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([near.limit()])], ["block", "limit"])
            row, place = np.nonzero(np.isfinite(near.far))
            columns = [near.own[row], (place + 1).astype(np.int32), near.ids[row, place], near.far[row, place]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cid", "place", "neighbour", "distance"])

        for batch in batches:
            for at, kind, _, block, low, high, ids, counts, members, vectors in zip(*[c.to_pylist() for c in batch.columns]):
                if at != cell or kind and not within:
                    if own and not within:
                        among()
                    within = bool(kind)
                if at != cell:
                    for b, near, _ in own:
                        yield answer(b, near)
                    own, cell = [], at
                ids, counts, members = (np.frombuffer(d, np.int64) for d in (ids, counts, members))
                vectors = np.frombuffer(vectors, np.float64).reshape(-1, axes)
                content = (members, counts, vectors, np.array(low), np.array(high))
                if kind == 0:
                    targets = (~np.isnan(vectors)).sum(1) >= least
                    own.append((block, Nearest(ids[targets], vectors[targets], n), content))
                else:
                    for _, near, _ in own:
                        reach(near, content)
        if own and not within:
            among()
        for b, near, _ in own:
            yield answer(b, near)

    out = "block long, limit double" if summary else "cid long, place int, neighbour long, distance double"
    return tasks.select(*_TASK).mapInArrow(run, out)


def _between(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    """The least distance of two boxes."""
    gap = F.zip_with(low, other_high, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    back = F.zip_with(other_low, high, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    apart = F.zip_with(gap, back, lambda a, b: F.greatest(a, b))
    return F.sqrt(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x))


def all_neighbours(
    percentiles: DataFrame,
    metrics: Sequence[str],
    basis: str = "per90",
    n: int = catalog.DEFAULT_NEIGHBOURS,
    min_minutes: int = 0,
    population: str = "position_group",
) -> DataFrame:
    """The ``n`` neighbours of every entity in its own season and ``population``.

    KEYS, place, near_league, near_team, near_player, near_minutes, distance and similarity, by
    the rules of ``similarity.nearest_profiles``: the axes are those the entity has, an axis
    the neighbour lacks adds no distance, an entity with too few axes or no population has no
    neighbours, ``min_minutes`` holds for neighbours.  Distances equal to nine decimals are
    ties and go by KEYS.  Repeated rows of an entity and metric count as one.
    """
    metrics = list(dict.fromkeys(metrics))
    percentile = F.col(f"percentile_{basis}")
    group = ["season", population]
    wide = (
        percentiles.where(F.col("metric").isin(*metrics) & F.col(population).isNotNull())
        .groupBy(*KEYS, population)
        .agg(
            F.max("minutes").cast("bigint").alias("minutes"),
            *[F.max(F.when(F.col("metric") == m, percentile)).alias(f"axis{k}") for k, m in enumerate(metrics)],
        )
    )
    axes = [F.col(f"axis{k}") for k in range(len(metrics))]
    known = sum(F.when(a.isNotNull(), 1).otherwise(0) for a in axes)
    parts = int(percentiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Numbered in order of the keys, so a tie of numbers is a tie of keys.
    in_order = wide.repartitionByRange(parts, *KEYS, population).sortWithinPartitions(*KEYS, population)
    profiles = materialise(
        in_order.select(
            F.monotonically_increasing_id().alias("rid"),
            *KEYS,
            population,
            "minutes",
            known.alias("axes"),
            (F.coalesce("minutes", F.lit(0)) >= min_minutes).alias("able"),
            F.concat_ws("\x01", *group).alias("g"),
            F.array(*[F.coalesce(a, F.lit(float("nan"))) for a in axes]).alias("vector"),
        ),
        "profiles",
    )
    # One more than asked for, as a member is no neighbour of itself.
    most = n + 1
    first = Window.partitionBy("g", "vector").orderBy(F.desc("able"), "rid")
    classes = materialise(
        profiles.select("g", "vector", "rid", "able")
        .withColumn("nth", F.row_number().over(first))
        .where(F.col("nth") <= most)
        .groupBy("g", "vector")
        .agg(F.min("rid").alias("cid"), F.collect_list(F.when(F.col("able"), F.col("rid"))).alias("members")),
        "classes",
    )
    blocks = materialise(_blocks(classes, len(metrics)), "blocks")
    alone = blocks.withColumns({"kind": F.lit(0), "bound": F.lit(0.0)})

    def dealt(tasks: DataFrame) -> DataFrame:
        return tasks.select(*_TASK).repartition(parts, "cell").sortWithinPartitions("cell", "kind", "bound")

    limits = materialise(_searched(dealt(alone), most, len(metrics), summary=True), "limits")
    box = blocks.select("g", "cell", "block", "low", "high").join(limits, "block")
    other = blocks.select("g", *[F.col(c).alias(f"other_{c}") for c in ("cell", "block", "low", "high")])
    bound = _between(F.col("low"), F.col("high"), F.col("other_low"), F.col("other_high"))
    # Boxes of one group only, and of those the ones near enough; a block comes to a cell once.
    meets = (
        box.join(other, "g")
        .where(F.col("cell") != F.col("other_cell"))
        .select("cell", "other_block", "limit", bound.alias("bound"))
        .where(F.col("bound") <= F.col("limit") + SLACK)
        .groupBy("cell", "other_block")
        .agg(F.min("bound").alias("bound"))
    )
    met = materialise(meets, "meetings")
    content = blocks.drop("g", "cell").withColumn("other_block", F.col("block"))
    others = met.join(content, "other_block").withColumn("kind", F.lit(1)).select(*_TASK)
    tasks = alone.select(*_TASK).unionByName(others)
    found = materialise(_searched(dealt(tasks), most, len(metrics), summary=False), "neighbours")
    near = profiles.select(
        F.col("rid").alias("neighbour"), *[F.col(c).alias(f"near_{c}") for c in ("league", "team", "player", "minutes")]
    )
    told = ("neighbour", "near_league", "near_team", "near_player", "near_minutes", "distance")
    listed = (
        found.join(near, "neighbour")
        .groupBy("cid")
        .agg(F.array_sort(F.collect_list(F.struct("place", *told))).alias("list"))
        .join(classes.select("cid", "g", "vector"), "cid")
        .select("g", "vector", "list")
    )
    others_of = F.slice(F.filter("list", lambda x: x["neighbour"] != F.col("rid")), 1, n)
    worst = 100.0 * F.sqrt("axes")
    return (
        profiles.join(listed, ["g", "vector"])
        .select(*KEYS, population, "axes", F.posexplode(others_of).alias("at", "x"))
        .select(
            *KEYS,
            population,
            (F.col("at") + 1).cast("int").alias("place"),
            *[F.col(f"x.{c}").alias(c) for c in told[1:]],
            F.round((1.0 - F.col("x.distance") / worst) * 100.0, 1).alias("similarity"),
        )
    )
