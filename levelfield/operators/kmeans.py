"""K-means of many independent groups at once.

Every group (a season's position group, a season's teams) and every restart is a fit of its
own.  Points are written once as blocks of float matrices, each of one group.  A step is one
Spark job over the blocks of the groups that still move: the centroids, a table of the size of
the model, go out with the job, every task measures its blocks against all restarts of their
group by matrix products, and returns only counts, sums and costs per cluster.  A fit that
stands still leaves the loop.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelfield.session import materialise

MAX_STEPS = 300
#: Largest move of a centroid that counts as standing still.
STILL = 1e-9
#: Points of a block.
BLOCK = 4096
#: Rounds of parallel seeding, and points drawn in each for every cluster asked for.
ROUNDS, DRAWS = 4, 2

# Sent with the functions, so that workers need no copy of this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: (group, restart) -> rows of numbers: candidates or centroids.
Model = dict[tuple[int, int], np.ndarray]


def _nearest(columns: Sequence[str]) -> Column:
    """Struct (far, idx): squared distance and number of the closest entry of ``centres``."""

    def far(c: Column) -> Column:
        return sum((F.col(x) - c[x]) * (F.col(x) - c[x]) for x in columns)

    return F.array_min(
        F.transform("centres", lambda c: F.struct(far(c).alias("far"), c["idx"].alias("idx")))
    )


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centres, by one matrix product."""
    found = (points * points).sum(1)[:, None] - 2.0 * (points @ centres.T) + (centres * centres).sum(1)[None, :]
    return np.maximum(found, 0.0, out=found)


def _uniform(marks: np.ndarray, salt: int) -> np.ndarray:
    """A number between 0 and 1 for each mark, another one for each salt."""
    x = marks.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _blocks(points: DataFrame, columns: Sequence[str], width: int) -> DataFrame:
    """grp, marks, points: matrices of up to BLOCK points of one group."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0).to_numpy()
            marks = batch.column(1).to_numpy(zero_copy_only=False)
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]])
            edges = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True])
            rows = [(a, min(a + BLOCK, b)) for start, b in zip(edges, edges[1:]) for a in range(start, b, BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(groups[a]) for a, _ in rows], pa.int32()),
                    pa.array([marks[a:b].astype(np.int64).tobytes() for a, b in rows], pa.binary()),
                    pa.array([values[a:b].astype(np.float64).tobytes() for a, b in rows], pa.binary()),
                ],
                ["grp", "marks", "points"],
            )

    # Sorted in each task only: a group that holds most points stays spread.
    own = points.select("grp", "mark", *[F.col(c).cast("double") for c in columns]).sortWithinPartitions("grp")
    return own.mapInArrow(cut, "grp int, marks binary, points binary")


def _over_blocks(
    blocks: DataFrame, groups: Sequence[int], schema: str, width: int, use: Callable[[int, np.ndarray, np.ndarray], list[tuple]]
) -> DataFrame:
    """Rows that ``use(group, marks, points)`` gives for every block of ``groups``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for group, marks, points in zip(*[c.to_pylist() for c in batch.columns]):
                rows += use(group, np.frombuffer(marks, np.int64), np.frombuffer(points, np.float64).reshape(-1, width))
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names = arrow.names
    return blocks.where(F.col("grp").isin(*groups)).mapInArrow(run, schema)


def _drawn(blocks: DataFrame, model: Model, groups, restarts: int, seed: int, salt: int, n: int, width: int) -> Model:
    """``n`` points of each group and restart, drawn with a weight of their squared distance to
    ``model`` (all alike where that has nothing): the smallest of exponential draws, so every
    block can name its own smallest and the smallest of all of them are the sample."""

    def use(group: int, marks: np.ndarray, points: np.ndarray) -> list[tuple]:
        rows = []
        for restart in range(restarts):
            key = -np.log(_uniform(marks, (seed * 1_000 + restart) * 1_000 + salt))
            known = model.get((group, restart))
            if known is not None:
                weight = squared(points, known).min(1)
                key = np.where(weight > 1e-18, key / np.maximum(weight, 1e-18), np.inf)
            for i in np.lexsort((marks, key))[:n]:
                if np.isfinite(key[i]):
                    rows.append((group, restart, float(key[i]), int(marks[i]), points[i].tolist()))
        return rows

    drawn = _over_blocks(blocks, groups, "grp int, restart int, key double, mark long, at array<double>", width, use)
    first = F.slice(F.array_sort(F.collect_list(F.struct("key", "mark", "at"))), 1, n)
    best = drawn.groupBy("grp", "restart").agg(first.alias("first")).collect()  # n points a fit: the model
    return {(r.grp, r.restart): np.array([f["at"] for f in r["first"]]) for r in best}


def _weights(blocks: DataFrame, model: Model, groups, width: int) -> dict[tuple[int, int], np.ndarray]:
    """How many points each candidate is nearest to."""

    def use(group: int, marks: np.ndarray, points: np.ndarray) -> list[tuple]:
        rows = []
        for (of, restart), known in model.items():
            if of == group:
                counts = np.bincount(squared(points, known).argmin(1), minlength=len(known))
                rows += [(group, restart, int(i), int(counts[i])) for i in np.flatnonzero(counts)]
        return rows

    found = _over_blocks(blocks, groups, "grp int, restart int, idx int, n long", width, use)
    out = {key: np.zeros(len(known)) for key, known in model.items()}
    for r in found.groupBy("grp", "restart", "idx").agg(F.sum("n").alias("n")).collect():
        out[r.grp, r.restart][r.idx] = r.n
    return out


def _spread(candidates: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` of the weighted candidates, each drawn by its distance to those before."""
    chosen = [int(rng.choice(len(candidates), p=weights / weights.sum()))]
    far = squared(candidates, candidates[chosen]).min(1)
    while len(chosen) < k:
        mass = weights * far
        mass[chosen] = 0.0
        if mass.sum() <= 0.0:  # fewer different points than clusters
            mass = np.ones(len(candidates))
            mass[chosen] = 0.0
        if mass.sum() <= 0.0:
            mass = np.ones(len(candidates))
        chosen.append(int(rng.choice(len(candidates), p=mass / mass.sum())))
        far = np.minimum(far, squared(candidates, candidates[chosen[-1:]])[:, 0])
    return candidates[chosen]


def seeds(blocks: DataFrame, groups, k: int, restarts: int, seed: int, width: int) -> Model:
    """Start points of every fit: rounds of draws by distance, all blocks at once, then a
    spread choice among the few drawn by the points each stands for."""
    drawn = _drawn(blocks, {}, groups, restarts, seed, 0, k, width)
    model = {key: at[:1] for key, at in drawn.items()}
    for turn in range(1, ROUNDS + 1):
        more = _drawn(blocks, model, groups, restarts, seed, turn, DRAWS * k, width)
        model = {key: np.vstack([at, more[key]]) if key in more else at for key, at in model.items()}
    model = {key: np.vstack([at, drawn[key]]) if len(at) < k else at for key, at in model.items()}
    weights = _weights(blocks, model, groups, width)
    return {
        (group, restart): _spread(at, weights[group, restart], k, np.random.default_rng([seed, restart]))
        for (group, restart), at in model.items()
    }


def _step(blocks: DataFrame, model: Model, width: int) -> tuple[Model, dict[tuple[int, int], float]]:
    """All fits of ``model`` one step on, and their cost before; an empty cluster stays put."""
    fits: dict[int, list[int]] = {}
    for group, restart in sorted(model):
        fits.setdefault(group, []).append(restart)
    k = len(next(iter(model.values())))
    centres = {group: np.vstack([model[group, r] for r in own]) for group, own in fits.items()}
    names = ["grp", "idx", "n", "cost", *[f"s{j}" for j in range(width)]]
    schema = "grp int, idx int, n long, cost double, " + ", ".join(f"s{j} double" for j in range(width))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # of a group: n, cost and sums of all its centroids
        for batch in batches:
            for group, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                points, at = np.frombuffer(data, np.float64).reshape(-1, width), centres[group]
                far = squared(points, at).reshape(len(points), -1, k)
                near = far.argmin(2)
                cost = np.take_along_axis(far, near[:, :, None], 2)[:, :, 0]
                idx = (near + np.arange(near.shape[1]) * k).ravel()
                total = held.setdefault(group, np.zeros((2 + width, len(at))))
                total[0] += np.bincount(idx, minlength=len(at))
                total[1] += np.bincount(idx, weights=cost.ravel(), minlength=len(at))
                for j in range(width):
                    total[2 + j] += np.bincount(idx, weights=np.repeat(points[:, j], near.shape[1]), minlength=len(at))
        if held:
            sizes = [t.shape[1] for t in held.values()]
            every = np.concatenate(list(held.values()), 1)
            numbers = [np.repeat(np.array(list(held), np.int32), sizes), np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])]
            columns = [*numbers, every[0].astype(np.int64), *every[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    found = blocks.where(F.col("grp").isin(*fits)).select("grp", "points").mapInArrow(run, schema)
    total = found.groupBy("grp", "idx").agg(*[F.sum(c).alias(c) for c in names[2:]]).toArrow()  # a row per centroid: the model
    new = {key: at.copy() for key, at in model.items()}
    costs = dict.fromkeys(model, 0.0)
    rows = [total.column(c).to_pylist() for c in names]
    for group, idx, n, cost, *sums in zip(*rows):
        key = (group, fits[group][idx // k])
        costs[key] += cost
        if n:
            new[key][idx % k] = np.array(sums) / n
    return new, costs


def silhouette(rows: DataFrame, columns, by) -> DataFrame:
    """by, silhouette: mean over the points, on squared distances, from cluster sums.

    NULL where it says nothing: one cluster only, or as many clusters as points.
    """
    norm = sum(F.col(c) * F.col(c) for c in columns)
    table = materialise(
        rows.groupBy(*by, "cluster")
        .agg(F.count("*").alias("n"), F.avg(norm).alias("norm"), *[F.avg(c).alias(c) for c in columns])
        .groupBy(*by)
        .agg(F.collect_list(F.struct("cluster", "n", "norm", *columns)).alias("others")),
        "cluster_sums",
    )

    def mean_distance(c: Column) -> Column:
        return norm - 2 * sum(F.col(x) * c[x] for x in columns) + c["norm"]

    own = F.filter("others", lambda c: c["cluster"] == F.col("cluster"))[0]
    a = F.try_divide(mean_distance(own) * own["n"], own["n"] - 1)
    b = F.array_min(
        F.transform(F.filter("others", lambda c: c["cluster"] != F.col("cluster")), mean_distance)
    )
    value = F.when(own["n"] > 1, F.try_divide(b - a, F.greatest(a, b))).otherwise(F.lit(0.0))
    told = (F.count("*") > F.max(F.size("others"))) & (F.max(F.size("others")) > 1)
    return rows.join(table, list(by)).groupBy(*by).agg(F.when(told, F.avg(value)).alias("silhouette"))


def fit(
    points: DataFrame,
    columns: Sequence[str],
    k: int,
    by: Sequence[str],
    keys: Sequence[str],
    restarts: int,
    seed: int,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Best of ``restarts`` fits per group.

    Returns (``points`` with cluster), (by, cluster, columns: the centroids) and (by,
    silhouette, cost, steps, settled).  Clusters are numbered by their sorted centroids.  A
    fit that still moves after MAX_STEPS is told by ``settled``.  Every group must have at
    least ``k`` rows; rows are told apart by ``keys``.
    """
    columns, by, width = list(columns), list(by), len(columns)
    spark = points.sparkSession
    stored = materialise(points.select(*dict.fromkeys([*by, *keys, *columns])), "points")
    groups = [tuple(r) for r in stored.select(*by).distinct().orderBy(*by).collect()]  # a row a fit
    kinds = ", ".join(f"`{c}` {stored.schema[c].dataType.simpleString()}" for c in by)
    names = spark.createDataFrame([(*g, i) for i, g in enumerate(groups)], f"{kinds}, grp int")
    same = [stored[c].eqNullSafe(names[c]) for c in by]
    marked = stored.join(F.broadcast(names), same).select(
        "grp", F.xxhash64(*[stored[c] for c in keys]).alias("mark"), *[stored[c] for c in columns]
    )
    blocks = materialise(_blocks(marked, columns, width), "point-blocks")
    moving = seeds(blocks, range(len(groups)), k, restarts, seed, width)
    done: Model = {}
    steps = dict.fromkeys(moving, 0)
    costs: dict[tuple[int, int], float] = {}
    settled: dict[tuple[int, int], bool] = {}
    while moving:
        new, cost = _step(blocks, moving, width)
        costs |= cost
        for key, at in new.items():
            steps[key] += 1
            settled[key] = float(np.abs(at - moving[key]).max(initial=0.0)) <= STILL
            if settled[key] or steps[key] >= MAX_STEPS:
                done[key] = at
        moving = {key: at for key, at in new.items() if key not in done}
    listed, quality = [], []
    for i, group in enumerate(groups):
        best = min((key for key in done if key[0] == i), key=lambda key: (costs[key], key))
        quality.append((*group, costs[best], steps[best], settled[best]))
        listed += [(*group, idx, *map(float, at)) for idx, at in enumerate(sorted(map(tuple, done[best])))]
    doubles = ", ".join(f"`{c}` double" for c in columns)
    centres = spark.createDataFrame(listed, f"{kinds}, cluster int, {doubles}")
    told = spark.createDataFrame(quality, f"{kinds}, cost double, steps int, settled boolean")
    model = materialise(
        centres.groupBy(*by).agg(
            F.sort_array(F.collect_list(F.struct(F.col("cluster").alias("idx"), *columns))).alias("centres")
        ),
        "model",
    )
    rows = stored.join(model, by).withColumn("cluster", _nearest(columns)["idx"]).drop("centres")
    assigned = materialise(rows, "assigned")
    return assigned, centres, silhouette(assigned, columns, by).join(told, by)
