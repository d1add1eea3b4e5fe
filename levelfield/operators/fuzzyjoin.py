"""Similarity join of texts inside blocks, without a list of all pairs.

For two texts whose longest common subsequence has n of their letters, the letters of either
that the other has as well are at least n, and the pairs of neighbouring letters (with a blank
in front and behind) that both have are at least 3n - a - b + 1 for texts of a and b letters:
every letter left out on either side parts at most one pair of neighbours.  Both counts do not
change when words trade places, so the filter holds for word-sorted and word-set ratios alike.

A block is dealt into cells of a part of either side, so a block of any size is spread over
tasks.  A cell counts what its texts have in common by two matrix products; only pairs that
pass become rows, and where a score is asked for they are scored on the spot.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelfield.session import grown, materialise

#: Texts of one side in a cell, and of a task's matrices at a time.
CELL, HELD = 1024, 4096

# Sent with the functions, so that workers need no copy of this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def numbered(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two 0/1 matrices of the texts' letters and neighbouring letters.

    A column stands for the k-th time of a letter (or pair), so a product of rows counts what
    two texts have in common, repeats included.
    """

    def matrix(row: np.ndarray, code: np.ndarray) -> np.ndarray:
        order = np.lexsort((code, row))
        row, code = row[order], code[order]
        new = np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])] if len(row) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        time = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        _, column = np.unique(np.stack([code, time]), axis=1, return_inverse=True) if len(row) else (None, code)
        column = np.asarray(column).ravel()
        out = np.zeros((len(names), int(column.max(initial=-1)) + 1), np.float32)
        out[row, column] = 1.0
        return out

    points = [np.frombuffer(f" {name} ".encode("utf-32-le"), np.uint32).astype(np.int64) for name in names]
    sizes = np.array([len(p) for p in points])
    flat = np.concatenate(points) if points else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(names)), sizes)
    same = of[1:] == of[:-1]
    inner = np.ones(len(flat), bool)
    ends = np.cumsum(sizes)
    inner[ends - 1] = inner[ends - sizes] = False
    return matrix(of[inner], flat[inner]), matrix(of[1:][same], (flat[:-1] << 21 | flat[1:])[same])


def common_length(one: str, two: str) -> int:
    """Length of the longest common subsequence, one bit per letter of ``one``."""
    places: dict[str, int] = {}
    for i, char in enumerate(one):
        places[char] = places.get(char, 0) | 1 << i
    everything = (1 << len(one)) - 1
    bits = everything
    for char in two:
        hit = bits & places.get(char, 0)
        bits = (bits + hit) | (bits - hit)
    return len(one) - (bits & everything).bit_count()


def _passing(letters, pairs, sizes, left: slice, right: slice, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in the cell of the pairs of texts that may share ``share`` of their letters."""
    total = sizes[left][:, None] + sizes[right][None, :]
    need = np.ceil(total * share - 1e-9)
    ok = letters[left] @ letters[right].T >= need
    ok &= pairs[left] @ pairs[right].T >= 3 * need - total + 1
    return np.nonzero(ok)


def close_pairs(left: DataFrame, right: DataFrame, threshold: float, score: bool = True) -> DataFrame:
    """block, left_name, right_name of two sides' (block, name) within a block.

    With ``score`` the pairs of an Indel ratio (200 x common length / both lengths; 100 for two
    empty texts) of at least ``threshold``, and the score.  Without, all pairs that can reach it
    in any order of their words, and some others.  The rows of either side must be distinct
    and free of NULL.
    """
    share = threshold / 200.0
    schema = "block string, left_name string, right_name string" + ", score double" * score

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        cells: list[list[int]] = []  # start, start of the right side, end
        blocks: list[str] = []
        now = None

        def told() -> Iterator[pa.RecordBatch]:
            if not names:
                return
            letters, pairs = numbered(names)
            sizes = np.array([len(n) for n in names], np.float32)
            for block, (at, mid, end) in zip(blocks, cells):
                rows, columns = _passing(letters, pairs, sizes, slice(at, mid), slice(mid, end), share)
                found = [(names[at + i], names[mid + j]) for i, j in zip(rows.tolist(), columns.tolist())]
                if score:
                    kept = []
                    for one, two in found:
                        total = len(one) + len(two)
                        value = 200.0 * common_length(one, two) / total if total else 100.0
                        if value >= threshold:
                            kept.append((one, two, value))
                    found = kept
                if found:
                    columns_ = [pa.array([block] * len(found)), *map(pa.array, zip(*found))]
                    yield pa.RecordBatch.from_arrays(columns_, ["block", "left_name", "right_name", "score"][: 3 + score])

        for batch in batches:
            for block, cell, other, side, name in zip(*[c.to_pylist() for c in batch.columns]):
                key = (block, cell, other)
                if key != now:
                    if len(names) >= HELD:
                        yield from told()
                        names, cells, blocks = [], [], []
                    now = key
                    cells.append([len(names), len(names), len(names)])
                    blocks.append(block)
                names.append(name)
                cells[-1][2] += 1
                cells[-1][1] += side == 0
        yield from told()

    def parts(df: DataFrame, side: str) -> DataFrame:
        count = F.ceil(F.count("*") / F.lit(CELL)).cast("int")
        return df.groupBy("block").agg(count.alias(side))

    # Blocks that both sides have, and into how many parts either side goes.
    sizes = materialise(parts(left, "lefts").join(grown(parts(right, "rights")), "block"), "block-sizes")

    def dealt(df: DataFrame, name: str, own: str, others: str, side: int) -> DataFrame:
        part = F.pmod(F.xxhash64(name), F.col(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        cells = df.join(grown(sizes), "block").select("block", part.alias("mine"), every.alias("theirs"), F.col(name).alias("name"))
        first, second = ("mine", "theirs") if side == 0 else ("theirs", "mine")
        return cells.select("block", F.col(first).alias("cell"), F.col(second).alias("other"), F.lit(side).alias("side"), "name")

    rows = dealt(left, "left_name", "lefts", "rights", 0).unionByName(dealt(right, "right_name", "rights", "lefts", 1))
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartition(tasks, "block", "cell", "other").sortWithinPartitions("block", "cell", "other", "side")
    return spread.mapInArrow(run, schema)
