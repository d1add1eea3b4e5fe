"""SimHash near-duplicates by pivot distance tables.

Fingerprints are made per text inside the map tasks.  Only distinct fingerprints are
compared.  Two of them at most 3 bits apart agree in at least two of five bit blocks, so
each is filed under ten keys (two blocks each); the members of a key are a small table
of Hamming distances to the pivots.  By the triangle inequality the distances of two
linked fingerprints to any pivot differ by at most 3: rows are sorted by the first pivot
distance and walked in a band, pairs whose largest coordinate difference exceeds 3 are
discarded, the rest verified on the 64 bits.  Of the verified links of a key only a
spanning forest leaves the task, so a dense group costs rows in proportion to its size.
Components are merged by alternating stars on the forest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levelfield.llm.components import components
from levelfield.llm.words import GAP, groups

SEED = 42
RADIUS = 3
BLOCKS = (13, 13, 13, 13, 12)
#: Reference fingerprints: fixed, spread numbers.
PIVOTS = np.random.default_rng(20).integers(0, 1 << 64, 16, dtype=np.uint64)
#: Members of a key beyond which the key is split further by the blocks it leaves free.
SPLIT = 4096

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of the ``shingle``-word runs of a text, repeats included.

    A-Z are lower-cased; words are split at 0x20 and 0x09-0x0D and joined by one blank;
    a text with fewer words is one run; no word: 0.  A bit is set if it is set in over
    half of the XXH64 (seed 42) values.
    """
    line = b" ".join(text.translate(_LOWER).split())
    if not line:
        return 0
    gaps = np.flatnonzero(GAP[np.frombuffer(line, np.uint8)])
    if len(gaps) + 1 <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    starts = np.r_[0, gaps[: len(gaps) - shingle + 2] + 1].tolist()
    ends = np.r_[gaps[shingle - 1 :], len(line)].tolist()
    digest = xxhash.xxh64_intdigest
    n = len(ends)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # a very long text is counted in parts
        values = np.array([digest(line[s:e], SEED) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])], ">u8")
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id, fp (the 64 bits as a signed long), one row per input row."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in groups(batches, "text"):
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fp)], ["id", "fp"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(make, schema)


def _blocks() -> list[tuple[int, int]]:
    """(shift, width) of each bit block."""
    shift, out = 0, []
    for width in BLOCKS:
        out.append((shift, width))
        shift += width
    return out


def _linked_pairs(fp: np.ndarray, run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs (i, j) of one run, lag by lag.  ``run`` numbers the runs, ascending.

    Inside a run rows are walked in the order of the first pivot distance; a lag at which
    no pair is within RADIUS of it ends the walk, because larger lags only move apart.
    """
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], run))
    fp, run, table = fp[order], run[order], table[order]
    live = np.arange(len(fp))
    lag = 1
    while True:
        live = live[live + lag < len(fp)]
        live = live[run[live] == run[live + lag]]
        live = live[table[live + lag, 0] - table[live, 0] <= RADIUS]
        if not len(live):
            return
        left = live
        for p in range(1, table.shape[1]):
            left = left[np.abs(table[left, p] - table[left + lag, p]) <= RADIUS]
        left = left[np.bitwise_count(fp[left] ^ fp[left + lag]) <= RADIUS]
        if len(left):
            yield order[left], order[left + lag]
        lag += 1


def _forest(fp: np.ndarray, run: np.ndarray, free: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links (i, j) that join whatever the verified pairs of each run join.

    A run of over SPLIT rows is split: within it the differing bits lie in the ``free``
    blocks, and of four parts of these one is equal in every linked pair.
    """
    head = np.arange(len(fp))

    def root(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    links: list[tuple[int, int]] = []

    def join(pairs: Iterable[tuple[np.ndarray, np.ndarray]], back: np.ndarray | None = None) -> None:
        for a, b in pairs:
            if back is not None:
                a, b = back[a], back[b]
            for i, j in zip(a.tolist(), b.tolist()):
                x, y = root(i), root(j)
                if x != y:
                    head[max(x, y)] = min(x, y)
                    links.append((i, j))

    size = np.bincount(run)
    large = size[run] > SPLIT
    small = np.flatnonzero(~large)
    if len(small):
        join(_linked_pairs(fp[small], run[small]), small)
    rest = np.flatnonzero(large)
    if len(rest):
        bits = [np.uint64(s + k) for s, w in free for k in range(w)]
        quarters = [bits[q::4] for q in range(4)]
        for quarter in quarters:
            key = run[rest].astype(np.uint64)
            for bit in quarter:
                key = key * np.uint64(2) + ((fp[rest] >> bit) & np.uint64(1))
            _, sub = np.unique(key, return_inverse=True)
            order = np.argsort(sub, kind="stable")
            join(_linked_pairs(fp[rest][order], sub[order]), rest[order])
    return links


def links(distinct: DataFrame) -> DataFrame:
    """u < v: links between distinct fingerprints (column fp) that span their components.

    Every pair at most RADIUS bits apart is joined, directly or through others.
    """
    blocks = _blocks()
    bits = lambda b: F.shiftrightunsigned("fp", b[0]).bitwiseAND(F.lit((1 << b[1]) - 1))
    pairs = list(combinations(range(len(blocks)), 2))
    keys = F.array(
        *[
            (F.shiftleft(bits(blocks[a]), 17) + bits(blocks[b])) * F.lit(16) + F.lit(k)
            for k, (a, b) in enumerate(pairs)
        ]
    )
    filed = distinct.select("fp", F.explode(keys).alias("key"))
    free = [[blocks[c] for c in range(len(blocks)) if c not in pair] for pair in pairs]

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def settle(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            same = keys[1:] == keys[:-1]
            many = np.r_[same, False] | np.r_[False, same]
            keys, fps = keys[many], fps[many]
            for k in np.unique(keys & 15).tolist():
                mine = (keys & 15) == k
                part, fp = keys[mine], fps[mine]
                run = np.r_[0, np.cumsum(part[1:] != part[:-1])]
                found = _forest(fp, run, free[k])
                if found:
                    ends = fp.view(np.int64)[np.array(found)]
                    yield pa.RecordBatch.from_arrays([pa.array(ends.min(1)), pa.array(ends.max(1))], ["u", "v"])

        for batch in batches:
            keys = np.r_[held_k, batch.column(0).to_numpy()]
            fps = np.r_[held_f, batch.column(1).to_numpy().view(np.uint64)]
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            yield from settle(keys[:cut], fps[:cut])
            held_k, held_f = keys[cut:], fps[cut:]
        if len(held_k):
            yield from settle(held_k, held_f)

    return (
        filed.select("key", "fp")
        .repartition("key")
        .sortWithinPartitions("key", "fp")
        .mapInArrow(walk, "u long, v long")
        .distinct()
    )


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of at most 3 differing bits,
    the own one included.  A null or empty text has fingerprint zero and links like any
    other.  A null id keeps its row and never names a component unless all ids of it are
    null.  Repeated rows answer alike; an empty table gives no rows; further columns are
    ignored.
    """
    from levelfield.session import materialise

    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("low"))
    joined = components(links(distinct.select("fp")))
    classes = distinct.join(joined, distinct["fp"] == joined["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    named = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    of_print = classes.join(named, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
