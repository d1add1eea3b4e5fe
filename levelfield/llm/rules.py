"""Quality rules: rule statistics of whole texts and an isolation forest over them.

The statistics are made per text inside the map tasks.  Of the labelled rows half grow the
forest and half set its threshold, by a hash of their id and all of them: rows are dealt to
the trees, and a level of all trees is one pass over them.  A text is as odd as its paths
through random splits are short.  The threshold on that oddness comes from the counts of
good and bad rows by score: the best that keeps at least KEEP of the rows labelled good.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levelfield.llm.words import GAP, Words, grams, groups, mix, run_starts
from levelfield.session import materialise

SYMBOLS = b"#*$%&|<>"
#: Trees, the rows a tree has at least (where there are as many), decimals of a score.
TREES, SUBSAMPLE, STEPS = 200, 64, 5
#: Share of the good calibration rows that must stay.
KEEP = 0.995
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: What the forest sees: how far a text is beyond the usual range of each rule.  Inside
#: the range a statistic is constant, so no split is spent on ordinary texts.
FEATURES = ("word_length", "symbols_per_word", "symbol_share", "repeat_share", "dup_line_share")


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_SYMBOL = _class(SYMBOLS)
_LEAD = ~GAP & ((np.arange(256) & 0xC0) != 0x80)  # first byte of a code point in a word


def count_texts(texts: list[bytes], window: int = 5) -> dict[str, np.ndarray]:
    """The counts named in COUNTS, one entry per text."""
    words = Words(texts)

    def total(member: np.ndarray) -> np.ndarray:
        running = np.r_[0, np.cumsum(member[words.data])]
        return running[words.finish] - running[words.begin]

    starts = run_starts(words, window)
    repeated = np.zeros(len(words.start) + 1, np.int64)
    if len(starts):
        owner = words.text_of[starts].astype(np.uint64)
        key = grams(words.hash, window)[starts] ^ mix(owner + np.uint64(1))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = starts[order][np.r_[same, False] | np.r_[False, same]]
        np.add.at(repeated, again, 1)
        np.add.at(repeated, again + window, -1)
    covered = np.r_[0, np.cumsum(np.cumsum(repeated[:-1]) > 0)]
    n_lines, n_dup = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        lines = [line for line in text.split(b"\n") if line.strip()]
        n_lines[i], n_dup[i] = len(lines), len(lines) - len(set(lines))
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": total(_LEAD),
        "n_symbols": total(_SYMBOL),
        "n_dup_lines": n_dup,
        "n_repeat_words": covered[words.first[1:]] - covered[words.first[:-1]],
        "n_lines": n_lines,
    }


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the counts of every whole text; a null text has none of anything."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in groups(batches, "text"):
            found = count_texts(texts)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(found[c]) for c in COUNTS)], ["id", *COUNTS])

    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in COUNTS)]
    )
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(make, schema)


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Rule statistics beyond their usual range, columns as FEATURES.

    Usual are words of 3.7 to 6.7 characters on average (a factor of e^0.3 around 5), no
    symbols, a tenth of the words in repeated windows and three tenths of repeated lines.
    """
    words, chars = np.maximum(counts["n_words"], 1), np.maximum(counts["word_chars"], 1)
    return np.column_stack(
        [
            np.maximum(np.abs(np.log(chars / words / 5)) - 0.3, 0),
            np.minimum(counts["n_symbols"] / words / 0.1, 4),
            counts["n_symbols"] / chars,
            np.maximum(counts["n_repeat_words"] / words - 0.1, 0),
            np.maximum(counts["n_dup_lines"] / np.maximum(counts["n_lines"], 1) - 0.3, 0),
        ]
    ).astype(np.float64)


def base_failed() -> F.Column:
    """Too short, or over a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of a search that ends without success among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), n == 2)


@dataclass
class Forest:
    """Trees in flat arrays; node 0 of each is its root, feature -1 marks a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    norm: float
    threshold: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Oddness in 0..1: two to the minus mean path length over the expected one."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[t, node]
                inner = f >= 0
                if not inner.any():
                    break
                down = np.where(x[rows, np.maximum(f, 0)] < self.cut[t, node], self.left[t, node], self.right[t, node])
                node = np.where(inner, down, node)
            total += self.path[t, node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def _depth(size: float) -> int:
    return int(np.ceil(np.log2(max(size, 2))))


def _grow(measure: Callable[[Forest, int], tuple], size: float, trees: int, depth: int, seed: int) -> Forest:
    """Trees grown level by level; node n parts into 2n + 1 and 2n + 2.

    ``measure`` gives the rows and the least and greatest features of the nodes of a level,
    as arrays over trees and nodes.
    """
    rng = np.random.default_rng(seed)
    width = 2 ** (depth + 1) - 1
    forest = Forest(
        np.full((trees, width), -1), np.zeros((trees, width)),
        np.tile(2 * np.arange(width) + 1, (trees, 1)), np.tile(2 * np.arange(width) + 2, (trees, 1)),
        np.zeros((trees, width)), float(max(_mean_path(max(size, 2)), 1e-9)),
    )
    for level in range(depth + 1):
        first = 2**level - 1
        count, low, high = measure(forest, level)
        forest.path[:, first : first + 2**level] = level + _mean_path(count)
        for t, n in np.argwhere(count > 1) if level < depth else ():
            open_ = np.flatnonzero(high[t, n] > low[t, n])
            if len(open_):
                f = rng.choice(open_)
                forest.feature[t, first + n] = f
                # Above the least value, so that both sides hold a row.
                forest.cut[t, first + n] = max(rng.uniform(low[t, n, f], high[t, n, f]), np.nextafter(low[t, n, f], np.inf))
    return forest


def _tally(forest: Forest, level: int, x: np.ndarray, mine: np.ndarray, held: tuple) -> None:
    """Add the rows ``x``, each in its trees ``mine``, to a level's (count, low, high)."""
    row = np.repeat(np.arange(len(x)), mine.shape[1])
    tree, node = mine.ravel(), np.zeros(mine.size, np.int64)
    for _ in range(level):
        f = forest.feature[tree, node]
        live = f >= 0
        row, tree, node, f = row[live], tree[live], node[live], f[live]
        node = np.where(x[row, f] < forest.cut[tree, node], 2 * node + 1, 2 * node + 2)
    node -= 2**level - 1
    np.add.at(held[0], (tree, node), 1)
    np.minimum.at(held[1], (tree, node), x[row])
    np.maximum.at(held[2], (tree, node), x[row])


def _empty(trees: int, level: int, wide: int) -> tuple:
    shape = (trees, 2**level)
    return np.zeros(shape, np.int64), np.full((*shape, wide), np.inf), np.full((*shape, wide), -np.inf)


def grow(x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 1) -> Forest:
    """An isolation forest over the rows of ``x``; no rows give one that finds nothing odd."""
    rng = np.random.default_rng(seed)
    size = min(subsample, len(x))
    drawn = [rng.choice(len(x), size, replace=False) for _ in range(trees)]

    def measure(forest: Forest, level: int) -> tuple:
        held = _empty(trees, level, x.shape[1])
        for t, rows in enumerate(drawn):
            _tally(forest, level, x[rows], np.full((size, 1), t), held)
        return held

    return _grow(measure, size, trees, _depth(size), seed)


def _counted(batch: pa.RecordBatch) -> np.ndarray:
    return features({c: batch.column(c).to_numpy() for c in COUNTS})


def grow_all(rows: DataFrame, trees: int = TREES, seed: int = 1) -> Forest:
    """An isolation forest over all ``rows`` (mark, COUNTS), a pass over them per level.

    The rows are dealt to the trees by their mark.  Few rows go to several trees each, so that
    a tree has SUBSAMPLE of them; many go to one, and no row is left out.
    """
    spark, total = rows.sparkSession, rows.count()
    copies = int(np.clip(np.ceil(trees * SUBSAMPLE / max(total, 1)), 1, trees))
    size = min(total * copies / trees, total)
    wide = len(FEATURES)

    def measure(forest: Forest, level: int) -> tuple:
        shared = spark.sparkContext.broadcast(forest)

        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = _empty(trees, level, wide)
            for batch in batches:
                mine = (batch.column("mark").to_numpy()[:, None] % trees + np.arange(copies)) % trees
                _tally(shared.value, level, _counted(batch), mine, held)
            tree, node = np.nonzero(held[0])
            ends = [held[k][tree, node][:, f] for k in (1, 2) for f in range(wide)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree), pa.array(node), pa.array(held[0][tree, node]), *map(pa.array, ends)],
                ["tree", "node", "n", *lows, *highs],
            )

        lows, highs = [f"low{f}" for f in range(wide)], [f"high{f}" for f in range(wide)]
        schema = "tree long, node long, n long, " + ", ".join(f"{c} double" for c in lows + highs)
        parts = rows.select("mark", *COUNTS).mapInArrow(add, schema).groupBy("tree", "node")
        found = parts.agg(
            F.sum("n").alias("n"), *[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs]
        ).toPandas()  # at most a row for each node of the level
        held = _empty(trees, level, wide)
        at = (found["tree"].to_numpy(np.int64), found["node"].to_numpy(np.int64))
        held[0][at], held[1][at], held[2][at] = found["n"], found[lows].to_numpy(), found[highs].to_numpy()
        return held

    return _grow(measure, size, trees, _depth(min(size, SUBSAMPLE)), seed)


def cut(score: np.ndarray, good: np.ndarray, bad: np.ndarray, keep: float = KEEP) -> float:
    """The threshold of all calibration rows, given as counts of good and bad rows by score.

    The highest share of right verdicts among those that keep at least ``keep`` of the good
    rows; without a good and a bad row to calibrate on nothing is rejected.
    """
    if not good.sum() or not bad.sum():
        return 1.0
    order = np.argsort(score)
    score, kept, caught = score[order], np.cumsum(good[order]), bad.sum() - np.cumsum(bad[order])
    enough = kept >= keep * kept[-1]
    return float(score[enough][int(np.argmax((kept + caught)[enough]))])


def scored(rows: DataFrame, forest: Forest) -> DataFrame:
    """``rows`` with their oddness, to STEPS decimals."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.round(shared.value.score(_counted(batch)), STEPS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(judge, schema)


def quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """One row per input row: id, the counts, base_failed, score, kept.

    ``labels`` has the id and ``label_col`` (1 good, 0 bad); null labels and ids are left
    out, of repeated ids the lowest label counts.  A null or empty text has zero words and
    fails the base rules.  Repeated rows answer alike.  Without usable labels only the
    base rules reject.  An empty table gives no rows; further columns are ignored.
    """
    counted = materialise(statistics(docs, id_col, text_col), "rules")
    marks = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).cast("int").alias("good"))
    )
    mark = F.shiftrightunsigned(F.xxhash64("id"), 1)
    known = materialise(
        counted.where(~base_failed()).join(marks, "id").withColumns({"mark": F.shiftright(mark, 1), "half": mark % 2}), "labelled"
    )
    forest = grow_all(known.where("half = 0"))
    held = scored(known.where("half = 1"), forest).groupBy("score").agg(
        F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")
    ).toPandas()  # at most 10 ** STEPS scores
    forest.threshold = cut(*(held[c].to_numpy(float) for c in ("score", "good", "bad")))
    return scored(counted, forest).withColumn("base_failed", base_failed()).select(
        F.col("id").alias(id_col),
        *COUNTS[:5],
        "base_failed",
        (~F.col("base_failed") & (F.col("score") <= forest.threshold)).alias("kept"),
        "score",
        *COUNTS[5:],
    )
