"""Which filters remove what, alone and in any order; duplicates by radix tries of whole texts.

Every map task inserts its texts into a compressed trie whose terminals hold the smallest id,
so a copy with a smaller one in its own task is known at once and its text never travels.  The
texts left over are range-partitioned by prefixes that lengthen where many texts share them,
inserted into one trie per prefix, and traversed: who is not the smallest id of a terminal is a
copy.  A text whose very copies are many is first reduced in salted groups.  From there on a
document is a mask of failed filters, and only counts of masks move.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from levelfield.llm.words import groups
from levelfield.session import materialise

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Bytes of text a map task holds in its trie before it is emptied.
TRIE_BYTES = 48 << 20
#: Characters of the first prefix; each longer one has so many times as many.
PREFIX, LONGER = 8, 4
#: Bytes of text that may share a prefix: a part of what a partition gets, and never more
#: than what a task can hold.
PARTS, MOST_BYTES = 4, 64 << 20
#: A text with very many copies is reduced in so many salted groups first.
SALTS = 32

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_NOT_UPPER = bytes(b for b in range(256) if b not in _UPPER)
_FOLLOWING = bytes(range(0x80, 0xC0))
_SYMBOL = re.compile(rb"[#$%&*|]")


def failures(text: bytes) -> int:
    """The filters A to D a text fails, as bits; the fifth needs the whole table."""
    words = text.split()
    points = len(text) - (0 if text.isascii() else len(text) - len(text.translate(None, _FOLLOWING)))
    return (
        (len(words) < 50)
        | (100 * len(set(words)) < 65 * len(words)) << 1
        | (100 * len(text.translate(None, _NOT_UPPER)) > 5 * points) << 2
        | (_SYMBOL.search(text) is not None) << 3
    )


def _shared(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class RadixTrie:
    """Whole texts in a compressed trie.

    A node is [edge label, children by first byte, terminal]; a terminal is a value that
    ``insert`` hands out, the same for equal texts.
    """

    def __init__(self):
        self.root = [b"", {}, None]
        self.terminals = 0

    def _terminal(self, node: list) -> int:
        if node[2] is None:
            node[2] = self.terminals
            self.terminals += 1
        return node[2]

    def insert(self, text: bytes) -> int:
        """The number of the terminal of ``text``, which is put in where it is missing."""
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                child = node[1][text[at]] = [text[at:], {}, None]
                return self._terminal(child)
            label = child[0]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = _shared(label, text[at : at + len(label)])
            upper = [label[:n], {label[n]: child}, None]
            child[0] = label[n:]
            node[1][text[at]] = upper
            node, at = upper, at + n
        return self._terminal(node)


#: What the tries give: a row that is answered has no text; flush numbers a map task's tries.
_ROWS = "part string, id {id}, mask int, n long, text binary, size int, flush long"


def _schema(id_type: T.DataType) -> T.StructType:
    return T.StructType.fromDDL(_ROWS.format(id=id_type.simpleString()))


def _later(a, b) -> bool:
    """Whether id ``a`` comes after ``b``; null after all."""
    return b is not None and (a is None or a > b)


class _Reduction:
    """A trie over rows of (parts, id, mask, n, text) and what is known when it is emptied."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.trie, self.least, self.texts, self.rows, self.bytes = RadixTrie(), [], [], [], 0

    def add(self, part, id_, mask: int, n: int, text: bytes) -> None:
        k = self.trie.insert(text)
        if k == len(self.least):
            self.least.append(id_)
            self.bytes += len(text)
        elif _later(self.least[k], id_):
            self.least[k] = id_
        self.rows.append((k, part, id_, mask, n))
        self.bytes += 100
        if k == len(self.texts):
            self.texts.append(text)  # a copy's own text is let go

    def settle(self) -> tuple[list[tuple], list[tuple]]:
        """(part, id, mask, n) of the rows with a smaller id in the trie, and (part, id, mask,
        n, text) of the others; rows that are alike are counted together."""
        copies: dict[tuple, int] = {}
        left: dict[tuple, int] = {}
        for k, part, id_, mask, n in self.rows:
            to, key = (copies, (part, id_, mask | COPY)) if _later(id_, self.least[k]) else (left, (part, id_, mask, k))
            to[key] = to.get(key, 0) + n
        found = [(*key, n) for key, n in copies.items()], [(*key[:3], n, self.texts[key[3]]) for key, n in left.items()]
        self.clear()
        return found


def _batches(schema: pa.Schema, rows: list[tuple], size: int = 2048) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), size):
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + size]), schema)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def local_tries(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """part, id, mask, n, text, size, flush: rows of each map task's tries.

    A row without text is answered: its mask is whole.  One with text is the smallest of its
    text in its trie; flush is another number for every trie.
    """
    schema = _schema(docs.schema[id_col].dataType)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, flush = _Reduction(), TaskContext.get().partitionId() << 32

        def emptied() -> Iterator[pa.RecordBatch]:
            copies, left = held.settle()
            return _batches(arrow, [(*row, None, 0, flush) for row in copies] + [(*row, len(row[4]), flush) for row in left])

        for rows, texts in groups(batches, "text"):
            ids, parts = rows.column(0).to_pylist(), rows.column(2).to_pylist()
            for id_, part, text in zip(ids, parts, texts):
                held.add(part or "", id_, failures(text), 1, text)
            if held.bytes > TRIE_BYTES:
                yield from emptied()
                flush += 1
        yield from emptied()

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(part_col).cast("string").alias("part"))
    return own.mapInArrow(run, schema)


def adaptive_prefixes(texts: DataFrame) -> tuple[DataFrame, bool]:
    """``texts`` (text, size and more) with head, group and hot; whether any row is hot.

    group: a hash of the shortest prefix of PREFIX * LONGER**k bytes that a bounded number of
    bytes share, or of the whole text.  head: the first PREFIX bytes, for order.  hot: copies of
    the whole text alone exceed the bound.  A round counts only what the round before found too
    large.  At most PARTS prefixes a partition can be (or one every MOST_BYTES of all texts):
    that bounds what is broadcast, a hash each.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weight = F.sum(F.col("size").cast("long") + 64)
    total = texts.agg(weight).first()[0] or 0
    bound = min(MOST_BYTES, max(1, total // (PARTS * parts)))
    group = hot = None
    open_, rest, made, k = F.lit(True), texts, texts, 0
    while hot is None:
        length = PREFIX * LONGER**k
        mark = F.xxhash64(F.substring("text", 1, length))
        group = mark if group is None else F.when(open_, mark).otherwise(group)
        sizes = rest.groupBy(mark.alias("mark")).agg(weight.alias("bytes"), F.max("size").alias("longest"))
        large = materialise(sizes.where(F.col("bytes") > bound), "large-prefixes")
        longest = large.agg(F.max("longest")).first()[0]
        if longest is None:
            hot = F.lit(False)
            break
        names = F.broadcast(large.select(F.col("mark").alias(f"large{k}")))
        made = made.join(names, F.xxhash64(F.substring("text", 1, length)) == F.col(f"large{k}"), "left")
        open_ = open_ & F.col(f"large{k}").isNotNull()
        if longest <= length:
            hot = open_
            break
        rest = rest.join(names, mark == F.col(f"large{k}"), "left_semi")
        k += 1
    columns = {"head": F.substring("text", 1, PREFIX), "group": group, "hot": hot}
    return made.withColumns(columns).select(*texts.columns, *columns), longest is not None


def range_tries(texts: DataFrame, *keys: str, last: bool) -> DataFrame:
    """The rows of ``local_tries`` again, from one trie per value of ``keys``.

    Rows are dealt to ranges of ``keys`` and sorted, so a task holds one trie at a time.  With
    ``last`` every row is answered; else those that are the smallest of their text keep it.
    """
    names = ("part", "id", "mask", "n", "text", "size", "flush")
    schema = T.StructType([texts.schema[c] for c in names])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = _Reduction(), None

        def emptied() -> list[tuple]:
            copies, left = held.settle()
            own = [(*row[:4], None, 0, 0) if last else (*row, len(row[4]), 0) for row in left]
            return [(*row, None, 0, 0) for row in copies] + own

        for batch in batches:
            out = []
            for part, id_, mask, n, text, *key in zip(*[c.to_pylist() for c in batch.columns]):
                if key != now:
                    out += emptied()
                    now = key
                held.add(part, id_, mask, n, text)
            yield from _batches(arrow, out)
        yield from _batches(arrow, emptied())

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.select(*names[:5], *keys).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, schema)


def masks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, id, mask, n: how many rows of an id fail which filters (bit 0: A, ... bit 4: E).

    E: identical to the text of a smaller id anywhere in the table.  A null text is empty, a
    null part the empty string.  A null id comes after all others and is no smaller than
    another null one; rows of one id and text are no copies of each other.  An empty table
    gives no rows; further columns are ignored.
    """
    local = materialise(local_tries(docs, id_col, text_col, part_col), "local-tries")
    keyed, hot = adaptive_prefixes(local.where("text IS NOT NULL"))
    results = [local.where("text IS NULL"), range_tries(keyed.where(~F.col("hot")), "head", "group", last=True)]
    if hot:
        salted = keyed.where("hot").withColumn("salt", F.pmod(F.xxhash64("flush"), F.lit(SALTS)))
        first = materialise(range_tries(salted, "head", "group", "salt", last=False), "salted-tries")
        left = first.where("text IS NOT NULL").withColumn("group", F.xxhash64("text"))
        results += [first.where("text IS NULL"), range_tries(left, "group", last=True)]
    return reduce(DataFrame.unionByName, [r.select("part", "id", "mask", "n") for r in results])


def tally(found: DataFrame, labels: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """part, mask, n, good, toxic: the rows of ``masks`` counted; good: a label says quality 1."""
    told = labels.groupBy(F.col(id_col).alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    sums = {c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("good", "toxic")}
    return found.join(told, "id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), *sums.values())


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from ``tally``'s at most 32 masks a part."""
    orders = " ".join(map("".join, itertools.permutations(FILTERS)))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    steps = parts.select("part", "masks", F.explode(F.split(F.lit(orders), " ")).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")
    )
    place = {f: F.instr("filter_order", f) for f in FILTERS}
    bits = lambda when: reduce(
        lambda x, y: x + y, [F.when(when(at), 1 << k).otherwise(0) for k, at in enumerate(place.values())]
    )
    steps = steps.withColumns({"own": bits(lambda at: at == F.col("step")), "before": bits(lambda at: at < F.col("step"))})

    def total(which, of) -> Column:
        return F.aggregate(F.filter("masks", which), F.lit(0).cast("long"), lambda x, m: x + of(m))

    # Of the 120 orders, each of a mask's filters comes first in an equal share.
    shares = F.array(*[F.lit(120 // max(1, k)).cast("long") for k in range(len(FILTERS) + 1)])
    fails = lambda m: m["mask"].bitwiseAND(F.col("own")) != 0
    there = lambda m: m["mask"].bitwiseAND(F.col("before")) == 0
    here = lambda m: fails(m) & there(m)
    n = lambda m: m["n"]
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(lambda m: m["mask"].bitwiseAND(F.col("before") + F.col("own")) == 0, n).alias("kept"),
        total(here, n).alias("removed"),
        total(lambda m: fails(m) & ~there(m), n).alias("redundant"),
        total(lambda m: m["mask"] == F.col("own"), n).alias("unique_fails"),
        total(here, lambda m: m["good"]).alias("good_lost"),
        total(here, lambda m: m["toxic"]).alias("toxic_lost"),
        total(fails, lambda m: m["n"] * F.get(shares, F.bit_count(m["mask"]))).alias("shapley"),
    )


def filter_audit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """What the filters A to E do in all 120 orders, per value of ``part_col``.

    One row per part, filter_order and step: kept, removed, redundant (fails, removed earlier),
    unique_fails (fails nothing else), good_lost, toxic_lost (removed here, as a label of the id
    says) and shapley (removed here, summed over all orders).  See ``masks`` for nulls and ties;
    labels of a null id belong to no row, several of one id count once.
    """
    found = masks(docs, id_col=id_col, text_col=text_col, part_col=part_col)
    return interactions(materialise(tally(found, labels, id_col=id_col), "tally"))
