"""The trie of conversation prefixes, by a skeleton of splitters and sorted shards.

A turn is the SHA-256 of its role and text, a conversation the string of its turns' digests:
its path.  Paths (with the conversation id behind, so copies can be cut anywhere) are range
partitioned and sorted.  Only a prefix that the last path of one shard has in common with the
first path of the next is a node of two shards.  These prefixes are the skeleton: the trie of
the splitter paths, broadcast as its common prefix lengths, two numbers a shard.  Each shard
finishes all its other nodes by itself, and gives a partial aggregate of every skeleton node it
meets.  Partial aggregates are plain sums: a node counts as its parent's child in the first
shard that meets it and as a leaf in the last one, so a grouping puts them together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from levelfield.session import materialise

DIGEST = 32
#: Conversations a shard holds in memory.
SHARD = 20_000
#: Bytes of a stretch of a node's end list.
STRETCH = 1 << 18
#: What divides conversations into families, and the first of each family gives the heads.
FAMILY, HEADS = 5, 9


def paths(turns: DataFrame, *, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """id, path (32 bytes a turn), sizes (UTF-8 bytes of each text): the conversations as they are.

    Turns are put in order of turn (null first), then role, then text digest.  Texts stay
    where they are read; their digests travel.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    row = F.struct(
        F.col(turn_col).alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(text, 256)).alias("of_text"),
        F.unhex(F.sha2(whole, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
    )
    rows = turns.select(F.col(id_col).alias("id"), row.alias("row"))
    own = rows.groupBy("id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return own.select("id", F.col("rows.digest").alias("digests"), F.col("rows.size").alias("sizes"))


def rebuilt(own: DataFrame) -> DataFrame:
    """id, path, sizes of every conversation c after its first h turns are replaced by those of
    c - c % 5, where h is crc32 of c in decimal, modulo 9.

    The head of a family has at most nine members; only its first eight turns travel.  A null
    id has no family: the conversation stays as it is.
    """
    id_, most = F.col("id"), HEADS - 1
    h = F.coalesce(F.crc32(id_.cast("string")) % HEADS, F.lit(0)).cast("int")
    heads = own.where(id_ % FAMILY == 0).select(
        id_.alias("head"), F.slice("digests", 1, most).alias("head_digests"), F.slice("sizes", 1, most).alias("head_sizes")
    )
    both = own.withColumn("h", h).join(heads, (id_ - id_ % FAMILY) == F.col("head"), "left")

    def put(name: str) -> Column:
        of_head = F.slice(F.coalesce(F.col(f"head_{name}"), F.slice(name, 1, 0)), F.lit(1), F.col("h"))
        rest = F.when(F.size(name) > F.col("h"), F.slice(F.col(name), F.col("h") + 1, F.size(name)))
        return F.concat(of_head, F.coalesce(rest, F.slice(name, 1, 0)))

    made = both.select("id", put("digests").alias("digests"), put("sizes").alias("sizes"))
    path = F.when(F.size("digests") > 0, F.unhex(F.array_join(F.transform("digests", F.hex), "")))
    return made.select("id", F.coalesce(path, F.unhex(F.lit(""))).alias("path"), "sizes")


def common_turns(a: bytes, b: bytes) -> int:
    """How many turns two paths share at their front."""
    n = min(len(a), len(b)) // DIGEST
    low = 0
    while low < n:
        mid = (low + n + 1) // 2
        if a[low * DIGEST : mid * DIGEST] == b[low * DIGEST : mid * DIGEST]:
            low = mid
        else:
            n = mid - 1
    return low


def skeleton(bounds: list[tuple[int, bytes, bytes]]) -> dict[int, tuple[int, int]]:
    """shard -> how many turns its first path shares with the shard before, and its last path
    with the shard behind; from (shard, first path, last path) in order.

    Sorted paths and the common prefixes of neighbours are a trie: a prefix of that many turns,
    or fewer, is a node of both shards, and no other is.
    """
    between = [common_turns(a[2], b[1]) for a, b in zip(bounds, bounds[1:])]
    shared = lambda k: between[k] if 0 <= k < len(between) else -1
    return {shard: (shared(k - 1), shared(k)) for k, (shard, _, _) in enumerate(bounds)}


def _node(id_: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("node", T.BinaryType()),  # digest of a skeleton node's path, else null
            T.StructField("above", T.BinaryType()),  # of its parent's path, if that is of the skeleton
            T.StructField("id", id_),
            T.StructField("parent_id", id_),
            *(T.StructField(c, T.LongType()) for c in ("depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "shard", "nth")),
            T.StructField("ends", T.StringType()),  # the digest of the list, or a stretch of it
        ]
    )


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


class _Node:
    """A node as one shard sees it."""

    __slots__ = ("parent", "depth", "size", "entered", "left", "key", "id", "convs", "children", "inner", "leaves", "saved", "ends")

    def __init__(self, parent, depth: int, size: int, entered: bool):
        self.parent, self.depth, self.size, self.entered, self.left, self.key = parent, depth, size, entered, False, None
        self.id, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.inner = False  # whether a child was met, in whichever shard it began
        self.ends: list[str] = []

    def close(self) -> None:
        """All of the shard's members have been read."""
        self.saved += (self.convs - (not self.entered)) * self.size
        self.leaves += not self.left and not self.inner
        if up := self.parent:
            up.id = _least(up.id, self.id)
            up.convs += self.convs
            up.leaves += self.leaves
            up.saved += self.saved
            up.children += not self.entered
            up.inner = True


def _keys(path: bytes, turns: int) -> list[bytes]:
    """Digests of the prefixes of 0 to ``turns`` turns."""
    digest = hashlib.sha256()
    out = [digest.digest()]
    for k in range(turns):
        digest.update(path[k * DIGEST : (k + 1) * DIGEST])
        out.append(digest.copy().digest())
    return out


def shard_nodes(shard: int, rows: Iterable[tuple], enters: int, leaves: int) -> Iterator[tuple]:
    """The nodes of one shard as rows of ``_node``; ``rows`` are (id, path, sizes) in order of
    path and id.

    The prefixes of up to ``enters`` turns of the first path are nodes of the shard before as
    well, those of up to ``leaves`` turns of the last path of the shard behind.  They come
    with sums to be added to those of the other shards, and their ends in stretches.
    """
    stack: list[_Node] = []
    made: list[_Node] = []
    path = first = None
    for id_, own, sizes in rows:
        keep = -1 if path is None else common_turns(path, own)
        first, path = own if first is None else first, own
        while len(stack) > keep + 1:
            stack.pop().close()
        for d in range(keep + 1, len(own) // DIGEST + 1):
            stack.append(_Node(stack[-1] if stack else None, d, sizes[d - 1] if d else 0, own is first and d <= enters))
            made.append(stack[-1])
        last = stack[-1]
        last.id = _least(last.id, id_)
        last.convs += 1
        last.ends.append("" if id_ is None else str(id_))
    if path is None:
        return
    for node, key in zip(stack, _keys(path, min(leaves, len(path) // DIGEST)) if leaves >= 0 else ()):
        node.left, node.key = True, key
    if enters >= 0:  # the first path's nodes were made first
        for node, key in zip(made, _keys(first, enters)):
            node.key = key
    while stack:
        stack.pop().close()
    for node in made:
        up = node.parent
        head = (
            node.key, up and up.key, node.id, up.id if up and not up.key else None,
            node.depth, node.convs, node.children, node.leaves, node.saved, shard,
        )
        text = ",".join(node.ends)
        if not node.key:
            yield (*head, 0, hashlib.sha256(text.encode()).hexdigest())
        elif not node.ends:
            yield (*head, 0, None)
        else:
            for k in range(0, max(1, len(text)), STRETCH):
                # The counts go with the first stretch.
                own = head if k == 0 else (*head[:2], None, None, node.depth, 0, 0, 0, 0, shard)
                yield (*own, k // STRETCH, text[k : k + STRETCH])


def _streamed_digests(stretches: DataFrame) -> DataFrame:
    """node, ends_sha256 of (node, shard, nth, ends): read in order, never put together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, before = None, None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])

        for batch in batches:
            for node, shard, text in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                if node != now:
                    if now is not None:
                        yield told()
                    now, digest = node, hashlib.sha256()
                elif shard != before:
                    digest.update(b",")
                before = shard
                digest.update(text.encode())
        if now is not None:
            yield told()

    dealt = stretches.select("node", "shard", "ends", "nth").repartition("node").sortWithinPartitions("node", "shard", "nth")
    return dealt.mapInArrow(run, "node binary, ends_sha256 string")


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row per node of ``convs`` (id, path, sizes): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = convs.sparkSession
    convs = materialise(convs, "conversations")
    total = convs.count()
    n = max(1, -(-total // SHARD), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total))
    key = ["path", F.col("id").asc_nulls_first()]
    ranged = materialise(convs.repartitionByRange(n, *key).withColumn("shard", F.spark_partition_id()), "ranges")
    bounds = ranged.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last")).orderBy("shard").collect()
    splits = spark.sparkContext.broadcast(skeleton([(r["shard"], bytes(r["first"]), bytes(r["last"])) for r in bounds]))
    schema = _node(convs.schema["id"].dataType)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ([c.to_pylist() for c in b.columns] for b in batches if b.num_rows)
        head = next(columns, None)
        if head is None:
            return
        shard = head[0][0]
        rows = (row for of in chain([head], columns) for row in zip(*of[1:]))
        found = shard_nodes(shard, rows, *splits.value[shard])
        while part := list(islice(found, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), arrow)], schema=arrow)

    dealt = ranged.select("shard", "id", "path", "sizes").repartitionById(n, F.col("shard")).sortWithinPartitions(*key)
    nodes = materialise(dealt.mapInArrow(run, schema), "nodes")
    partial = nodes.where("node IS NOT NULL")
    met = partial.groupBy("node").agg(
        F.min("id").alias("id"),
        F.max("above").alias("above"),
        F.max("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    ends = _streamed_digests(partial.where("ends IS NOT NULL"))
    none = F.lit(hashlib.sha256().hexdigest())
    shared = materialise(met.join(ends, "node", "left").withColumn("ends", F.coalesce("ends_sha256", none)), "skeleton")
    columns = ["id", "depth", "above", "parent_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    every = nodes.where("node IS NULL").select(*columns).unionByName(
        shared.withColumn("parent_id", F.lit(None).cast(convs.schema["id"].dataType)).select(*columns)
    )
    # A skeleton parent's smallest id; the skeleton is a few nodes a shard.
    up = shared.select(F.col("node").alias("above"), F.col("id").alias("above_id"))
    return every.join(up, "above", "left").select(
        F.col("id").alias("conv_id"),
        "depth",
        F.coalesce("parent_id", "above_id").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.col("ends").alias("ends_sha256"),
    )


def conversation_trie(
    turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The nodes of all rebuilt conversations, see ``rebuilt`` and ``prefix_trie``.

    A null role or text is empty, null turns come first, rows of one turn are put in order of
    role and text digest, repeated rows are turns of their own.  Rows of null id are one
    conversation, which is rebuilt from nobody, has no number to be the smallest, and is an
    empty entry at the front of the ends it is in.  An empty table gives no rows; further
    columns are ignored.
    """
    own = materialise(paths(turns, id_col=id_col, turn_col=turn_col, role_col=role_col, text_col=text_col), "turn-paths")
    return prefix_trie(rebuilt(own))
