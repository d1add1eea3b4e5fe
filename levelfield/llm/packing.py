"""Best-fit packing of tokenised documents with a grouping genetic algorithm.

Pieces are dealt evenly into blocks of a few thousand.  Every block is evolved on several
islands: a population of packings, whose crossover injects whole well-filled bins of one
parent into another, removes the bins that hold the same pieces and best-fits the displaced
ones.  Between epochs the best packing of each island migrates to the next one; what each
epoch finds is written, so a lost executor costs one epoch at most.  The least filled bins
of all blocks are then dealt into new blocks and packed again, until one block is left.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import cache
from struct import pack as struct_pack

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levelfield.llm.words import groups
from levelfield.session import materialise

CAPACITY = 4096
END = 1
BLOCK = 4096  # pieces a task evolves at a time
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 3, 2, 6, 4
#: Bins of each block that are dealt again, the least filled.
SPARE = 2
#: Words whose ids a Python worker remembers.
REMEMBER = 500_000

_AFTER = frozenset(b".,;:!?")
_PLAIN = regex.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")


class _Known(dict):
    """Words and their ids; a word not seen before is encoded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.encode(word)
        return ids


class Encoder:
    """Token ids of whole texts, looked up word by word.

    The tokenizer drops white space and never joins across it, so the ids of a text are the
    ids of its words in order.  A word of plain signs is cut as the tokenizer's own pattern
    says and given to its model; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        cut = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.special = [t["content"] for t in told["added_tokens"]]
        self.cut = regex.compile(cut)
        keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        moved = (256 + k for k in range(256))
        self.signs = str.maketrans({b: chr(b) if b in keep else chr(next(moved)) for b in range(256)})
        self.known = _Known(self.word)
        self.parts: dict[str, bytes] = {}

    def part(self, text: str) -> bytes:
        found = self.parts.get(text)
        if found is None:
            signs = text if text.isascii() else text.encode().decode("latin-1").translate(self.signs)
            ids = [t.id for t in self.model.tokenize(signs)]
            found = self.parts[text] = struct_pack(f"<{len(ids)}I", *ids)
        return found

    def word(self, word: bytes) -> bytes:
        """The ids of one word.  Most are letters, or letters and one sign after them, which
        the pattern cuts into just these; the accented letters of Latin-1 have one form."""
        if word.isalpha():
            return self.part(word.lower().decode())
        if word[-1] in _AFTER and word[:-1].isalpha():
            return self.part(word[:-1].lower().decode()) + self.part(chr(word[-1]))
        text = word.decode("utf-8", "replace")
        if text.isalpha() and max(text) < "\u0100":
            return self.part(text.lower())
        if _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return b"".join([self.part(part) for part in self.cut.findall(text.lower())])
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: bytes) -> bytes:
        """The ids as unsigned 32-bit little-endian numbers."""
        if len(self.known) > REMEMBER:
            self.known.clear()
            self.parts.clear()
        return b"".join(map(self.known.__getitem__, text.split()))


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every whole text and the end id after it.

    id, piece, start, length, ids_crc32, and part, nth: the map task and the place in it
    among the pieces that are not full.  A null text is empty and still has its end id.
    """

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), [0, 0]
        end = np.array([END], "<u4").tobytes()
        for rows, texts in groups(batches, "text"):
            row, piece, length, crc, nth = [], [], [], [], []
            for i, text in enumerate(texts):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
                    full = len(own) == 4 * capacity
                    nth.append(seen[full])
                    seen[full] += 1
            k = np.array(piece, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0).take(pa.array(row, pa.int64())),
                    pa.array(k),
                    pa.array(k.astype(np.int64) * capacity),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array(np.full(len(row), part, np.int64)),
                    pa.array(nth, pa.int64()),
                ],
                ["id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("piece", T.IntegerType()),
            *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "part", "nth")),
        ]
    )
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(make, schema)


class Packing:
    """Bins of a block: which bin each piece is in, and the fill of each bin."""

    def __init__(self, bins: np.ndarray, sizes: np.ndarray, capacity: int):
        used, self.bins = np.unique(bins, return_inverse=True)
        self.fill = np.bincount(self.bins, weights=sizes, minlength=len(used)).astype(np.int64)
        #: Fewest bins first, then Falkenauer's: full bins beside empty ones beat halves.
        self.cost = (len(used), -float(np.mean((self.fill / capacity) ** 2)) if len(used) else 0.0)


def best_fit(sizes: np.ndarray, order: Iterable[int], bins: np.ndarray, fill: np.ndarray, capacity: int) -> np.ndarray:
    """Put the pieces of ``order`` where least room is left; -1 in ``bins`` marks no bin yet."""
    bins = bins.copy()
    room = sorted(zip((capacity - fill).tolist(), range(len(fill))))
    new, size_of = len(fill), sizes.tolist()
    for i in order:
        size = size_of[i]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, new
            new += 1
        bins[i] = b
        if left > size:
            insort(room, (left - size, b))
    return bins


def cross(mother: Packing, father: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """Inject whole well-filled bins of the father, refit what the mother loses by it."""
    filled = np.flatnonzero(father.fill >= np.median(father.fill))
    gift = np.zeros(len(father.fill), bool)
    gift[rng.choice(filled, max(1, int(len(filled) * rng.uniform(0.1, 0.5))), replace=False)] = True
    given = gift[father.bins]
    hit = np.zeros(len(mother.fill), bool)
    hit[mother.bins[given]] = True
    # A few of the emptiest bins go as well, so the refit has something to improve.
    hit[np.argsort(mother.fill)[: max(1, len(mother.fill) // 50)]] = True
    stays = ~hit[mother.bins] & ~given
    bins = np.full(len(sizes), -1)
    bins[stays] = mother.bins[stays]
    bins[given] = father.bins[given] + len(mother.fill)
    used, packed = np.unique(bins[bins >= 0], return_inverse=True)
    bins[bins >= 0] = packed
    kept = bins >= 0
    fill = np.bincount(bins[kept], weights=sizes[kept], minlength=len(used)).astype(np.int64)
    loose = np.flatnonzero(~kept)
    order = loose[np.argsort(-sizes[loose], kind="stable")]
    return Packing(best_fit(sizes, order.tolist(), bins, fill, capacity), sizes, capacity)


def evolve(
    sizes: np.ndarray, elites: list[np.ndarray], capacity: int, seed: int,
    generations: int = GENERATIONS, population: int = POPULATION,
) -> Packing:
    """The best packing found from ``elites`` and fresh ones; ends at the lower bound."""
    rng = np.random.default_rng(seed)
    bound = -(-int(sizes.sum()) // capacity)
    none, empty = np.full(len(sizes), -1), np.zeros(0, np.int64)
    people = [Packing(e, sizes, capacity) for e in elites]
    while len(people) < population and not (people and min(people, key=lambda p: p.cost).cost[0] <= bound):
        blur = 1 + (0.0 if not people else 0.15) * rng.random(len(sizes))
        order = np.argsort(-sizes * blur, kind="stable").tolist()
        people.append(Packing(best_fit(sizes, order, none, empty, capacity), sizes, capacity))
    for _ in range(generations):
        people.sort(key=lambda p: p.cost)
        if people[0].cost[0] <= bound or len(people) < 2:
            break
        child_of = [(0, int(rng.integers(1, len(people)))), (int(rng.integers(1, len(people))), 0)]
        children = [cross(people[a], people[b], sizes, capacity, rng) for a, b in child_of]
        people = sorted([*people, *children], key=lambda p: p.cost)[:population]
    return min(people, key=lambda p: p.cost)


def _epoch(tasks: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """block, island, elites, sizes -> block, island, bins, n_bins, cost."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {"block": [], "island": [], "bins": [], "n_bins": [], "cost": []}
            for row in batch.to_pylist():
                seed = (row["block"] * ISLANDS + row["island"]) * EPOCHS + epoch
                elites = [np.array(e) for e in row["elites"] or []]
                best = evolve(np.array(row["sizes"], np.int64), elites, capacity, seed)
                for name, value in zip(found, (row["block"], row["island"], best.bins.tolist(), *best.cost)):
                    found[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found["block"], pa.int64()),
                    pa.array(found["island"], pa.int32()),
                    pa.array(found["bins"], pa.list_(pa.int32())),
                    pa.array(found["n_bins"], pa.int32()),
                    pa.array(found["cost"], pa.float64()),
                ],
                list(found),
            )

    return tasks.mapInArrow(run, "block long, island int, bins array<int>, n_bins int, cost double")


def pack_blocks(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """idx, block, bin for every row of ``items`` (idx, block, length).

    Blocks are independent and should hold some thousand rows each.
    """
    blocks = materialise(
        items.groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("length", "idx")), asc=False).alias("rows"))
        .select("block", F.col("rows.length").alias("sizes"), F.col("rows.idx").alias("idxs")),
        "blocks",
    )
    seats = blocks.select("block", "sizes", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"))
    best = None
    for epoch in range(EPOCHS):
        if best is None:
            tasks = seats.withColumn("elites", F.lit(None).cast("array<array<int>>"))
        else:
            arrive = best.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("bins").alias("guest"))
            tasks = seats.join(best.select("block", "island", "bins"), ["block", "island"]).join(arrive, ["block", "island"])
            tasks = tasks.withColumn("elites", F.array("bins", "guest"))
        work = tasks.select("block", "island", "sizes", "elites").repartition("block", "island")
        best = materialise(_epoch(work, capacity, epoch), "elites")
    chosen = best.groupBy("block").agg(F.min_by("bins", F.struct("n_bins", "cost", "island")).alias("bins"))
    placed = blocks.join(chosen, "block").select("block", F.explode(F.arrays_zip("idxs", "bins")).alias("at"))
    return placed.select(F.col("at.idxs").alias("idx"), "block", F.col("at.bins").alias("bin"))


def _spare_bins(placed: DataFrame) -> DataFrame:
    """block, bin of the SPARE least filled bins of each block of ``placed``."""
    fills = placed.groupBy("block", "bin").agg(F.sum("length").alias("fill"))
    order = Window.partitionBy("block").orderBy("fill", "bin")
    return fills.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SPARE).select("block", "bin")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and offset for every row of ``pieces``, other columns unchanged.

    ``pieces`` has length (1 to ``capacity``), part and nth (a row's place among the rows
    of its part that are not full, or among the full ones), and must be stored, because it
    is read several times.  A full piece is a sequence.  Rows of equal length are told
    apart by their place only, so repeated rows are packed as rows of their own.  An empty
    table gives no rows.
    """
    open_ = pieces.where(F.col("length") < capacity)
    counts = materialise(open_.groupBy("part").agg(F.count("*").alias("n")), "parts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    n_blocks = max(1, -(-total // BLOCK))
    items = materialise(
        open_.join(before, "part").select(
            (F.col("before") + F.col("nth")).alias("idx"), "part", "nth", "length"
        ),
        "items",
    )
    dealt = items.select("idx", "length", (F.col("idx") % n_blocks).alias("block"))
    turn, settled = 0, []
    while True:
        placed = materialise(pack_blocks(dealt, capacity).join(dealt.select("idx", "length"), "idx"), "placed")
        again = None
        if n_blocks > 1:
            spare = materialise(_spare_bins(placed), "spare")
            again = placed.join(spare, ["block", "bin"], "left_semi")
            left = again.count()
            if 2 * left > total:  # nearly all bins are spare ones: another turn would not end
                again = None
        stays = placed if again is None else placed.join(spare, ["block", "bin"], "left_anti")
        settled.append(stays.withColumn("turn", F.lit(turn)))
        if again is None:
            break
        total, n_blocks, turn = left, max(1, -(-left // BLOCK)), turn + 1
        dealt = materialise(again.select("idx", "length", (F.col("block") % n_blocks).alias("block")), "dealt")
    bins = settled[0]
    for more in settled[1:]:
        bins = bins.unionByName(more)
    number = (F.col("turn").cast("long") * F.lit(1 << 40) + F.col("block")) * F.lit(2 * BLOCK) + F.col("bin")
    at = Window.partitionBy("sequence_id").orderBy("idx")
    seats = bins.select("idx", "length", number.alias("sequence_id")).select(
        "idx", "sequence_id", (F.sum("length").over(at) - F.col("length")).alias("offset")
    )
    places = items.select("idx", "part", "nth").join(seats, "idx").drop("idx")
    packed = open_.join(places, ["part", "nth"])
    full = pieces.where(F.col("length") >= capacity).withColumns(
        {
            "sequence_id": -1 - (F.col("part") * F.lit(1 << 33) + F.col("nth")),
            "offset": F.lit(0).cast("long"),
        }
    )
    return packed.unionByName(full)


def pack_documents(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """One row per piece of every document: id, piece, start, length, ids_crc32,
    sequence_id, offset.  Null texts are empty, null ids stay null, repeated rows are
    packed as often as they occur, an empty table gives no rows, further columns are
    ignored.
    """
    pieces = materialise(token_pieces(docs, tokenizer, id_col=id_col, text_col=text_col, capacity=capacity), "pieces")
    return pack(pieces, capacity).select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
