"""SentencePiece encoding and decoding as relations.

A text becomes words no piece can cross.  The distinct words are exploded into their
substrings of bounded length, which are joined to the piece table by equality: the edges of
each word's lattice.  Edges are grouped by word, and a fold over them (``aggregate``) finds
the best path.  For the given kind of model, byte pair encoding, a piece's score is its
merge rank, and the best path is the one that takes edges in order of score and joins the
two symbols an edge spans, leftmost first; for pieces that are themselves reachable by
merges this is exactly the encoder's result.  The fold's state is a bit mask of the places
where symbols begin, so a step is a few integer operations.

Texts are split once.  A task numbers the words of a block of texts as it meets them, so a
text is a list of small numbers and a word stands once in a block.  The blocks' words are
joined to the encoded words, and each block gets its answers back: ids of whole texts, in
order.  No word is broadcast, and a frequent one weighs one row a block.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levelfield.llm.substring import release
from levelfield.session import materialise

SPACE = "▁"
#: Words of more code points than the mask has places are folded by a heap instead.
MASK = 60
#: Most pieces a table may have to be broadcast.
VOCABULARY = 300_000
#: Partitions of the lattice for each of the session's shuffle partitions.
SPREAD = 8
#: Code points of a block of texts, and numbers of a stored chunk of it; one longer text is
#: a block or a chunk of its own.
BLOCK, CHUNK = 8_000_000, 1 << 20
#: Turns in which words find their ids, and in which blocks get theirs, so that only a share
#: of either lies in shuffle files.
WORD_TURNS, TURNS = 4, 8
#: Signs at a place that bound the length of the substrings which start there.
HEAD = 4
#: A word is blanks and letters, or blanks and other signs: no piece has both.
WORD = rf"{SPACE}*\p{{L}}+|{SPACE}*[^\p{{L}}{SPACE}]+|{SPACE}+"


def settle(spark: SparkSession) -> None:
    """Give back shuffle files, the last step's too: Spark holds on to the last query until
    another one has run, so a query of one row goes first."""
    spark.range(1).write.format("noop").mode("overwrite").save()
    release(spark)


def piece_table(spark: SparkSession, model_file: str) -> DataFrame:
    """piece, id, rank: the pieces that match text, ranked by falling score."""
    import regex
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    rows = [
        (model.id_to_piece(i), i, model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    crossing = [p for p, _, _ in rows if len(regex.findall(WORD, p)) != 1 or not regex.fullmatch(WORD, p)]
    if crossing or len(rows) > VOCABULARY:
        raise ValueError(f"pieces that cross words ({crossing[:3]}) or too many of them ({len(rows)})")
    scores = [s for p, _, s in rows if p.strip(SPACE) and len(p) > 1]
    if len(set(scores)) < len(scores):
        raise ValueError("pieces of more than one sign must differ in score")
    rank = {s: k for k, s in enumerate(sorted({s for p, _, s in rows if len(p) > 1}, reverse=True))}
    return spark.createDataFrame(
        [(p, i, rank.get(s, 0)) for p, i, s in rows], "piece string, id int, rank int"
    )


def byte_ids(model_file: str) -> list[int]:
    """The ids of the 256 byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


#: An edge is one number, in merge order: rank, start, length, id (all ones: no piece).
_RANK, _START, _LENGTH, _ID = 32, 26, 20, 0
NO_PIECE = (1 << 20) - 1


def _edge(rank: Column, start: Column, length: Column, id_: Column) -> Column:
    parts = ((rank, _RANK), (start, _START), (length, _LENGTH), (id_, _ID))
    return reduce(lambda x, y: x + y, [F.shiftleft(v.cast("long"), n) for v, n in parts])


def _field(edge: Column, at: int, bits: int) -> Column:
    return F.shiftright(edge, at).bitwiseAND((1 << bits) - 1).cast("int")


def _shift(bits: Column, by: Column) -> Column:
    return F.call_function("shiftleft", bits, by)


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, whatever ``use`` does with it."""
    return F.transform(F.array(value), use)[0]


def _span(edge: Column) -> Column:
    """An edge as a struct: the places at which it begins and ends and those between, as
    bits, and the number below its rank."""
    start, length = _field(edge, _START, 6), _field(edge, _LENGTH, 6)
    wide = _shift(F.lit(1).cast("long"), length)
    return F.struct(
        _shift(wide + 1, start).alias("ends"),
        _shift(wide - 2, start).alias("inner"),
        edge.bitwiseAND((1 << _RANK) - 1).alias("rest"),
    )


def _viterbi(spans: Column, size: Column) -> Column:
    """Mask of symbol starts after taking ``spans`` in order; bit ``size`` closes the word."""
    start = _shift(F.lit(1).cast("long"), size + 1) - 1

    def step(mask, e):
        between = mask.bitwiseAND(e["inner"])
        joins = (
            (mask.bitwiseAND(e["ends"]) == e["ends"])
            & (between != 0)
            & (between.bitwiseAND(between - 1) == 0)
        )
        return F.when(joins, mask.bitwiseXOR(between)).otherwise(mask)

    return F.aggregate(spans, start, step)


def _best_path(edges: Column, size: Column) -> Column:
    """The edges of the best path by start, each without its rank."""
    on_path = lambda m, e: m.bitwiseAND(e["ends"].bitwiseOR(e["inner"])) == e["ends"]
    return _once(
        F.transform(edges, _span),
        lambda spans: _once(
            _viterbi(spans, size),
            lambda m: F.array_sort(F.transform(F.filter(spans, lambda e: on_path(m, e)), lambda e: e["rest"])),
        ),
    )


def lattice(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """word, edges: for every word its piece edges in merge order, single signs included
    whether or not a piece writes them.

    Substrings from a place are as long as the longest piece that begins with the HEAD signs
    found there, or shorter than HEAD signs where none does.  ``words`` is dealt by word;
    exploding and the broadcast joins keep it so, and grouping needs no further exchange.
    """
    size = F.char_length("word")
    starts = words.select("word", F.explode(F.sequence(F.lit(0), size - 1)).alias("start"))
    heads = pieces.groupBy(F.substring("piece", 1, HEAD).alias("head")).agg(
        F.max(F.char_length("piece")).alias("longest")
    )
    bounded = starts.withColumn("head", F.col("word").substr(F.col("start") + 1, F.lit(HEAD))).join(
        F.broadcast(heads), "head", "left"
    )
    most = F.least(F.coalesce("longest", F.lit(HEAD - 1)), size - F.col("start"))
    spans = bounded.select("word", "start", F.explode(F.sequence(F.lit(1), most)).alias("length"))
    cut = spans.withColumn("piece", F.col("word").substr(F.col("start") + 1, F.col("length")))
    edges = cut.join(F.broadcast(pieces), "piece", "left").where("id IS NOT NULL OR length = 1")
    edge = _edge(F.coalesce("rank", F.lit(0)), F.col("start"), F.col("length"), F.coalesce("id", F.lit(NO_PIECE)))
    return edges.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def _heap_encode(word: str, ranks: dict[str, tuple[int, int]], of_byte: list[int]) -> list[int]:
    """The same merges for one word, in n log n."""
    nxt, prv, piece = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1)), list(word)
    heap: list[tuple[int, int, str, str]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < len(word) and piece[i] + piece[j] in ranks:
            heapq.heappush(heap, (ranks[piece[i] + piece[j]][1], i, piece[i], piece[j]))

    for i in range(len(word)):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if piece[i] != a or j >= len(word) or piece[j] != b:
            continue
        piece[i], piece[j], nxt[i] = a + b, "", nxt[j]
        if nxt[j] < len(word):
            prv[nxt[j]] = i
        offer(i)
        if prv[i] >= 0:
            offer(prv[i])
    out = []
    for p in piece:
        if p in ranks:
            out.append(ranks[p][0])
        else:
            out += [of_byte[b] for b in p.encode()]
    return out


def encode_words(words: DataFrame, model_file: str) -> DataFrame:
    """word, ids for distinct ``words`` (word) that are dealt by word."""
    spark = words.sparkSession
    pieces = piece_table(spark, model_file)
    of_byte = byte_ids(model_file)
    listed = pieces.collect()  # the vocabulary, at most VOCABULARY rows
    ranks = {r.piece: (r.id, r.rank) for r in listed}
    as_bytes = F.array(*[F.lit(i) for i in of_byte])

    def of_sign(sign: Column) -> Column:
        code = F.hex(F.encode(sign, "UTF-8"))
        at = F.sequence(F.lit(0), (F.length(code) / 2 - 1).cast("int"))
        return F.transform(
            at, lambda k: F.get(as_bytes, F.conv(F.substring(code, (2 * k + 1).cast("int"), F.lit(2)), 16, 10).cast("int"))
        )

    # Pieces of blanks only share one score, which a single pass in order cannot settle.
    by_heap = (F.char_length("word") > MASK) | F.contains("word", F.lit(2 * SPACE))
    short = lattice(words.where(~by_heap), pieces)
    path = _best_path(F.col("edges"), F.char_length("word"))
    told = short.select("word", path.alias("path")).select(
        "word",
        F.when(
            F.exists("path", lambda e: _field(e, _ID, 20) == NO_PIECE),
            F.flatten(
                F.transform(
                    "path",
                    lambda e: F.when(_field(e, _ID, 20) != NO_PIECE, F.array(_field(e, _ID, 20))).otherwise(
                        of_sign(F.col("word").substr(_field(e, _START, 6) + 1, F.lit(1)))
                    ),
                )
            ),
        )
        .otherwise(F.transform("path", lambda e: _field(e, _ID, 20)))
        .alias("ids"),
    )

    def heap(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [_heap_encode(w, ranks, of_byte) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    long = words.where(by_heap).select("word").mapInArrow(heap, "word string, ids array<int>")
    return told.unionByName(long)


def _numbers() -> defaultdict[str, int]:
    """Numbers keys in the order in which they are first asked for."""
    return defaultdict(count().__next__)


def _packed(numbers: Iterable[int]) -> bytes:
    """Numbers below 2**32 by byte planes, compressed."""
    import zstandard

    planes = np.asarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _packed_first(numbers: list[int], known: int) -> bytes:
    """Numbers given in order of first use, ``known`` of them before: the next new one needs
    no more than a zero."""
    told = np.asarray(numbers, np.int64)
    most = np.maximum.accumulate(np.r_[known - 1, told])[:-1]
    return _packed(np.r_[known, np.where(told > most, 0, told + 1)])


def _unpacked_first(data: bytes) -> np.ndarray:
    told = _unpacked(data)
    known, told = told[0], told[1:]
    return np.where(told == 0, known - 1 + np.cumsum(told == 0), told - 1)


def _stretches(text: str) -> list[str]:
    """A text cut in front of each run of blanks, without the run's first blank; the text
    itself has one put in front.  Words don't cross stretches."""
    import regex

    if not text:
        return []
    text = text.replace(SPACE, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [p[1:] for p in regex.findall(r" +[^ ]*", " " + text)]
    return text.split(" ")


class _Block:
    """The texts of one block while a task reads them."""

    def __init__(self, number: int, id_type: pa.DataType):
        self.number, self.id_type = number, id_type
        self.stretches, self.chars = _numbers(), 0
        self._clear()

    def _clear(self) -> None:
        self.ids, self.digests, self.sizes, self.codes = [], [], [], []
        self.known = len(self.stretches)

    def add(self, id_: pa.Scalar, text: str) -> None:
        own = list(map(self.stretches.__getitem__, _stretches(text)))
        self.ids.append(id_)
        self.digests.append(hashlib.sha256(text.encode()).digest())
        self.sizes.append(len(own))
        self.codes += own
        self.chars += len(text)

    def _row(self, *values) -> pa.RecordBatch:
        types = (pa.int64(), pa.list_(self.id_type), *[pa.binary()] * 3, pa.list_(pa.string()), *[pa.binary()] * 2)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], _BLOCK_COLUMNS)

    def chunk(self) -> pa.RecordBatch:
        """The texts since the last chunk."""
        row = self._row(
            self.number, self.ids, b"".join(self.digests), _packed(self.sizes), _packed_first(self.codes, self.known), None, None, None
        )
        self._clear()
        return row

    def words(self) -> pa.RecordBatch:
        """The block's words, and the words of each stretch by their numbers."""
        import regex

        find, numbers, sizes, told = regex.compile(WORD).findall, _numbers(), [], []
        for stretch in self.stretches:
            if stretch.isalpha() and stretch.isascii():  # one word, as most are
                sizes.append(1)
                told.append(numbers[SPACE + stretch])
                continue
            own = find(SPACE + stretch.replace(" ", SPACE))
            sizes.append(len(own))
            told += map(numbers.__getitem__, own)
        return self._row(self.number, None, None, None, None, list(numbers), _packed_first(told, 0), _packed(sizes))


_BLOCK_COLUMNS = ["block", "ids", "digests", "sizes", "codes", "words", "numbers", "word_sizes"]


def split(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts as numbered words, stored: chunks of texts and one row of words a block."""
    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    block_size, chunk_size = BLOCK, CHUNK

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, block = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            ids = batch.column(0)
            for id_, text in zip(ids.to_pylist(), batch.column(1)):
                block = block or _Block(first, ids.type)
                block.add(id_, text.as_py())
                if len(block.codes) >= chunk_size or block.chars >= block_size:
                    yield block.chunk()
                if block.chars >= block_size:
                    yield block.words()
                    first, block = first + 1, None
        if block is not None:
            if block.ids:
                yield block.chunk()
            yield block.words()

    many = T.ArrayType(chosen.schema["id"].dataType)
    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("ids", many)]
        + [T.StructField(c, T.BinaryType()) for c in _BLOCK_COLUMNS[2:5]]
        + [T.StructField("words", T.ArrayType(T.StringType()))]
        + [T.StructField(c, T.BinaryType()) for c in _BLOCK_COLUMNS[6:]]
    )
    return materialise(chosen.mapInArrow(cut, schema), "blocks", codec="zstd")


def dictionary(blocks: DataFrame, model_file: str) -> DataFrame:
    """word, ids: every distinct word of the blocks, stored.

    A word becomes about a hundred lattice rows, so the words are dealt to many more
    partitions than their few bytes ask for.
    """
    spark = blocks.sparkSession
    words = materialise(blocks.select(F.explode("words").alias("word")).distinct(), "words", codec="zstd")
    settle(spark)
    tasks = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = materialise(encode_words(words.repartition(tasks, "word"), model_file), "dictionary", codec="zstd")
    settle(spark)
    return told


def _gather(values: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``which`` of ``values`` cut at ``ends`` (0 first), one behind the other."""
    sizes = (ends[1:] - ends[:-1])[which]
    out = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(out[-1]) + np.repeat(ends[:-1][which] - out[:-1], sizes)
    return values[at], out


def _coded(keys: pa.Array, digests: list[bytes], n_words: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> pa.Table:
    listed = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
    return pa.table({"id": keys, "digest": pa.array(digests, pa.binary()), "n_words": n_words, "ids": listed})


_CODED = T.StructType(
    [
        T.StructField("digest", T.BinaryType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]
)


def _turn_of(block: str) -> Column:
    """A block is its task's number and its own in the task: every turn has its share of both."""
    dealt = F.shiftright(block, 32) + F.col(block).bitwiseAND((1 << 32) - 1)
    return F.pmod(dealt, F.lit(TURNS)).cast("int")


def answers(blocks: DataFrame, told: DataFrame) -> DataFrame:
    """of, nth, word_ids, turn: the ids of the words of each block, stored by the block's turn.

    The words of the blocks meet the dictionary by a shuffled join, a share of the words at a
    time, so either crosses the network once.
    """
    asked = blocks.where("words IS NOT NULL").select(F.col("block").alias("of"), F.posexplode("words").alias("nth", "word"))
    parts = []
    for turn in range(WORD_TURNS):
        mine = F.pmod(F.xxhash64("word"), F.lit(WORD_TURNS)) == turn
        # Distinct words on the side that is hashed, even in size and without a sort of either side.
        met = asked.where(mine).join(told.where(mine).hint("shuffle_hash"), "word")
        found = met.select("of", "nth", F.col("ids").alias("word_ids"), _turn_of("of").alias("turn"))
        # In order, in which the places shrink best.
        parts.append(materialise(found.sortWithinPartitions("turn", "of", "nth"), "answers", by="turn", codec="zstd"))
        settle(blocks.sparkSession)
    return reduce(DataFrame.unionByName, parts)


def assemble(blocks: DataFrame, answered: DataFrame, finish=_coded, columns: T.StructType = _CODED) -> DataFrame:
    """id, digest (SHA-256 of the text), n_words, ids: a row for each text of ``blocks``.

    ``answered`` has the ids of the blocks' words, which go back to their block, so a task
    holds one block's texts as numbers and its words' ids.  ``finish`` makes the rows of a
    chunk (id and ``columns``) from its ids, one text's behind the other's, and the places
    where they end.
    """
    id_type = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", id_type), *columns])

    def ends(sizes: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def put_together(own: pa.Table, found: pa.Table) -> pa.Table:
        rows = own.to_batches()
        listed = found.sort_by("nth")["word_ids"].combine_chunks()
        if isinstance(listed, pa.ChunkedArray):
            listed = pa.concat_arrays(listed.chunks) if listed.num_chunks else pa.array([], listed.type)
        ids = listed.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        of_word = ends(listed.value_lengths().to_numpy(zero_copy_only=False))
        chunks, numbers, word_sizes = [], None, None
        for row in rows:
            for r in range(row.num_rows):
                if row["numbers"][r].is_valid:
                    numbers, word_sizes = _unpacked_first(row["numbers"][r].as_py()), _unpacked(row["word_sizes"][r].as_py())
                else:
                    chunks.append((row["ids"][r].values, *(row[c][r].as_py() for c in ("digests", "sizes", "codes"))))
        ids, of_number = _gather(ids, of_word, numbers)
        of_stretch = of_number[ends(word_sizes)]
        parts = []
        for keys, digests, sizes, codes in chunks:
            text_ends, codes = ends(_unpacked(sizes)), _unpacked_first(codes)
            flat, at = _gather(ids, of_stretch, codes)
            n_words = ends(word_sizes[codes])[text_ends]
            told_apart = [digests[k : k + 32] for k in range(0, len(digests), 32)]
            parts.append(finish(keys, told_apart, n_words[1:] - n_words[:-1], flat, at[text_ends]))
        return pa.concat_tables(parts)

    # The words themselves stay behind; their ids come as answers.
    own = blocks.select("block", "ids", "digests", "sizes", "codes", "numbers", "word_sizes")
    return own.groupBy("block").cogroup(answered.select("of", "nth", "word_ids").groupBy("of")).applyInArrow(put_together, schema)


def encode(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest, n_words, ids: the ids of every text in order, a row for each input row."""
    blocks = split(docs, id_col=id_col, text_col=text_col)
    settle(docs.sparkSession)
    return assemble(blocks, answers(blocks, dictionary(blocks, model_file)))


def _reader(spark: SparkSession, model_file: str):
    """ids -> text: pieces and bytes put together in order, read as UTF-8, without the blank
    in front, blanks unmarked.  The table of pieces goes along with the function."""
    written = {r.id: r.piece.encode() for r in piece_table(spark, model_file).collect()}
    written.update({i: bytes([b]) for b, i in enumerate(byte_ids(model_file))})

    def read(ids: Iterable[int]) -> str:
        text = b"".join(map(written.__getitem__, ids)).decode("utf-8", "replace")
        return text.removeprefix(SPACE).replace(SPACE, " ")

    return read


def decode(coded: DataFrame, model_file: str) -> DataFrame:
    """id, text of ``coded`` (id, ids); the inverse of ``encode``."""
    read = _reader(coded.sparkSession, model_file)

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [read(ids.values.to_numpy().tolist()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.string())], ["id", "text"])

    chosen = coded.select("id", "ids")
    return chosen.mapInArrow(texts, T.StructType([chosen.schema["id"], T.StructField("text", T.StringType())]))


def encoding_report(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_ids, n_chars, ids_sha256, decodes.

    ids_sha256: lowercase hex of all ids in order as little-endian unsigned 32-bit integers.
    n_chars: code points of the text the ids decode to.  decodes: that text is the
    input; a text that holds the mark U+2581 itself reads back with blanks and does not.
    A null or empty text has no ids.  Repeated rows answer alike, each for itself; null ids
    stay null; an empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    read = _reader(spark, model_file)

    def told(keys, digests, n_words, ids, ends):
        n_chars, hashes, decodes = [], [], []
        for want, start, end in zip(digests, ends[:-1], ends[1:]):
            own = ids[start:end]
            text = read(own.tolist())
            n_chars.append(len(text))
            hashes.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
            decodes.append(hashlib.sha256(text.encode()).digest() == want)
        return pa.table(
            {
                "id": keys,
                "n_words": n_words,
                "n_ids": ends[1:] - ends[:-1],
                "n_chars": pa.array(n_chars, pa.int64()),
                "ids_sha256": pa.array(hashes, pa.string()),
                "decodes": pa.array(decodes, pa.bool_()),
            }
        )

    blocks = split(docs, id_col=id_col, text_col=text_col)
    settle(spark)
    answered = answers(blocks, dictionary(blocks, model_file))
    columns = T.StructType(
        [T.StructField(c, T.LongType()) for c in ("n_words", "n_ids", "n_chars")]
        + [T.StructField("ids_sha256", T.StringType()), T.StructField("decodes", T.BooleanType())]
    )
    parts = []
    for turn in range(TURNS):
        own, found = blocks.where(_turn_of("block") == turn), answered.where(F.col("turn") == turn)
        parts.append(materialise(assemble(own, found, told, columns), "encoded"))
        settle(spark)
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("id", id_col)
