"""Token ids of documents in bit-plane files.

The rows are dealt to sorted ranges of ids, every task encodes its texts in order and cuts
the ids into files of bounded size.  A file holds fixed-size blocks of ids; a block is
transposed into planes (plane k holds bit k, or byte k, of every id), and each plane is
compressed by itself, so the planes of high bits, which hardly change, shrink to little.

A file, all of it written by one task::

    "PLN1"  planes of block 0, planes of block 1, ...  documents  blocks  head  size  "PLN1" "\\n"

``documents`` (id, n_ids) and ``blocks`` (at, n_ids, sizes) are Arrow streams in zstandard:
the document table and the chunk index.  ``head`` is JSON: where the two lie, part and nth (the
file's place in the whole), the kind of plane.  ``size`` is the head's length in ten digits.
A reader takes the end of a file first and then only the blocks it needs.  A folder also has
an ``index`` of all files, with the number of ids before each.

Spark's own writers put the files in place, so a lost task leaves nothing behind and any
file system Spark knows will do.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from operator import attrgetter
from struct import Struct
from struct import pack as struct_pack

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levelfield.llm.words import groups
from levelfield.session import shared_folder

MAGIC = b"PLN1"
#: Ids of a block; ids after which a task begins its next file.
BLOCK, FILE = 1 << 16, 1 << 22
#: Words whose ids a Python worker remembers, and as many older ones.
REMEMBER = 500_000
_DIGITS = 10
_TAIL = _DIGITS + len(MAGIC) + 1  # and the line end of Spark's text writer

# ---------------------------------------------------------------- planes of one block


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block, lowest first; as many as its largest id has bits (or bytes)."""
    if not len(ids) or not (top := int(ids.max()).bit_length()):
        return []
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    rows = [np.ascontiguousarray(raw[k]) for k in range(-(-top // 8))]
    if not bits:
        return [r.tobytes() for r in rows]
    return [np.packbits((rows[k >> 3] >> (k & 7)) & 1).tobytes() for k in range(top)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    """The ids of a block of ``n``."""
    out = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        own = np.frombuffer(plane, np.uint8)
        if bits:
            out[:, k >> 3] |= np.unpackbits(own, count=n) << (k & 7)
        else:
            out[:, k] = own
    return out.reshape(-1).view("<u4")


# ---------------------------------------------------------------- one file


def _stream(table: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_batch(table)
    return zstandard.compress(sink.getvalue().to_pybytes(), 3)


def _table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(data)).read_all()


def file_bytes(ids: list[bytes], keys: pa.Array, part: int, nth: int, bits: bool, level: int = 3) -> bytes:
    """A whole file of documents: ``ids`` as unsigned 32-bit little-endian numbers, ``keys``
    the documents' ids."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    lengths = [len(x) // 4 for x in ids]
    press = zstandard.ZstdCompressor(level=level)
    body, at, blocks = [MAGIC], len(MAGIC), []
    for k in range(0, len(flat), BLOCK):
        own = flat[k : k + BLOCK]
        planes = [press.compress(p) for p in to_planes(own, bits)]
        blocks.append((at, len(own), [len(p) for p in planes]))
        body += planes
        at += sum(map(len, planes))
    documents = _stream(pa.RecordBatch.from_arrays([keys, pa.array(lengths, pa.int64())], ["id", "n_ids"]))
    chunks = _stream(
        pa.RecordBatch.from_arrays(
            [
                pa.array([b[0] for b in blocks], pa.int64()),
                pa.array([b[1] for b in blocks], pa.int64()),
                pa.array([b[2] for b in blocks], pa.list_(pa.int32())),
            ],
            ["at", "n_ids", "sizes"],
        )
    )
    head = {
        "part": part, "nth": nth, "bits": bits, "n_ids": len(flat), "n_documents": len(ids),
        "documents": [at, len(documents)], "blocks": [at + len(documents), len(chunks)],
    }
    told = json.dumps(head).encode()
    return b"".join([*body, documents, chunks, told, b"%010d" % len(told), MAGIC])


class PlaneFile:
    """Reads a file: its head, document table and chunk index; blocks when asked for."""

    def __init__(self, data: bytes):
        data = memoryview(data)
        end = len(data) - (_TAIL if data[-1:] == b"\n" else _TAIL - 1)
        if bytes(data[: len(MAGIC)]) != MAGIC or bytes(data[end + _DIGITS :]).rstrip(b"\n") != MAGIC:
            raise ValueError("not a file of id planes")
        size = int(bytes(data[end : end + _DIGITS]))
        self.data, self.head = data, json.loads(bytes(data[end - size : end]))
        part = lambda name: _table(bytes(data[self.head[name][0] : sum(self.head[name])]))
        documents, blocks = part("documents"), part("blocks")
        self.keys = documents.column("id").combine_chunks()
        self.lengths = documents.column("n_ids").to_numpy()
        self.blocks = blocks.to_pylist()
        self.starts = np.r_[0, np.cumsum(self.lengths)]
        self._kept: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def block(self, k: int) -> np.ndarray:
        if self._kept[0] != k:
            told, at, planes = self.blocks[k], self.blocks[k]["at"], []
            for size in told["sizes"]:
                planes.append(zstandard.decompress(bytes(self.data[at : at + size])))
                at += size
            self._kept = (k, from_planes(planes, told["n_ids"], self.head["bits"]))
        return self._kept[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` of this file on; only the blocks that hold them are read."""
        found = [
            self.block(k)[max(0, start - k * BLOCK) : start + n - k * BLOCK]
            for k in range(start // BLOCK, -(-(start + n) // BLOCK))
        ]
        return found[0] if len(found) == 1 else np.concatenate([np.zeros(0, "<u4"), *found])


# ---------------------------------------------------------------- encoding


_ID = attrgetter("id")
#: Writers of so many ids, for words of the usual lengths.
_PACKS = [Struct(f"<{n}I").pack for n in range(32)]


class _Known(dict):
    """Stretches of text and their ids; one not seen before is taken from ``older`` or encoded."""

    def __init__(self, encode, older: dict):
        super().__init__()
        self.encode, self.older = encode, older

    def __missing__(self, part: bytes) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = self.encode(part)
        self[part] = ids
        return ids


class ByteEncoder:
    """Ids of whole texts by a byte-level tokenizer, stretch by stretch.

    The tokenizer's pattern gives a blank before a sign to that sign's word, and a line break
    before a sign stands alone, whatever comes before; a full stop or comma between a letter
    and white space is a word by itself.  A text may thus be cut there; each stretch is encoded
    by the library once and remembered.  A text that has such a sign in any other place is cut
    before blanks and line breaks only.
    """

    #: A blank or line break that is not before a sign which is no white space in any reading
    #: (printable ASCII, accented Latin letters).
    _LOOSE = re.compile(rb"[ \n](?![!-~\xc3])")
    _CUT = re.compile(rb"(?=[ \n][!-~\xc3])")
    #: Stops and commas that may be part of a longer word.
    _INNER = re.compile(rb"(?<![A-Za-z0-9\x80-\xbf])[.,]|[.,](?![ \nA-Za-z]|\Z)|\xc3[\x97\xb7]")
    #: Texts of these bytes only can be loose in the following places only.
    _USUAL = bytes([0x0A, *range(0x20, 0x7F), *range(0x80, 0xC0), 0xC3])
    _PAIRS = (b"  ", b" \n", b"\n ", b"\n\n")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        told = json.loads(self.whole.to_str())
        cut, added = told["pre_tokenizer"] or {}, told["added_tokens"]
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex") or told["normalizer"]:
            raise ValueError("only a plain byte-level tokenizer may be cut at blanks")
        if any(t["lstrip"] or t["rstrip"] or set(t["content"]) & set(" \n.,") for t in added):
            raise ValueError("a special token that a cut may divide")
        self.special = [t["content"].encode() for t in added]
        self.model = self.whole.model
        keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        moved = (256 + k for k in range(256))
        self.signs = str.maketrans({b: chr(b) if b in keep else chr(next(moved)) for b in range(256)})
        self.known = _Known(self._stretch, {})

    def _stretch(self, part: bytes) -> bytes:
        r"""``part``: a word with a blank before it left out, or with \x01 where none is."""
        if part.isalpha():  # ASCII letters are their own signs
            ids = [*map(_ID, self.model.tokenize("Ġ" + part.decode()))]
        elif part[-1:] in (b".", b",") and self._letters(part[:-1]):
            return self.known[part[:-1]] + self.known[b"\x01" + part[-1:]]
        elif self._letters(part):
            ids = [*map(_ID, self.model.tokenize("Ġ" + part.decode("latin-1").translate(self.signs)))]
        else:
            bare = part[:1] == b"\x01"
            whole = part[1:] if bare else part if part[:1] == b"\n" else b" " + part
            ids = self.whole.encode(whole.decode("utf-8", "replace"), add_special_tokens=False).ids
        return _PACKS[len(ids)](*ids) if len(ids) < len(_PACKS) else struct_pack(f"<{len(ids)}I", *ids)

    @staticmethod
    def _letters(part: bytes) -> bool:
        """Whether ``part`` is one word of letters up to U+00FF."""
        if part.isascii():
            return part.isalpha()
        text = part.decode("utf-8", "replace")
        return text.isalpha() and max(text) < "\u0100"

    def __call__(self, text: bytes) -> bytes:
        """The ids as unsigned 32-bit little-endian numbers."""
        if len(self.known) > REMEMBER:  # words of the last stretch of texts stay known
            self.known = _Known(self._stretch, dict(self.known))
        if any(s in text for s in self.special):
            return self._stretch(b"\x01" + text)
        odd = text.translate(None, self._USUAL)
        if odd or text[-1:] in (b" ", b"\n") or any(p in text for p in self._PAIRS):
            if self._LOOSE.search(text) or b"\x01" in odd:
                first, *rest = self._CUT.split(text)
                parts = [s[1:] if s[:1] == b" " else s for s in rest]
                return (self.known[b"\x01" + first] if first else b"") + b"".join(map(self.known.__getitem__, parts))
        cut = text.replace(b"\n", b" \n")
        if not odd and not self._INNER.search(text):
            cut = cut.replace(b".", b" \x01.").replace(b",", b" \x01,")
        first, *rest = cut.split(b" ")
        return (self.known[b"\x01" + first] if first else b"") + b"".join(map(self.known.__getitem__, rest))


@cache
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


# ---------------------------------------------------------------- whole tables


def write_tokens(
    docs: DataFrame, tokenizer: str, folder: str, *, end_id: int = 0, bits: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Write the ids of all texts, each with ``end_id`` behind it, in ascending order of their
    ids below ``folder``: ``files`` and ``index``.

    A null text is empty.  Null ids come last.  Rows of one id are put in order of a hash of
    the text, then the text; repeated rows are documents of their own.  An empty table gives no
    file with content.  Further columns are ignored.
    """
    spark = docs.sparkSession

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = byte_encoder(tokenizer), TaskContext.get().partitionId()
        end = struct_pack("<I", end_id)
        keys: list[pa.Array] = []
        ids: list[bytes] = []
        size, nth = 0, 0

        def file() -> pa.RecordBatch:
            whole = file_bytes(ids, pa.concat_arrays(keys), part, nth, bits)
            return pa.RecordBatch.from_arrays([pa.array([whole], pa.large_binary())], ["content"])

        for rows, texts in groups(batches, "text"):
            at = 0
            for i, text in enumerate(texts):
                ids.append(encode(text) + end)
                size += len(ids[-1]) // 4
                if size >= FILE:
                    keys.append(rows.column(0).slice(at, i + 1 - at))
                    yield file()
                    keys, ids, size, nth, at = [], [], 0, nth + 1, i + 1
            if at < len(texts):
                keys.append(rows.column(0).slice(at))
        if ids:
            yield file()

    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"),
        # Repeated rows are alike; the number only lets a mass of them be cut anywhere.
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("id").asc_nulls_last(), F.col("mark"), F.col("row")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(order[0], "mark", "text")
    made = dealt.select("id", "text").mapInArrow(make, "content binary")
    # A record a file: the text writer puts down the bytes as they are, and a line end.
    made.select(F.col("content").cast("string")).write.option("maxRecordsPerFile", 1).text(f"{folder}/files")
    _index(spark, folder).write.parquet(f"{folder}/index")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{folder}/files").where("length > 1")


def _index(spark: SparkSession, folder: str) -> DataFrame:
    """path, part, nth, n_ids, n_documents, first (ids in all files before) of every file."""
    size = F.substring("content", -_TAIL, _DIGITS).cast("string").cast("int")
    head = F.expr(f"substring(content, -{_TAIL} - size, size)").cast("string")
    told = F.from_json("head", "part int, nth int, n_ids long, n_documents long")
    files = _files(spark, folder).withColumn("size", size).select("path", head.alias("head")).select("path", told.alias("h"))
    files = files.select("path", "h.*")
    # Few rows, one a task that wrote: the ids before each.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("all"))
    before = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    own = F.sum("n_ids").over(Window.partitionBy("part").orderBy("nth")) - F.col("n_ids")
    return files.withColumn("own", own).join(before, "part").select(
        "path", "part", "nth", "n_ids", "n_documents", (F.col("before") + F.col("own")).alias("first")
    )


def read_documents(spark: SparkSession, folder: str, id_type: T.DataType, *, ids: bool = True) -> DataFrame:
    """id, start, n_tokens, ids_crc32 and, if asked for, ids of every document in the files.

    start: ids of all documents before it.  ids_crc32: unsigned crc32 of the ids as unsigned
    32-bit little-endian numbers.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                file = PlaneFile(data.as_buffer())
                n = len(file.lengths)
                step = max(1, n * (1 << 20) // max(1, int(file.starts[-1])))  # about a million ids a batch
                for at in range(0, n, step):
                    to = min(n, at + step)
                    own = [file.ids(int(s), int(k)) for s, k in zip(file.starts[at:to], file.lengths[at:to])]
                    columns = [
                        file.keys.slice(at, to - at),
                        pa.array(np.full(to - at, file.head["part"], np.int32)),
                        pa.array(np.full(to - at, file.head["nth"], np.int32)),
                        pa.array(file.starts[at:to]),
                        pa.array(file.lengths[at:to]),
                        pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                    ]
                    names = ["id", "part", "nth", "at", "n_tokens", "ids_crc32"]
                    if ids:
                        columns.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType(
        [
            T.StructField("id", id_type),
            *(T.StructField(c, T.IntegerType()) for c in ("part", "nth")),
            *(T.StructField(c, T.LongType()) for c in ("at", "n_tokens", "ids_crc32")),
            *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []),
        ]
    )
    rows = _files(spark, folder).select("content").mapInArrow(read, schema)
    index = spark.read.parquet(f"{folder}/index").select("part", "nth", "first")
    found = rows.join(index, ["part", "nth"]).withColumn("start", F.col("first") + F.col("at"))
    return found.select("id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def read_span(spark: SparkSession, folder: str, start: int, n: int) -> DataFrame:
    """place, id of the ids from place ``start`` on, ``n`` at most: what a training step reads.

    The index names the files, and only their blocks that hold the span are decompressed.
    """
    to = start + n
    index = spark.read.parquet(f"{folder}/index").where((F.col("first") < to) & (F.col("first") + F.col("n_ids") > start))
    paths = {(r.part, r.nth): (r.path, r.first) for r in index.collect()}  # files of one span
    firsts = {k: v[1] for k, v in paths.items()}

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                file = PlaneFile(data.as_buffer())
                first = firsts[file.head["part"], file.head["nth"]]
                at = max(0, start - first)
                own = file.ids(at, min(file.head["n_ids"], to - first) - at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(own)) + first + at), pa.array(own.astype(np.int32))], ["place", "id"]
                )

    if not paths:
        return spark.createDataFrame([], "place long, id int")
    files = spark.read.format("binaryFile").load([p for p, _ in paths.values()])
    return files.select("content").mapInArrow(read, "place long, id int")


def token_report(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files of ``docs`` below the shared folder and read every document back:
    its id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/planes-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer, folder, id_col=id_col, text_col=text_col)
    back = read_documents(spark, folder, docs.schema[id_col].dataType, ids=False)
    return back.withColumnRenamed("id", id_col)
