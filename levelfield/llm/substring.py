"""Substring deduplication with prefix-partitioned suffix trees over words.

1. Every run of ``min_words`` words has an anchor, the smallest hash among its shorter word
   runs; equal runs have equal anchors.  Anchors that occur in one document only rule out
   the runs they stand for.  This loses nothing and leaves the repeated passages.
2. What is left of a document are segments of consecutive candidate runs.  Equal segments
   are one string of the generalised suffix tree, with the smallest id among its documents.
3. The suffixes of the segments, to the depth of ``min_words`` words, are dealt to subtrees
   by prefix.  A prefix is one word; where a prefix holds more suffixes than a group should,
   it is made longer, and a suffix that is hot to its full depth is salted.
4. A subtree is its sorted suffixes and the common prefixes of neighbours.  The leaves below
   an internal node at full depth share a repeated passage; all but those of the smallest id
   are later copies.  Neighbouring copies join to maximal repeats when spans are merged.

Between the steps the small results are written, and shuffle files of finished steps are
given back.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levelfield.llm.words import Words, grams, groups, mix, run_starts
from levelfield.session import materialise

MIN_WORDS = 13
_LAST = (1 << 63) - 1  # where a null id stands in the order
#: Suffixes a prefix should hold at most before it is made longer, and the number of such
#: prefixes the driver ever holds, which raises the first figure on very large inputs.
GROUP_ROWS, MOST_HOT = 50_000, 10_000
#: Ways a suffix is dealt that is hot to its full depth.
SALTS = 64
#: Turns in which the subtrees are built, a share of the prefixes each, so that no more
#: than this share of all suffixes lies in shuffle files at a time.
TURNS = 4


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner give back the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _window_anchors(words: Words, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word of each run of ``min_words`` words, and the run's anchor."""
    part = max(1, min_words // 2)
    starts = run_starts(words, min_words)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    low = mix(grams(words.hash, part))
    width = min_words - part + 1  # part-word runs in a window
    have = 1
    while have < width:  # sliding minimum by doubling
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return starts, low[starts]


def _fresh(anchor: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Where a run has another anchor, or another text, than the one before it."""
    return np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])][: len(anchor)]


def _prefix_lengths(min_words: int) -> list[int]:
    return sorted({1, max(1, min_words // 4), max(1, min_words // 2), min_words})


def _anchors(rows: DataFrame, min_words: int) -> DataFrame:
    """h, id: the anchors of each document, mostly once."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in groups(batches, "text"):
            words = Words(texts)
            starts, anchor = _window_anchors(words, min_words)
            owner = words.text_of[starts]
            fresh = _fresh(anchor, owner)
            ids = batch.column(0).to_numpy()[owner[fresh]]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[fresh].view(np.int64)), pa.array(ids)], ["h", "id"])

    return rows.select("id", "text").mapInArrow(make, "h long, id long")


def _segments(candidates: DataFrame, min_words: int) -> DataFrame:
    """id, t, at, n, text: runs of consecutive windows whose anchor is in ``anchors``.

    ``at`` is the segment's first word, ``n`` its words, ``text`` these joined by blanks.
    """

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in groups(batches, "text"):
            words = Words(texts)
            starts, anchor = _window_anchors(words, min_words)
            owner = words.text_of[starts]
            known = batch.column(batch.schema.get_field_index("anchors"))
            wanted = known.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
            # One lookup for all texts: anchors are made the text's own before comparing.
            # Neighbouring runs mostly share theirs, so each is looked up once.
            own = mix(np.arange(1, len(texts) + 1))
            heads = np.flatnonzero(_fresh(anchor, owner))
            wanted ^= np.repeat(own, pc.list_value_length(known).to_numpy())
            hit = np.isin(anchor[heads] ^ own[owner[heads]], wanted)
            hit = np.repeat(hit, np.diff(np.r_[heads, len(anchor)]))
            starts, owner = starts[hit], owner[hit]
            opens = np.flatnonzero(np.r_[True, (np.diff(starts) != 1) | (np.diff(owner) != 0)][: len(starts)])
            closes = np.r_[opens[1:], len(starts)][: len(opens)] - 1
            first, last = starts[opens], starts[closes] + min_words - 1
            data = words.data.tobytes()
            content = [
                b" ".join(data[s:e].split()) for s, e in zip(words.start[first].tolist(), words.end[last].tolist())
            ]
            of = pa.array(owner[opens])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(of),
                    batch.column(1).take(of),
                    pa.array((first - words.first[owner[opens]]).astype(np.int64)),
                    pa.array((last - first + 1).astype(np.int64)),
                    pa.array(content, pa.binary()).cast(pa.string()),
                ],
                ["id", "t", "at", "n", "text"],
            )

    return candidates.select("id", "t", "text", "anchors").mapInArrow(
        make, "id long, t long, at long, n long, text string"
    )


def _suffix_groups(batches: Iterable[pa.RecordBatch], min_words: int) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray]]:
    """Segment rows with their words and the words at which a suffix of full depth begins."""
    for batch, texts in groups(batches, "text"):
        words = Words(texts)
        yield batch, words, run_starts(words, min_words)


def _prefix_counts(segments: DataFrame, min_words: int, length: int, hot: dict[int, set[int]]) -> DataFrame:
    """prefix, n: suffixes under each prefix of ``length`` words, counted only below the
    hot prefixes of the next shorter length."""
    shorter = max((k for k in hot), default=0)
    above = np.array(sorted(hot.get(shorter, ())), np.uint64)

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, starts in _suffix_groups(batches, min_words):
            if shorter:
                starts = starts[np.isin(grams(words.hash, shorter)[starts], above)]
            prefix, n = np.unique(grams(words.hash, length)[starts], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(prefix.view(np.int64)), pa.array(n.astype(np.int64))], ["prefix", "n"])

    return segments.select("text").mapInArrow(make, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n"))


def _hot_prefixes(segments: DataFrame, min_words: int) -> dict[int, set[int]]:
    """Per prefix length the prefixes that hold too many suffixes and go on being split."""
    total = segments.agg(F.sum(F.col("n") - (min_words - 1))).first()[0] or 0
    most = max(GROUP_ROWS, total // MOST_HOT)
    hot: dict[int, set[int]] = {}
    for length in _prefix_lengths(min_words):
        found = _prefix_counts(segments, min_words, length, hot).where(F.col("n") > most).select("prefix").collect()
        if not found:
            break
        hot[length] = {r[0] & 0xFFFFFFFFFFFFFFFF for r in found}
    return hot


def _suffixes(segments: DataFrame, min_words: int, hot: dict[int, set[int]], turn: int) -> DataFrame:
    """key, suffix, id, s, off, salted: the suffixes of a turn, dealt by their prefixes."""
    lengths = _prefix_lengths(min_words)
    tables = {k: np.array(sorted(v), np.uint64) for k, v in hot.items()}

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, starts in _suffix_groups(batches, min_words):
            owner = words.text_of[starts]
            key = mix(grams(words.hash, lengths[0])[starts])
            salted = np.zeros(len(starts), bool)
            for shorter, length in zip(lengths, [*lengths[1:], None]):
                if shorter not in tables:
                    break
                own = grams(words.hash, shorter)[starts]
                full = np.isin(own, tables[shorter])
                if length is not None:
                    key = np.where(full, mix(grams(words.hash, length)[starts] + np.uint64(length)), key)
                else:
                    salted = full
                    salt = mix(owner.astype(np.uint64) + words.hash[words.first[owner]]) % np.uint64(SALTS)
                    key = np.where(full, mix(own + salt + np.uint64(1)), key)
            mine = (key >> np.uint64(32)) % np.uint64(TURNS) == turn
            starts, owner, key, salted = starts[mine], owner[mine], key[mine], salted[mine]
            data = words.data.tobytes()
            last = words.end[starts + min_words - 1]
            suffix = [data[s:e] for s, e in zip(words.start[starts].tolist(), last.tolist())]
            of = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key.view(np.int64)),
                    pa.array(suffix, pa.binary()),
                    batch.column(1).take(of),
                    batch.column(2).take(of),
                    pa.array((starts - words.first[owner]).astype(np.int32)),
                    pa.array(salted),
                ],
                ["key", "suffix", "id", "s", "off", "salted"],
            )

    return segments.select("text", "id", "s").mapInArrow(
        make, "key long, suffix binary, id long, s binary, off int, salted boolean"
    )


def _later_leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted suffixes (key, suffix, id, ...) the leaves that are later copies, and
    the first leaves of salted nodes, which another salt may still precede.

    Suffixes end at full depth, so neighbours share an internal node at that depth when
    they are equal, and ids ascend below a node: its smallest id comes first.
    """
    node: tuple[int, bytes] | None = None
    least = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        suffix, ids, key = batch.column("suffix"), batch.column("id").to_numpy(), batch.column("key").to_numpy()
        goes_on = np.zeros(batch.num_rows, bool)
        goes_on[1:] = pc.equal(suffix.slice(1), suffix.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        goes_on[1:] &= key[1:] == key[:-1]
        goes_on[0] = (key[0], suffix[0].as_py()) == node
        heads = np.flatnonzero(~goes_on)
        first = np.r_[least if goes_on[0] else 0, ids[heads]] if goes_on[0] else ids[heads]
        low = first[np.cumsum(~goes_on) - (0 if goes_on[0] else 1)]
        later = ids > low
        keep = later | (batch.column("salted").to_numpy(zero_copy_only=False) & ~goes_on)
        node, least = (key[-1], suffix[batch.num_rows - 1].as_py()), int(low[-1])
        if keep.any():
            rows = pa.array(np.flatnonzero(keep))
            out = [batch.column(c).take(rows) for c in ("suffix", "id", "s", "off")]
            plain = pa.array(later[keep])
            out[0] = pc.if_else(plain, pa.scalar(None, pa.binary()), out[0])
            yield pa.RecordBatch.from_arrays([*out, plain], ["suffix", "id", "s", "off", "later"])


_LEAVES = "suffix binary, id long, s binary, off int, later boolean"


def _subtrees(suffixes: DataFrame) -> DataFrame:
    """Later leaves of all subtrees; Spark sorts each task's suffixes, on disk if need be."""
    return (
        suffixes.repartition("key")
        .sortWithinPartitions("key", "suffix", "id")
        .mapInArrow(_later_leaves, _LEAVES)
    )


def repeated_spans(docs: DataFrame, *, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """id, t, spans: word spans (at, n) of later copies in each document that has any.

    id is the id, or the largest long where it is null; t is XXH64 of the text.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(text).alias("t"), text.alias("text")
    )
    anchors = _anchors(rows, min_words)
    shared = materialise(
        anchors.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("h"),
        "shared-anchors",
    )
    release(spark)
    by_doc = materialise(
        anchors.join(shared, "h", "left_semi").groupBy("id").agg(F.collect_set("h").alias("anchors")), "document-anchors"
    )
    release(spark)
    found = materialise(_segments(rows.join(by_doc, "id"), min_words), "segments")
    release(spark)
    members = found.select("id", "t", "at", "n", F.unhex(F.md5("text")).alias("s"))
    distinct = materialise(
        found.groupBy("text").agg(F.min("id").alias("id"), F.min("n").alias("n")).withColumn("s", F.unhex(F.md5("text"))),
        "distinct-segments",
    )
    release(spark)
    hot = _hot_prefixes(distinct, min_words)
    leaves = None
    for turn in range(TURNS):
        found = materialise(_subtrees(_suffixes(distinct, min_words, hot, turn)), "leaves")
        leaves = found if leaves is None else leaves.unionByName(found)
        release(spark)
    again = leaves.where("NOT later").select(
        F.xxhash64("suffix").alias("key"), "suffix", "id", "s", "off", F.lit(False).alias("salted")
    )
    later = leaves.where("later").select("s", "off").unionByName(_subtrees(again).select("s", "off"))
    copies = materialise(later.groupBy("s").agg(F.sort_array(F.collect_list("off")).alias("offs")), "later-leaves")
    release(spark)
    firsts = distinct.select("s", F.col("id").alias("first_id"))
    joined = members.join(firsts, "s").join(copies, "s", "left")
    spans = joined.select(
        "id",
        "t",
        F.when(F.col("id") > F.col("first_id"), F.array(F.struct(F.col("at").alias("at"), F.col("n").alias("n"))))
        .otherwise(
            F.transform(
                "offs", lambda o: F.struct((F.col("at") + o).alias("at"), F.lit(min_words).cast("long").alias("n"))
            )
        )
        .alias("spans"),
    ).where("spans IS NOT NULL")
    return spans.groupBy("id", "t").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _bounds(spans: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row the first words and the lengths of its spans (null: none)."""
    flat = spans.flatten()
    at, n = (pc.struct_field(flat, f).to_numpy(zero_copy_only=False) for f in ("at", "n"))
    ends = np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)).tolist()
    for lo, hi in zip([0, *ends], ends):
        yield at[lo:hi], n[lo:hi]


def _cut(text: bytes, at: np.ndarray, n: np.ndarray) -> tuple[int, int, bytes]:
    """Words, removed words, and the kept words joined by one blank."""
    words = text.split()
    if not len(at):
        return len(words), 0, b" ".join(words)
    edge = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + n, minlength=len(words) + 1)
    stays = np.cumsum(edge[:-1]) == 0
    return len(words), len(words) - int(stays.sum()), b" ".join(compress(words, stays.tolist()))


def _with_spans(docs: DataFrame, id_col: str, text_col: str, min_words: int, columns: list) -> DataFrame:
    """``columns`` of every input row and the spans to remove."""
    spans = materialise(repeated_spans(docs, id_col=id_col, text_col=text_col, min_words=min_words), "spans")
    release(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        *columns,
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"),
        F.xxhash64(text).alias("t"),
    )
    return rows.join(spans, ["id", "t"], "left").drop("id", "t")


def substring_report(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256.

    Words are runs other than white space (0x20, 0x09-0x0D).  A word goes if it is in a run
    of ``min_words`` words whose sequence also starts in a document with a smaller id, in
    the input.  A null id is larger than any other; rows that share an id never remove each
    other's words.  A null text has no words.  An empty table gives no rows; further columns
    are ignored.
    """
    joined = _with_spans(docs, id_col, text_col, min_words, [F.col(id_col).alias("doc"), F.col(text_col).alias("text")])

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in groups(batches, "text"):
            cut = [_cut(t, *own) for t, own in zip(texts, _bounds(batch.column(2)))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([c[0] for c in cut], pa.int64()),
                    pa.array([c[1] for c in cut], pa.int64()),
                    pa.array([hashlib.sha256(c[2]).hexdigest() for c in cut], pa.string()),
                ],
                [id_col, "n_words", "n_removed", "kept_sha256"],
            )

    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_sha256", T.StringType()),
        ]
    )
    return joined.select("doc", "text", "spans").mapInArrow(make, schema)


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """The input with later copies of repeated passages cut out of the text.

    A text that loses words is its other words joined by one blank, any other text is
    unchanged, a null text stays null.  No row is dropped; see substring_report for what is
    removed.
    """
    joined = _with_spans(docs, id_col, text_col, min_words, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")])

    @F.arrow_udf("string")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        raw = text.cast(pa.large_binary()).to_pylist()
        kept = [None if t is None else _cut(t, *own)[2] for t, own in zip(raw, _bounds(spans))]
        return pa.array(kept, pa.binary()).cast(pa.string())

    # Only texts that lose words go to Python; all others are taken from their row.
    text, spans = F.col("row")[text_col], F.col("spans")
    kept = F.when(spans.isNull(), text).otherwise(cut(F.when(spans.isNotNull(), text), spans))
    done = joined.select("row", kept.alias("kept"))
    return done.select(
        *[F.col("kept").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    )
