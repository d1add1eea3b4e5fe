"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so, so equal passages give equal chunks
wherever they stand.  The chunk table holds every distinct chunk once and verifies
that an identifier stands for one content; a document is from then on the ordered
list of its chunk identifiers, and only these short lists are grouped and joined.
Text crosses the network once, per distinct chunk and map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelfield.session import materialise

#: At least 256 characters, then up to the first white space after n, s, t or a full
#: stop; 4,096 characters at most.  The second branch takes what has no such place.
BOUNDARY = r"(?s).{256,4096}?[nst.]\s|.{1,4096}"


def chunks(text: Column) -> Column:
    """The chunks of a text in order; joined they are the text again.  Empty: none."""
    return F.regexp_extract_all(text, F.lit(BOUNDARY), F.lit(0))


def identifier(chunk: Column) -> Column:
    """192 bits: a 64-bit hash to deal by, and a digest."""
    return F.struct(F.xxhash64(chunk).alias("h"), F.unhex(F.md5(chunk)).alias("m"))


def verified(texts: DataFrame) -> DataFrame:
    """One row per chunk identifier: h, m, contents (distinct contents, must be 1).

    ``texts`` has a column ``text``.  Equal chunks of a map task are merged before
    the shuffle, so a passage that a third of the documents share moves once a task.
    """
    contents = (
        texts.select(F.explode(chunks(F.col("text"))).alias("chunk"))
        .groupBy(F.xxhash64("chunk").alias("h"), "chunk")
        .agg(F.lit(1).alias("one"))
    )
    return contents.groupBy("h", F.unhex(F.md5("chunk")).alias("m")).agg(
        F.count("*").alias("contents")
    )


def verify(texts: DataFrame) -> None:
    """Raise if one identifier stands for two contents, so recipes would not be exact."""
    clash = verified(texts).where("contents > 1").limit(1).count()
    if clash:
        raise ValueError("two chunks of different content share one identifier")


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty.  Of equal texts the
    largest id stays.  Null ids never stay beside an id; in a group of null ids only,
    keep_id is null and all are kept.  Rows that repeat one id and text are the same
    document: each counts in group_size and gets the same answer.  An empty table gives
    no rows; further columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    verify(rows)
    recipes = materialise(
        rows.select(
            "id",
            F.sha2("text", 256).alias("text_sha256"),
            F.transform(chunks(F.col("text")), identifier).alias("recipe"),
        ),
        "recipes",
    )
    # Written, so that the join below has plain exchanges on both sides and a recipe with
    # a third of all rows is split.
    groups = materialise(
        recipes.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")),
        "recipe-groups",
    )
    return recipes.join(groups, "recipe").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
