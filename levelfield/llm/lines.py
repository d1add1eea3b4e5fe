"""Line deduplication over a suffix array of line-ID sequences.

The suffixes of all documents, as sequences of line IDs, are ranked by distributed prefix
doubling: round k ranks them by their first 2^k lines from the ranks of round k - 1 at the
same place and 2^(k-1) lines on.  A suffix whose first 2^k lines occur nowhere else can
share no longer run, so it leaves; the rest of equal rank are an interval of the suffix
array whose longest common prefix is at least 2^k lines.  The earliest member of such an
interval is the original, every other one begins a later copy.  Runs of any length in between
are told by two ranks that overlap.  Each later copy's deepest interval names its source,
copies that continue each other make a maximal run, and the lines of runs that are long
enough, in lines or in characters, are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from levelfield.session import materialise

_LAST = (1 << 63) - 1  # where a null id stands in the order
_BLANK = r"^[\x20\x09-\x0D]*$"
_DOC = ["id", "t"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (all input columns), id, t: the document and its place in the order."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"),
    )


def _by_line(keyed: DataFrame, text_col: str) -> DataFrame:
    """id, t, lines."""
    return keyed.select("id", "t", _lines(F.col("row")[text_col]).alias("lines"))


def _content(lines: Column) -> Column:
    """Indices of the lines that hold more than white space."""
    return F.filter(
        F.transform(lines, lambda x, i: F.when(~x.rlike(_BLANK), i)), lambda i: i.isNotNull()
    )


def _ranked(classes: DataFrame, keys: list[str]) -> DataFrame:
    """``classes`` with r, their place in the order of ``keys`` over all partitions.

    Range partitions are sorted each for itself and numbered on from the rows before them,
    so no task sees all classes.
    """
    spread = classes.repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = materialise(
        spread.withColumns(
            {"part": F.spark_partition_id(), "nth": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}
        ),
        "classes",
    )
    sizes = numbered.groupBy("part").agg(F.count("*").alias("size"))
    before = materialise(
        sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before")), "before"
    )
    return numbered.join(before, "part").withColumn("r", F.col("before") + F.col("nth")).drop("part", "nth", "before")


def _suffixes(docs: DataFrame, place: Column, sums: int) -> DataFrame:
    """Round 0: id, t, pos, r, first, sums for the lines that occur more than once.

    sums: the characters of the first 1 to ``sums`` lines from here, as far as they are in.
    """
    told = lambda i: F.struct(
        F.unhex(F.md5(F.get("lines", i))).alias("line"), F.char_length(F.get("lines", i)).alias("chars")
    )
    lines = docs.select("id", "t", F.posexplode(F.transform(_content(F.col("lines")), told))).select(
        "id", "t", "pos", "col.line", "col.chars"
    )
    classes = (
        lines.groupBy("line")
        .agg(F.count("*").alias("n"), F.min(place).alias("first"))
        .where("n > 1")
        .select("line", "first")
    )
    ranked = _ranked(classes, ["line"])
    found = lines.join(ranked, "line")
    ahead = Window.partitionBy(*_DOC).orderBy("pos")
    # Rows that repeat an id and text hold the same lines at the same places.
    chars = [F.coalesce(F.max("chars").over(ahead.rangeBetween(k, k)), F.lit(0)) for k in range(sums)]
    so_far = [sum(chars[1 : k + 1], chars[0]) for k in range(sums)]
    return found.select("id", "t", "pos", "r", "first", F.array(*so_far).cast("array<bigint>").alias("sums"))


def levels(docs: DataFrame, sums: int = 0) -> list[DataFrame]:
    """Per round k the suffixes whose first 2^k lines occur again: id, t, pos, r, first, sums.

    ``first`` is the earliest place (id, t, pos) of the same lines.  Every round is written
    to the shared folder, and is smaller than the one before.
    """
    place = F.struct("id", "t", "pos")
    state = materialise(_suffixes(docs, place, sums), "suffixes")
    found = []
    while state.limit(1).count():
        found.append(state)
        step = 1 << (len(found) - 1)
        ahead = Window.partitionBy(*_DOC).orderBy("pos").rangeBetween(step, step)
        pairs = (
            state.select("id", "t", "pos", "sums", F.col("r").alias("r1"), F.max("r").over(ahead).alias("r2"))
            .where("r2 IS NOT NULL")
        )
        pairs = materialise(pairs, "pairs")
        classes = (
            pairs.groupBy("r1", "r2")
            .agg(F.count("*").alias("n"), F.min(place).alias("first"))
            .where("n > 1")
            .select("r1", "r2", "first")
        )
        ranked = _ranked(classes, ["r1", "r2"])
        state = materialise(pairs.join(ranked, ["r1", "r2"]).select("id", "t", "pos", "r", "first", "sums"), "suffixes")
    return found


def _earlier(level: DataFrame, lines: int, width: int) -> DataFrame:
    """id, t, pos, first, sums of the later copies of runs of ``lines`` lines, from the ranks of
    their first and their last ``width`` lines."""
    here = F.struct("id", "t", "pos") != F.col("first")
    if lines == width:
        return level.where(here)
    ahead = Window.partitionBy(*_DOC).orderBy("pos").rangeBetween(lines - width, lines - width)
    pairs = level.select("id", "t", "pos", "sums", "r", F.max("r").over(ahead).alias("r2")).where("r2 IS NOT NULL")
    pairs = materialise(pairs, "pairs")
    first = pairs.groupBy("r", "r2").agg(F.min(F.struct("id", "t", "pos")).alias("first"), F.count("*").alias("n"))
    return pairs.join(first.where("n > 1").drop("n"), ["r", "r2"]).where(here)


def repeated_runs(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 1, min_chars: int | None = None
) -> DataFrame:
    """Maximal runs of lines that occur earlier: id, t, start, lines, source.

    ``start`` counts the document's lines with content from 0; ``source`` is the place
    (id, t, pos) the run is a copy of, the one that shares the longest prefix of 2^k lines,
    the earliest of these.  A run has ``min_lines`` lines or more, or ``min_chars`` characters.
    """
    if min_lines < 1:
        raise ValueError("a run has a line or more")
    return _runs(_by_line(_keys(docs, id_col, text_col), text_col), min_lines, min_chars)


def _runs(keyed: DataFrame, min_lines: int, min_chars: int | None) -> DataFrame:
    """Any run that is long enough is made up of runs of ``min_lines`` lines, or is a shorter one
    of ``min_chars`` characters; longer ones, in powers of two, only name the source."""
    found = levels(keyed, 0 if min_chars is None else min_lines - 1)
    copies = None
    shorter = [] if min_chars is None else range(1, min_lines)
    longer = [1 << k for k in range(len(found)) if 1 << k > min_lines]
    for lines in [*shorter, min_lines, *longer]:
        k = lines.bit_length() - 1
        if k >= len(found):
            break
        later = _earlier(found[k], lines, 1 << k)
        if lines < min_lines:
            later = later.where(F.get("sums", F.lit(lines - 1)) >= min_chars)
        later = later.select("id", "t", "pos", F.struct(F.lit(lines).alias("lines"), "first").alias("copy"))
        copies = later if copies is None else copies.unionByName(later)
    if copies is None:
        spark = keyed.sparkSession
        return spark.createDataFrame(
            [], "id long, t long, start int, lines int, source struct<id:long,t:long,pos:int>"
        )
    deepest = copies.groupBy("id", "t", "pos").agg(F.max("copy").alias("copy"))
    rows = deepest.select(
        "id",
        "t",
        "pos",
        (F.col("pos") + F.col("copy.lines")).alias("end"),
        F.col("copy.first").alias("source"),
        F.col("copy.first.id").alias("source_id"),
        F.col("copy.first.t").alias("source_t"),
        (F.col("copy.first.pos") - F.col("pos")).alias("shift"),
    )
    same = Window.partitionBy("id", "t", "source_id", "source_t", "shift").orderBy("pos")
    past = same.rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumn("opens", (F.col("pos") > F.coalesce(F.max("end").over(past), F.lit(-1))).cast("int"))
    numbered = marked.withColumn("run", F.sum("opens").over(same))
    return numbered.groupBy("id", "t", "source_id", "source_t", "shift", "run").agg(
        F.min("pos").alias("start"),
        (F.max("end") - F.min("pos")).alias("lines"),
        F.min_by("source", "pos").alias("source"),
    ).select("id", "t", "start", "lines", "source")


def _merged(runs: DataFrame) -> DataFrame:
    """id, t, start, end: the lines of each document's runs, as intervals that do not touch.

    Runs of different shifts overlap: in a text that repeats one line every line begins its
    own run, so the runs of a document may hold the square of its lines.
    """
    by_start = Window.partitionBy(*_DOC).orderBy("start")
    past = by_start.rowsBetween(Window.unboundedPreceding, -1)
    ends = runs.select(*_DOC, "start", (F.col("start") + F.col("lines")).alias("end"))
    marked = ends.withColumn("opens", (F.col("start") > F.coalesce(F.max("end").over(past), F.lit(-1))).cast("int"))
    numbered = marked.withColumn("nth", F.sum("opens").over(by_start))
    return numbered.groupBy(*_DOC, "nth").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("nth")


def _cleaned(docs: DataFrame, id_col: str, text_col: str, min_lines: int, min_chars: int | None) -> DataFrame:
    """row, content (indices of lines with content), kept (text), removed (how many)."""
    keyed = _keys(docs, id_col, text_col)
    runs = _runs(_by_line(keyed, text_col), min_lines, min_chars)
    # Apart from each other, the intervals hold no more lines than the document.
    inside = F.transform(F.collect_list(F.struct("start", "end")), lambda r: F.sequence(r["start"], r["end"] - 1))
    gone = materialise(_merged(runs).groupBy(*_DOC).agg(F.flatten(inside).alias("gone")), "removed-lines")
    # Texts cross the network as they are and are split behind the join.  The list of lines
    # grows with the texts, so the join is the same at every size.
    joined = keyed.join(gone.hint("merge"), _DOC, "left").withColumn("lines", _lines(F.col("row")[text_col]))
    joined = joined.withColumn("content", _content(F.col("lines")))
    lost = F.transform(F.coalesce("gone", F.array().cast("array<int>")), lambda p: F.get("content", p))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), lost)
    return joined.select(
        "row",
        "content",
        F.when(F.col("gone").isNull(), F.array_join("lines", "\n"))
        .otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
        .alias("kept"),
        F.size(lost).alias("removed"),
    )


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 1, min_chars: int | None = None
) -> DataFrame:
    """The input with later copies of repeated line runs deleted from the text.

    Lines are split at line breaks and compared unchanged.  Lines of white space only take
    no part: they neither begin, end nor break a run, and stay.  Of equal runs of at least
    ``min_lines`` lines, or fewer that together have ``min_chars`` characters, the one with the
    smallest (id, text hash, line) stays; a null id comes last.  Shorter copies stay.  Rows that repeat one id and text are one document and get
    the same text.  A null text stays null, a text that loses every line becomes empty, no
    row is dropped.  An empty table gives no rows; further columns pass unchanged, whatever
    their names.
    """
    done = _cleaned(docs, id_col, text_col, min_lines, min_chars)
    return done.select(
        *[
            F.when(F.col("row")[c].isNotNull(), F.col("kept")).alias(c) if c == text_col else F.col("row")[c].alias(c)
            for c in docs.columns
        ]
    )


def line_report(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 1, min_chars: int | None = None
) -> DataFrame:
    """One row per input row: id, n_lines (with content), n_removed, kept_text."""
    done = _cleaned(docs, id_col, text_col, min_lines, min_chars)
    return done.select(
        F.col("row")[id_col].alias(id_col),
        F.size("content").cast("long").alias("n_lines"),
        F.col("removed").cast("long").alias("n_removed"),
        F.col("kept").alias("kept_text"),
    )
