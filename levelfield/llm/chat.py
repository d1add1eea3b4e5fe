r"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a rendered conversation::

    conversation = turn*
    turn         = "### " role ":" " " text "</turn>" "\n"

In roles and texts ``\`` quotes the next character: ``\n`` inside a role is a line
break, any other quoted character is itself.  The parser is deterministic: a role ends
at the first unquoted ``: ``, a text at the first unquoted ``</turn>`` and line break.

A conversation is rendered, parsed again and compared with its source.  Turns go in as
they are first; the turns whose reading differs from the source are escaped, then all
of them, and a conversation that still differs raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MID, CLOSE = "### ", ": ", "</turn>\n"
#: One turn of the grammar: role, then text, each a run of quoted or plain characters.
#: Possessive, so that a long text needs no stack and is never scanned twice.
TURN = r"(?s)\G### ((?:[^\\:]|\\.|:(?! ))*+): ((?:[^\\<]++|\\.|<(?!/turn>\n))*+)</turn>\n"
TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    r"""Quote ``\`` and whatever could read as the end of a text."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("</turn>"), F.lit("\\</turn>"))


def escape_role(role: Column) -> Column:
    r"""Quote ``\`` and ``:``."""
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render_turn(turn: Column, quoted: Column) -> Column:
    """``turn`` as text; its text is escaped where ``quoted`` is true."""
    text = F.when(quoted, escape(turn["text"])).otherwise(turn["text"])
    return F.concat(F.lit(OPEN), escape_role(turn["role"]), F.lit(MID), text, F.lit(CLOSE))


def blocks(formatted: Column) -> Column:
    """The rendered turns, in order, as the parser cuts them."""
    return F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation; nothing else may stand in it."""
    roles = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1))
    texts = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))
    return F.zip_with(
        roles, texts, lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text"))
    )


def _same(formatted: Column, turns: Column) -> Column:
    """Whether ``formatted`` reads back as ``turns`` and as nothing besides."""
    return (parse(formatted) == turns) & (F.array_join(blocks(formatted), "") == formatted)


def _render(turns: Column, quoted) -> Column:
    return F.array_join(F.transform(turns, lambda t: render_turn(t, quoted(t))), "")


def format_conversations(
    turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: its id, formatted, attempt, turns (as read back).

    Rows are put in order of turn, then role, then text; null turns come first.  A null
    role or text is empty.  Repeated rows are turns of their own.  A null id is a
    conversation like any other.  An empty table gives no rows.
    """
    rows = turns.select(
        F.col(id_col).alias("id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("row"),
    )
    source = rows.groupBy("id").agg(F.sort_array(F.collect_list("row")).alias("rows")).select(
        "id",
        F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("source"),
    )
    alone = lambda t: ~_same(render_turn(t, F.lit(False)), F.array(t))
    attempts = source.select(
        "id",
        "source",
        _render(F.col("source"), lambda t: F.lit(False)).alias("plain"),
    ).withColumn("plain_ok", _same(F.col("plain"), F.col("source")))
    attempts = attempts.withColumn(
        "some", F.when(~F.col("plain_ok"), _render(F.col("source"), alone))
    ).withColumn("some_ok", F.coalesce(_same(F.col("some"), F.col("source")), F.lit(False)))
    attempts = attempts.withColumn(
        "all",
        F.when(~F.col("plain_ok") & ~F.col("some_ok"), _render(F.col("source"), lambda t: F.lit(True))),
    )
    chosen = attempts.select(
        "id",
        "source",
        F.when(F.col("plain_ok"), F.col("plain")).when(F.col("some_ok"), F.col("some")).otherwise(F.col("all")).alias("formatted"),
        F.when(F.col("plain_ok"), 0).when(F.col("some_ok"), 1).otherwise(2).alias("attempt"),
    )
    return chosen.select(
        F.col("id").alias(id_col),
        "formatted",
        "attempt",
        F.when(_same(F.col("formatted"), F.col("source")), parse(F.col("formatted")))
        .otherwise(F.raise_error(F.lit("a conversation does not read back as its source")).cast(TURNS))
        .alias("turns"),
    )


def loss_spans(formatted: Column, role: str = "assistant") -> Column:
    """Array of (start, length) in ``formatted``, in code points: the texts to learn from."""
    heads = F.transform(
        blocks(formatted),
        lambda b: F.struct(
            F.char_length(b).alias("size"),
            F.char_length(F.regexp_extract(b, TURN, 1)).alias("role_size"),
            (unescape(F.regexp_extract(b, TURN, 1)) == role).alias("learn"),
        ),
    )
    zero = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")
    )

    def step(state, head):
        before = head["role_size"] + len(OPEN) + len(MID)
        span = F.struct(
            (state["at"] + before).alias("start"),
            (head["size"] - before - len(CLOSE)).alias("length"),
        )
        return F.struct(
            (state["at"] + head["size"]).alias("at"),
            F.when(head["learn"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    return F.aggregate(heads, zero, step, lambda s: s["spans"])


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), ""
    )
