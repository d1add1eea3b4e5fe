"""The registered queries of this package, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelfield.llm import audit, chat, exact, language, lines, packing, pieces, planes, rules, simhash, substring, toxicity, turntrie
from levelfield.llm.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    """Register ``build(spark, directory) -> DataFrame`` under ``name``."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, directory: str) -> DataFrame:
            ship(spark)
            return build(spark, directory)

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return add


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies on this machine and on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _remainder(column: str, of: int) -> F.Column:
    """crc32 of a number as text, modulo ``of``: the fold of a row."""
    return F.crc32(F.col(column).cast("string")) % of


@query(
    "op1_substring_dedup",
    r"""
    WITH d AS MATERIALIZED (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ),
    p AS (
        SELECT doc_id, unnest(CASE WHEN len(w) < 13 THEN [] ELSE range(1, len(w) - 11) END) AS b, w FROM d
    ),
    g AS MATERIALIZED (SELECT doc_id, b, md5(array_to_string(w[b:b + 12], ' ')) AS k FROM p),
    f AS MATERIALIZED (SELECT k, min(doc_id) AS low FROM g GROUP BY k),
    c AS (
        SELECT DISTINCT doc_id, unnest(range(b, b + 13)) AS nth FROM g JOIN f USING (k) WHERE low < doc_id
    ),
    a AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS nth FROM d),
    m AS (SELECT a.doc_id, a.nth, a.word, c.nth IS NOT NULL AS gone FROM a LEFT JOIN c USING (doc_id, nth)),
    r AS (
        SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
            string_agg(word, ' ' ORDER BY nth) FILTER (WHERE NOT gone) AS kept
        FROM m GROUP BY doc_id
    )
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN r USING (doc_id)
    """,
)
def op1(spark: SparkSession, directory: str) -> DataFrame:
    return substring.substring_report(table(spark, directory, "documents"))


@query("op2_toxicity")
def op2(spark: SparkSession, directory: str) -> DataFrame:
    docs, labels = table(spark, directory, "documents"), table(spark, directory, "labels")
    model = toxicity.train(docs, labels.where(_remainder("doc_id", 5) != 0))
    return toxicity.scores(docs, model).select(
        F.col("id").alias("doc_id"), (_remainder("id", 5) == 0).alias("held_out"), "score", "predicted"
    )


@query("op3_sentencepiece")
def op3(spark: SparkSession, directory: str) -> DataFrame:
    return pieces.encoding_report(table(spark, directory, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query(
    "op4_line_dedup",
    r"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
    l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS nth FROM d),
    c AS (SELECT doc_id, nth, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS content FROM l),
    p AS (
        SELECT doc_id, nth, line, row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS pos FROM c WHERE content
    ),
    w AS (
        SELECT doc_id, pos, 1 AS size, [line] AS run FROM p
        UNION ALL SELECT a.doc_id, a.pos, 2, [a.line, b.line]
        FROM p a JOIN p b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1
        UNION ALL SELECT a.doc_id, a.pos, 3, [a.line, b.line, e.line]
        FROM p a JOIN p b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 JOIN p e ON e.doc_id = a.doc_id AND e.pos = a.pos + 2
    ),
    k AS (
        SELECT doc_id, pos, size, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) > 1 AS copy
        FROM w WHERE size = 3 OR length(array_to_string(run, '')) >= 80
    ),
    g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS pos FROM k WHERE copy),
    m AS (
        SELECT c.doc_id, c.nth, c.line, c.content, g.pos IS NOT NULL AS gone
        FROM c LEFT JOIN p USING (doc_id, nth) LEFT JOIN g ON g.doc_id = p.doc_id AND g.pos = p.pos
    )
    SELECT doc_id, count(*) FILTER (WHERE content) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id
    """,
)
def op4(spark: SparkSession, directory: str) -> DataFrame:
    """Later copies of three lines or more, or of 80 characters or more, go; lone short lines stay."""
    report = lines.line_report(table(spark, directory, "documents"), min_lines=3, min_chars=80)
    return report.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    "op5_exact_dedup",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
    FROM d JOIN g USING (t)
    """,
)
def op5(spark: SparkSession, directory: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, directory, "documents"))


@query(
    "op6_chat_formatting",
    r"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
    ),
    t AS (
        SELECT *,
            contains(text, chr(92)) OR contains(text, '</turn>' || chr(10)) OR contains(text || '</turn>', '</turn>' || chr(10)) AS clash,
            length(replace(text, '</turn>', '</turn>#')) - length(text) AS closers,
            length(text) - length(replace(text, chr(92), '')) AS strokes,
            length(replace(replace(role, chr(92), '##'), ':', '##')) AS role_size
        FROM c
    )
    SELECT conv_id,
        count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(14 + role_size + length(text) + CASE WHEN clash THEN closers + strokes ELSE 0 END) AS BIGINT) AS formatted_chars
    FROM t GROUP BY conv_id
    """,
)
def op6(spark: SparkSession, directory: str) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    turns = table(spark, directory, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(hard).alias("text"),
    )
    done = chat.format_conversations(turns.unionByName(extra))
    spans = done.withColumn("spans", chat.loss_spans(F.col("formatted")))
    masked = spans.withColumn("masked", chat.masked_text(F.col("formatted"), F.col("spans")))
    flat = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return masked.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.char_length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op7_language_id")
def op7(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    model = language.train(docs.where(_remainder("doc_id", 4) != 2))
    return language.predictions(docs, model).select(
        F.col("id").alias("doc_id"), (_remainder("id", 4) == 2).alias("held_out"), "lang_pred", "score"
    )


@query("op8_simhash_near_dedup")
def op8(spark: SparkSession, directory: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, directory, "documents"))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, directory: str) -> DataFrame:
    return packing.pack_documents(table(spark, directory, "documents"), tokenizer_file("word_bpe_49k.json"))


@query("op10_quality_rules")
def op10(spark: SparkSession, directory: str) -> DataFrame:
    return rules.quality(table(spark, directory, "documents"), table(spark, directory, "labels"))


@query("op11_token_planes")
def op11(spark: SparkSession, directory: str) -> DataFrame:
    return planes.token_report(table(spark, directory, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query(
    "op12_filter_audit",
    r"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ),
    l AS (
        SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
        FROM labels GROUP BY doc_id
    ),
    m AS (
        SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
            CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
            + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
            + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
            + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
            + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
        FROM d LEFT JOIN l USING (doc_id)
    ),
    c AS MATERIALIZED (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
    o AS (
        SELECT a.name || b.name || c.name || d.name || e.name AS filter_order,
            [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
        FROM f a, f b, f c, f d, f e
        WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
            AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
    ),
    s AS (
        SELECT filter_order, step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before
        FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM o)
    ),
    r AS (
        SELECT part, filter_order, step,
            sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
            sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
            sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant,
            sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
            sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS good_lost,
            sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
        FROM c, s GROUP BY part, filter_order, step
    )
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
        CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
        CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
        CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley
    FROM r
    """,
)
def op12(spark: SparkSession, directory: str) -> DataFrame:
    return audit.filter_audit(table(spark, directory, "documents"), table(spark, directory, "labels"))


@query(
    "op13_conversation_trie",
    r"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    ),
    o AS (
        SELECT conv_id, list(sha256(strlen(role) || ':' || role || text) ORDER BY turn NULLS FIRST, role, sha256(text)) AS p,
            list(strlen(text) ORDER BY turn NULLS FIRST, role, sha256(text)) AS s
        FROM t GROUP BY conv_id
    ),
    -- crc32 as bits: x -> (x >> 1) xor (the polynomial if the last bit is set), eight times a byte.
    h AS (
        SELECT conv_id, xor(4294967295::BIGINT, list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
            lambda x, b: list_reduce(list_prepend(xor(x, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                lambda y, i: xor(y >> 1, (y & 1) * 3988292384::BIGINT))
        )) % 9 AS h FROM o
    ),
    r AS (
        SELECT o.conv_id, coalesce(b.p, [])[1:h] || o.p[h + 1:] AS p, coalesce(b.s, [])[1:h] || o.s[h + 1:] AS s
        FROM o JOIN h USING (conv_id) LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 5
    ),
    m AS (
        SELECT conv_id, p, s, unnest(range(0, len(p) + 1)) AS d FROM r
    ),
    k AS (
        SELECT conv_id, d, array_to_string(p[1:d], '') AS path, CASE WHEN d > 0 THEN s[d] ELSE 0 END AS size, len(p) = d AS ends, p FROM m
    ),
    n AS MATERIALIZED (
        SELECT path, min(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size, min(p) AS p,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
        FROM k GROUP BY path
    ),
    u AS MATERIALIZED (
        SELECT a.*, array_to_string(a.p[1:a.depth - 1], '') AS above FROM n a
    ),
    c AS (SELECT above AS path, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY above),
    w AS MATERIALIZED (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN c USING (path)),
    x AS (SELECT array_to_string(p[1:e], '') AS path, n_children, n_convs, size
        FROM (SELECT *, unnest(range(0, depth + 1)) AS e FROM w)),
    y AS (SELECT path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * size) AS BIGINT) AS saved_tokens FROM x GROUP BY path)
    SELECT w.conv_id, w.depth, CASE WHEN w.depth > 0 THEN v.conv_id END AS parent_conv_id, w.n_convs, w.n_children,
        n_leaves, saved_tokens, w.ends_sha256
    FROM w JOIN y USING (path) LEFT JOIN w v ON v.path = w.above AND v.depth = w.depth - 1
    """,
)
def op13(spark: SparkSession, directory: str) -> DataFrame:
    return turntrie.conversation_trie(table(spark, directory, "conversations"))
