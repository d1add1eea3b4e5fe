"""Chat formatting, SentencePiece, packing and the pipeline."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from levelfield.llm import chat, packing, pieces, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TURNS = "conv_id long, turn long, role string, text string, source string, plain string, row string"

HARD = ["\\", "</turn>", "\n", "### ", "user: ", "<", "/turn>", ":", " ", "a", "\\n", "<\\/turn>", "é", "😀", "$1"]


def _read_back(make, rows):
    turns = make(TURNS, [(*r, "s", "p", "r") for r in rows])
    return chat.format_conversations(turns)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.lists(st.sampled_from(HARD), max_size=12).map("".join), min_size=400, max_size=400))
def test_chat_round_trip_of_hard_texts(make, texts):
    rng = random.Random(len("".join(texts)))
    rows = [(k // 4, k % 4, rng.choice(["user", "assistant", "a: b\\", "x\n### y"]), t) for k, t in enumerate(texts)]
    got = {r.conv_id: r for r in _read_back(make, rows).collect()}
    for c, r in got.items():
        assert [(t.role, t.text) for t in r.turns] == [x[2:] for x in rows if x[0] == c]
    # Different conversations never render alike.
    seen = {}
    for c, r in got.items():
        assert seen.setdefault(r.formatted, [tuple(t) for t in r.turns]) == [tuple(t) for t in r.turns]


def test_chat_mask_and_attempts(make):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "assistant", "a</turn>\n### user: b"), (3, 0, None, None), (3, 0, None, None), (None, 2, "user", "x"), (None, 1, "assistant", "\\")]
    done = _read_back(make, rows).withColumn("spans", chat.loss_spans(F.col("formatted")))
    got = {r.conv_id: r for r in done.withColumn("masked", chat.masked_text(F.col("formatted"), F.col("spans"))).collect()}
    assert got[1].formatted == "### user: hi</turn>\n### assistant: yo</turn>\n" and got[1].attempt == 0
    assert got[1].formatted[got[1].spans[0].start :][: got[1].spans[0].length] == "yo"
    assert got[2].attempt == 1 and got[2].masked == "a</turn>\n### user: b"
    assert [(t.role, t.text) for t in got[3].turns] == [("", ""), ("", "")]
    assert [t.text for t in got[None].turns] == ["\\", "x"] and got[None].masked == "\\"
    assert _read_back(make, []).collect() == []


def test_chat_long_text(make):
    text = "<a\\: " * 200_000
    got = _read_back(make, [(1, 0, "user", text)]).collect()[0]
    assert got.turns[0].text == text


ODD = ["", " ", "  a  b ", "▁x ▁", "tab\tline\nend ", "你好世界 こんにちは", "😀 ﬁ é", "a" * 200, "the " * 50, "1234 56", "x" * 61 + "y", "\x00 \x7f", "<s> </s> <0x0A>", "▁" * 40 + "a"]


def test_pieces_equal_the_library(make):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcdefth er in on. ,;É1") for _ in range(rng.randrange(200))) for _ in range(60)]
    docs = make("doc_id long, text string, k int, word string, ids string", [(i, t, 1, "w", "i") for i, t in enumerate(texts)])
    told = pieces.encode(docs, MODEL)
    got = {r.id: list(r.ids) for r in told.collect()}
    for i, t in enumerate(texts):
        assert got[i] == model.encode(t), t
    back = {r.id: r.text for r in pieces.decode(told, MODEL).collect()}
    assert all(back[i] == model.decode(got[i]) == t.replace("▁", " ") for i, t in enumerate(texts))
    report = {r.doc_id: r for r in pieces.encoding_report(docs, MODEL).collect()}
    for i, t in enumerate(texts):
        assert report[i].ids_sha256 == _sha(model.encode(t))
        assert (report[i].n_ids, report[i].n_chars, report[i].decodes) == (len(got[i]), len(t), "▁" not in t)


def _sha(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_pieces_of_odd_rows(make, monkeypatch):
    """Null ids and texts, repeated rows, text ids, small chunks and blocks, an empty table."""
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    monkeypatch.setattr(pieces, "CHUNK", 5)
    monkeypatch.setattr(pieces, "BLOCK", 40)
    monkeypatch.setattr(pieces, "TURNS", 2)
    rows = [("1", "the cat the"), ("2", None), (None, "the dog"), ("1", "the cat the"), ("1", "other"), ("x", "long " * 50)]
    rows += [(f"r{k}", "the cat " * (k % 7)) for k in range(60)]
    docs = make("doc_id string, text string", rows)
    got = pieces.encoding_report(docs, MODEL).collect()
    want = [(i, _sha(model.encode(t or "")), True) for i, t in rows]
    assert sorted(((r.doc_id, r.ids_sha256, r.decodes) for r in got), key=str) == sorted(want, key=str)
    assert pieces.encoding_report(docs.where("false"), MODEL).collect() == []


def test_pieces_write_a_number_s_first_use_as_zero():
    rng = np.random.default_rng(1)
    numbers = pieces._numbers()
    told = [numbers[k] for k in rng.zipf(1.3, 5_000).tolist()]
    for known, at, to in ((0, 0, 2_000), (max(told[:2_000]) + 1, 2_000, 5_000), (0, 0, 0)):
        assert pieces._unpacked_first(pieces._packed_first(told[at:to], known)).tolist() == told[at:to]
    assert pieces._unpacked(pieces._packed_first([0, 1, 0, 2], 0)).tolist() == [0, 0, 0, 1, 0]


def test_pieces_hold_a_bounded_share_of_the_texts(make):
    """A task's block is bounded by code points, blocks share the turns evenly, and each word of
    a block is answered once."""
    rows = [(k, f"w{k} " + "the cat " * 62_500) for k in range(40)]  # 20 million code points in one task
    docs = make("doc_id long, text string", rows).coalesce(1)
    blocks = pieces.split(docs)
    own = blocks.where("words IS NOT NULL").select("block", pieces._turn_of("block").alias("turn")).collect()
    assert len(own) >= 3 and len({r.turn for r in own}) == len(own)
    answered = pieces.answers(blocks, pieces.dictionary(blocks, MODEL))
    assert answered.count() == sum(r.n for r in blocks.selectExpr("size(words) n").where("n > 0").collect())


def test_pieces_equal_the_library_on_given_documents(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in pieces.encoding_report(docs, MODEL).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    assert {i: r.ids_sha256 for i, r in got.items()} == {i: _sha(model.encode(t)) for i, t in texts.items()}
    assert all(got[i].decodes == ("▁" not in t) for i, t in texts.items())


def test_encoder_equals_the_tokenizer():
    whole, encode = Tokenizer.from_file(WORDS), packing.Encoder(WORDS)
    rng = random.Random(2)
    odd = ["", "áb İI ß Σς ΑΣ z\x1cq", "<|endoftext|>x foo<|startoftext|>", "it's DON'T 12ab½ 你好", "̈a ́", "é́", "\x85 a", "ſ K Å ﬁ", "a\x0bb"]
    odd += ["".join(rng.choice("aBé' s.<|>1\n\t½́Σ") for _ in range(60)) for _ in range(300)]
    for text in odd:
        assert encode(text.encode()) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def _packed_well(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_documents(make):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "cat", "ünd", "x1"]) for _ in range(rng.randrange(900))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(100, None), (101, ""), (None, "a b"), (3, texts[3]), (102, "word " * 30_000)]
    docs = make("doc_id long, text string, length int, part int", [(*r, 0, 0) for r in rows])
    got = packing.pack_documents(docs, WORDS).collect()
    whole = Tokenizer.from_file(WORDS)
    want = []
    for i, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            own = np.array(ids[k : k + 4096], "<u4")
            want.append((i, k // 4096, k, len(own), zlib.crc32(own.tobytes())))
    assert sorted((tuple(r[:5]) for r in got), key=str) == sorted(want, key=str)
    used = _packed_well(got, 4096)
    assert used <= math.ceil(sum(w[3] for w in want) / 4096) + 1
    assert packing.pack_documents(docs.where("false"), WORDS).collect() == []


def test_packing_many_blocks(make, monkeypatch):
    """Small blocks: the spare bins of all of them are packed again, in several turns."""
    monkeypatch.setattr(packing, "BLOCK", 40)
    rng = random.Random(4)
    lengths = [rng.randrange(1, 60) for _ in range(2000)]
    pieces_ = make("length long, part long, nth long, name string", [(n, k % 7, k // 7, f"p{k}") for k, n in enumerate(lengths)])
    stored = pieces_.repartition(4).cache()
    got = packing.pack(stored, 100).collect()
    assert sorted(r.name for r in got) == sorted(f"p{k}" for k in range(2000))
    assert _packed_well(got, 100) <= math.ceil(sum(lengths) / 100) * 1.03


def test_crossover_beats_best_fit():
    """Triplets that fill a bin exactly: best fit wastes bins, evolution finds better."""
    rng = np.random.default_rng(5)
    sizes = []
    for _ in range(20):
        a = int(rng.integers(380, 495))
        b = int(rng.integers(250, 1000 - a - 249))
        sizes += [a, b, 1000 - a - b]
    sizes = np.sort(np.array(sizes))[::-1].copy()
    plain = packing.Packing(packing.best_fit(sizes, range(60), np.full(60, -1), np.zeros(0, np.int64), 1000), sizes, 1000)
    best = packing.evolve(sizes, [plain.bins], 1000, 1, generations=300, population=12)
    assert (best.fill <= 1000).all() and best.cost[0] < plain.cost[0]


def test_cross_keeps_every_piece_once():
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 500, 200)
    one, two = (packing.Packing(packing.best_fit(sizes, rng.permutation(200).tolist(), np.full(200, -1), np.zeros(0, np.int64), 1000), sizes, 1000) for _ in "ab")
    for _ in range(20):
        child = packing.cross(one, two, sizes, 1000, rng)
        assert len(child.bins) == 200 and child.bins.min() >= 0 and (child.fill <= 1000).all()
        assert child.fill.sum() == sizes.sum()


DIRECTORY = "/root/testdata/sf0.001"


def test_queries_equal_their_sql(spark):
    import compare

    con = compare.connect(DIRECTORY)
    for name, sql in queries.ORACLES.items():
        assert compare.difference(queries.QUERIES[name](spark, DIRECTORY), con, sql) is None, name


def test_pipeline_without_a_known_language(spark, make):
    docs = make("doc_id long, text string, lang string", [(1, "abc", None), (2, "12", None), (3, None, None), (4, "é", None), (5, "", None)])
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()) == [1, 4]


def test_pipeline_stages_get_texts_in_bounded_batches(spark, make):
    """A stage hands Python a few megabytes at a time, unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = make("doc_id long, text string, lang string", [(1, "abc", "en")])
    texts = spark.range(0, 200, 1, 1).selectExpr("repeat('x', 100000) AS text")
    try:
        for own, least, most in ((None, 0, 8 << 20), ("32m", 9 << 20, 64 << 20)):
            spark.conf.unset(key)
            if own:
                spark.conf.set(key, own)
            corpus_pipeline.language_id(spark, docs, "")
            sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
            assert least < max(r.n for r in sizes.collect()) <= most
    finally:
        spark.conf.unset(key)


def test_pipeline_stages(spark, make):
    """Each stage on its predecessor's rows, against what the stage should leave."""
    from levelfield.session import materialise

    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    odd = make("doc_id long, text string, lang string, source string, n_chars long", [(900, None, None, None, None), (901, "12 34", "en", "s", 5), (902, "", "en", "s", 0)])
    docs = docs.unionByName(odd)
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    tables = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, DIRECTORY), "stage")
        tables.append(docs.collect())
        if stage is not corpus_pipeline.best_fit_packing:
            assert docs.columns == columns, name
    named, lined, near, cut, packed = tables
    assert {r.doc_id for r in named} == set(before) - {900, 901, 902}
    assert all(r == before[r.doc_id] for r in named)
    content = {r.doc_id: [(k, x) for k, x in enumerate(r.text.split("\n")) if x.strip(" \t\n\r\x0b\x0c")] for r in named}
    seen, text = set(), {}
    for r in sorted(named, key=lambda r: r.doc_id):
        own, gone = content[r.doc_id], set()
        for p in range(len(own)):
            for size in (1, 2, 3):
                run = tuple(x for _, x in own[p : p + size])
                if len(run) == size and (size == 3 or sum(map(len, run)) >= 80):
                    if run in seen:
                        gone.update(k for k, _ in own[p : p + size])
                    seen.add(run)
        text[r.doc_id] = "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone)
    assert {r.doc_id: r.text for r in lined} == text
    assert all(r.n_chars == len(r.text) for r in lined + cut)
    runs = {}
    for i, t in text.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        runs[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    head, order = {i: i for i in text}, sorted(text)
    links = [(a, b) for a in order for b in order if a < b and len(runs[a] & runs[b]) * 10 >= len(runs[a] | runs[b]) * 8]
    for _ in range(len(links)):
        before_turn = dict(head)
        for a, b in links:
            head[a] = head[b] = min(head[a], head[b])
        if head == before_turn:
            break
    assert {r.doc_id for r in near} == {i for i in text if head[i] == i}
    low, want = {}, {}
    split = {r.doc_id: r.text.split() for r in near}
    for i, w in split.items():
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            low[g] = min(low.get(g, i), i)
    for i, w in split.items():
        gone = {k + o for k in range(len(w) - 12) if low[tuple(w[k : k + 13])] < i for o in range(13)}
        want[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else text[i]
    assert {r.doc_id: r.text for r in cut} == want
    whole = Tokenizer.from_file(WORDS)
    total = {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == total
    assert _packed_well(packed, 4096) <= math.ceil(sum(total.values()) / 4096) + 1
