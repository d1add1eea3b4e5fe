"""Token ids in bit-plane files: round trips, edge cases, random access."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T
from tokenizers import Tokenizer

from levelfield.llm import planes, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, id string, mark long, row string, content string"
SIGNS = [
    " ", "  ", "\n", "\n\n", "\t", " ", "　", "a", "foo", "Bar", ".", ",", "...", "!", "'s", "'", "é", "×", "÷", "€",
    "1", "23", "<|endoftext|>", "\x01", "\x00", "😀", "ü", "»", "́", "ª", "\r", "\x85", "\x1c", "_",
]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.booleans())
def test_planes_of_a_block(ids, bits):
    ids = np.array(ids, "<u4")
    made = planes.to_planes(ids, bits)
    assert (planes.from_planes(made, len(ids), bits) == ids).all()
    assert len(made) <= (32 if bits else 4)


@pytest.mark.parametrize("bits", [True, False])
def test_file_of_several_blocks(bits):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    own = [rng.integers(0, 50_000, n).astype("<u4") for n in (1, 3 * planes.BLOCK + 5, 7, 0, planes.BLOCK - 3)]
    data = planes.file_bytes([x.tobytes() for x in own], pa.array(list("abcde")), 3, 1, bits)
    file = planes.PlaneFile(data + b"\n")
    assert file.head["n_ids"] == sum(map(len, own)) and file.keys.to_pylist() == list("abcde")
    assert len(file.blocks) == 5 and [b["n_ids"] for b in file.blocks[:4]] == [planes.BLOCK] * 4
    for s, n, x in zip(file.starts, file.lengths, own):
        assert (file.ids(int(s), int(n)) == x).all()
    with pytest.raises(ValueError):
        planes.PlaneFile(b"PLN2" + data[4:])


def test_encoder_equals_the_library():
    rng, encode = random.Random(9), planes.byte_encoder(PATH)
    for _ in range(5_000):
        text = "".join(rng.choice(SIGNS) for _ in range(rng.randrange(14)))
        want = encode.whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text.encode()), "<u4").tolist() == want, repr(text)


def _docs(make, rows):
    return make(SCHEMA, [(i, t, "id", 1, "row", "content") for i, t in rows])


def _brute(rows):
    """Rows in the documented order, with starts and digests."""
    whole, out, start = Tokenizer.from_file(PATH), [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_report_edge_cases(make, tmp_path, monkeypatch):
    monkeypatch.setattr(planes, "FILE", 500)  # several files a task
    rng = random.Random(2)
    rows = [(k * 3 - 50, " ".join(rng.choice(SIGNS) for _ in range(rng.randrange(40)))) for k in range(120)]
    rows += [(1000, None), (1001, ""), (-10**12, "word " * 30_000), (2000, "same"), (2000, "same"), (None, "last")]
    docs = _docs(make, rows)
    got = planes.token_report(docs, PATH).orderBy("start").collect()
    assert [tuple(r) for r in got] == _brute(rows)
    assert planes.token_report(_docs(make, []), PATH).collect() == []


def test_ids_and_spans_read_back(make, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(planes, "FILE", 700)
    rows = [(k, f"text {k} " + "some words, and more. " * (k % 9)) for k in range(200)]
    folder = f"file://{tmp_path}/tokens"
    planes.write_tokens(_docs(make, rows), PATH, folder, end_id=7, bits=True)
    whole = Tokenizer.from_file(PATH)
    want = {i: [*whole.encode(t, add_special_tokens=False).ids, 7] for i, t in rows}
    back = {r.id: r.ids for r in planes.read_documents(spark, folder, T.LongType()).collect()}
    assert back == want
    index = spark.read.parquet(f"{folder}/index").orderBy("first").collect()
    assert len(index) > 3 and index[-1]["first"] + index[-1]["n_ids"] == sum(map(len, want.values()))
    flat = [x for i in sorted(want) for x in want[i]]
    for start, n in ((0, 5), (650, 900), (len(flat) - 3, 10), (len(flat), 4)):
        got = planes.read_span(spark, folder, start, n).orderBy("place").collect()
        assert [(r.place, r.id) for r in got] == [(start + k, x) for k, x in enumerate(flat[start : start + n])]


def test_text_ids_and_repeated_rows(make):
    docs = make("name string, body string", [("b", "x"), ("a", "y"), (None, "z"), ("b", "x")])
    got = planes.token_report(docs, PATH, id_col="name", text_col="body").orderBy("start").collect()
    assert [(r.name, r.start) for r in got] == [("a", 0), ("b", 2), ("b", 4), (None, 6)]


def test_op11_on_the_given_table(spark):
    directory = "/root/testdata/sf0.001"
    got = queries.QUERIES["op11_token_planes"](spark, directory).orderBy("start").collect()
    rows = spark.read.parquet(f"{directory}/documents.parquet").select("doc_id", "text").collect()
    assert [tuple(r) for r in got] == _brute([(r.doc_id, r.text) for r in rows])
    assert set(got[0].asDict()) == {"doc_id", "start", "n_tokens", "ids_crc32"}


def test_words_of_few_and_many_ids_are_written_alike():
    encode, library = planes.ByteEncoder(PATH), Tokenizer.from_file(PATH)
    sizes = set()
    for n in (1, 2, 40, 63, 64, 65, 66, 400):
        for text in ("qx" * n, "the " + "zq" * n, "\u00e9" * n):
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(encode(text.encode()), "<u4").tolist() == want
            sizes.add(len(want) < len(planes._PACKS))
    assert sizes == {True, False}
