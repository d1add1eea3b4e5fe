"""The filter audit against brute force: tries, prefixes, masks, all orders."""

import itertools
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from levelfield.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, id long, part string, mask int, flush string"
COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _docs(make, rows):
    """Rows with extra columns whose names the operator uses inside."""
    return make(SCHEMA, [(*r, 1, "part", 3, "flush") for r in rows])


def _fails(text):
    w = WORD.findall(text)
    return {
        "A": len(w) < 50,
        "B": 100 * len(set(w)) < 65 * len(w),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
    }


def _brute(rows, labels):
    """Filter by filter, order by order, as the definition says."""
    rows = [(i, t or "", p or "") for i, t, p in rows]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    docs = []
    for i, t, p in rows:
        fails = _fails(t)
        fails["E"] = t in least and (i is None or i > least[t])
        docs.append((i, p, {f for f, x in fails.items() if x}))
    out, removed_in = {}, Counter()
    for part in {p for _, p, _ in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [d for d in docs if d[1] == part]
            gone = []
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[2]]
                left = [d for d in left if f not in d[2]]
                removed_in[part, f] += len(here)
                out[part, order, step] = [
                    len(left), len(here), sum(f in d[2] for d in gone),
                    sum(d[2] == {f} for d in docs if d[1] == part),
                    sum(d[0] in good for d in here), sum(d[0] in toxic for d in here),
                ]
                gone += here
    return sorted((*k, *v, removed_in[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def _rows(seed, n=150):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "DELTA", "é", "x1", "#tag", "a|b", "the"]
    passage = " ".join(rng.choice(words[:5]) + str(k) for k in range(60))
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3:
            text = passage  # one large group of copies
        elif kind < 0.6:
            text = passage + " " * rng.randrange(3) + rng.choice(words) * rng.randrange(3)  # one long common prefix
        else:
            text = " ".join(rng.choice(words) + str(rng.randrange(80)) for _ in range(rng.randrange(70)))
        out.append((i, text, rng.choice(["a", "b", "", None])))
    rng.shuffle(out)
    return out + [(n, None, "a"), (n + 1, "", "b"), (None, passage, "a"), (None, "lone of null id", "a"), (None, "lone of null id", "b"), out[0], out[0], (out[1][0], out[2][1], "c"), (-5, out[3][1], "a")]


LABELS = [(k, k % 2, k % 3 == 0) for k in range(0, 140, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (7, None, None)]


def _labels(make, rows=LABELS):
    return make("doc_id long, quality int, toxic int, part string", [(i, q, None if x is None else int(x), "p") for i, q, x in rows])


def _told(df):
    assert tuple(df.columns) == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def test_filter_audit_equals_brute_force(make):
    rows = _rows(1)
    assert _told(audit.filter_audit(_docs(make, rows), _labels(make))) == _brute(rows, LABELS)


def test_deep_prefixes_and_salted_copies(make, monkeypatch):
    """A bound of a few texts: prefixes lengthen to whole texts, copies go through salts."""
    monkeypatch.setattr(audit, "MOST_BYTES", 900)
    monkeypatch.setattr(audit, "TRIE_BYTES", 2_000)
    rows = _rows(2)
    docs = _docs(make, rows).repartition(6)
    left = audit.local_tries(docs, "doc_id", "text", "source").where("text is not null").cache()
    keyed, hot = audit.adaptive_prefixes(left)
    assert hot and keyed.where("hot").count() and keyed.where("not hot").count()
    groups = keyed.where("not hot").selectExpr("group", "size + 64 as size").groupBy("group").sum("size").collect()
    assert max(r[1] for r in groups) <= 900
    assert _told(audit.filter_audit(docs, _labels(make))) == _brute(rows, LABELS)


def test_empty_tables_and_one_row(make):
    assert _told(audit.filter_audit(_docs(make, []), _labels(make))) == []
    rows = [(1, None, None)]
    assert _told(audit.filter_audit(_docs(make, rows), _labels(make, []))) == _brute(rows, [])


def test_text_ids_and_very_long_texts(make):
    long = "word " * 200_000
    docs = make("name string, body string, origin string", [("b", long, "o"), ("a", long, "o"), (None, long + "x", "o")])
    found = audit.masks(docs, id_col="name", text_col="body", part_col="origin").collect()
    assert {r.id: r["mask"] for r in found} == {"a": 2, "b": 2 | 16, None: 2}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"ab", b"\xff"]), max_size=6).map(b"".join), max_size=30))
def test_trie_gives_equal_texts_one_terminal(texts):
    trie = audit.RadixTrie()
    at = [trie.insert(t) for t in texts]
    first = {}
    assert at == [first.setdefault(t, len(first)) for t in texts]
    # Compressed: no node but the root has a single child and no terminal.
    stack = list(trie.root[1].values())
    while stack:
        label, children, terminal = stack.pop()
        assert label and (terminal is not None or len(children) > 1)
        stack += children.values()


@pytest.mark.parametrize("text", ["", "a b", "A" * 10, "é" * 30 + "AB", "a\x0bb\x1cc", "x " * 60 + "#"])
def test_failures_of_one_text(text):
    want = _fails(text)
    assert audit.failures(text.encode()) == sum(1 << "ABCD".index(f) for f, x in want.items() if x)
