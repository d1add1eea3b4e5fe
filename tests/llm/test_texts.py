"""Operators on texts: substring, line and exact deduplication, SimHash."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from levelfield.llm import copies, exact, lines, simhash, substring, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, row string, t long, spans string, fp string"


def _docs(make, pairs):
    """Rows with extra columns whose names the operators use inside."""
    return make(SCHEMA, [(i, t, "row", 1, "spans", "fp") for i, t in pairs])


def _random_docs(seed, n=60, vocabulary=6, most=60):
    rng = random.Random(seed)
    bank = [[str(rng.randrange(vocabulary)) for _ in range(rng.randrange(5, 30))] for _ in range(6)]
    out = []
    for i in range(n):
        own = [str(rng.randrange(10**6)) for _ in range(rng.randrange(most))]
        at = rng.randrange(len(own) + 1)
        passage = rng.choice(bank) if rng.random() < 0.6 else []
        out.append((i, rng.choice([" ", "\n", "\t "]).join(own[:at] + passage + own[at:])))
    return out + [(n, None), (n + 1, ""), (None, out[3][1]), (2, out[5][1]), out[7], out[7]]


def _brute_substring(rows, n):
    top = 1 << 63
    split = [WORD.findall(t or "") for _, t in rows]
    low = {}
    for (i, _), w in zip(rows, split):
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            low[g] = min(low.get(g, top), top - 1 if i is None else i)
    out = []
    for (i, _), w in zip(rows, split):
        gone = set()
        for k in range(len(w) - n + 1):
            if low[tuple(w[k : k + n])] < (top - 1 if i is None else i):
                gone |= set(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def _bag(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("min_words, group_rows", [(3, 50_000), (13, 50_000), (4, 2)])
def test_substring_equals_brute_force(make, monkeypatch, min_words, group_rows):
    """With two rows a group nearly every prefix is made longer, and full ones are salted."""
    monkeypatch.setattr(substring, "GROUP_ROWS", group_rows)
    rows = _random_docs(min_words)
    got = substring.substring_report(_docs(make, rows), min_words=min_words)
    assert _bag(got.collect()) == _bag(_brute_substring(rows, min_words))


def test_substring_long_text_and_empty_table(make):
    passage = " ".join(f"w{k}" for k in range(20_000))
    rows = [(1, passage), (2, "x " + passage + " y"), (3, None)]
    got = {r[0]: r[1:3] for r in substring.substring_report(_docs(make, rows)).collect()}
    assert got == {1: (20_000, 0), 2: (20_002, 20_000), 3: (0, 0)}
    assert substring.substring_report(_docs(make, [])).collect() == []


def test_spans_of_a_slice_are_cut_from_its_own_texts():
    kind = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
    rows = [[{"at": 0, "n": 9}], None, [{"at": 1, "n": 2}, {"at": 2, "n": 2}], [], [{"at": 0, "n": 4}]]
    own = list(substring._bounds(pa.array(rows, kind).slice(1)))
    assert [(at.tolist(), n.tolist()) for at, n in own] == [([], []), ([1, 2], [2, 2]), ([], []), ([0], [4])]
    cut = [substring._cut(b" a\nb c  d", *spans) for spans in own]
    assert cut == [(4, 0, b"a b c d"), (4, 3, b"a"), (4, 0, b"a b c d"), (4, 4, b"")]


def test_only_texts_that_lose_words_go_to_python(make):
    docs = _docs(make, [(1, "a b c"), (2, "a b c"), (3, None)])
    done = substring.remove_repeats(docs, min_words=2)
    assert "cut(CASE WHEN isnotnull(spans" in done._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id: r.text for r in done.collect()} == {1: "a b c", 2: "", 3: None}


def test_substring_texts_keep_other_columns(make):
    passage = " ".join(f"w{k}" for k in range(15))
    docs = _docs(make, [(1, f"a {passage}"), (2, f"b\n{passage} c"), (3, "own  words"), (4, None)])
    done = substring.remove_repeats(docs)
    assert done.columns == docs.columns
    assert {r.doc_id: r.text for r in done.collect()} == {1: f"a {passage}", 2: "b c", 3: "own  words", 4: None}


def _content(text):
    return [x for x in (text or "").split("\n") if WORD.search(x)]


def _brute_lines(rows, n, chars=None):
    """Deleted lines per row: those in a run that begins earlier elsewhere, of n lines, or of
    fewer that have so many characters."""
    place = [((1 << 63) - 1 if i is None else i, xxhash.xxh64_intdigest((t or "").encode(), 42)) for i, t in rows]
    place = [(i, h - (1 << 64) if h >= 1 << 63 else h) for i, h in place]
    first = {}
    for p, (_, t) in zip(place, rows):
        c = _content(t)
        for size in range(1, n + 1):
            for k in range(len(c) - size + 1):
                g = tuple(c[k : k + size])
                first[g] = min(first.get(g, (*p, k)), (*p, k))
    out = []
    for p, (i, t) in zip(place, rows):
        c = _content(t)
        gone = set()
        for size in range(1, n + 1):
            for k in range(len(c) - size + 1):
                g = tuple(c[k : k + size])
                if first[g] < (*p, k) and (size == n or chars is not None and len("".join(g)) >= chars):
                    gone |= set(range(k, k + size))
        kept, seen = [], -1
        for x in (t or "").split("\n"):
            seen += bool(WORD.search(x))
            if not WORD.search(x) or seen not in gone:
                kept.append(x)
        out.append((i, len(c), len(gone), "\n".join(kept)))
    return out


def _line_docs(seed):
    rng = random.Random(seed)
    bank = [f"line {k}" for k in range(12)]
    rows = []
    for i in range(40):
        mine = [rng.choice([*bank, f"own {rng.randrange(10**6)}", "", "  "]) for _ in range(rng.randrange(12))]
        rows.append((i, "\n".join(mine)))
    run = "\n".join(f"shared {k}" for k in range(70))
    return rows + [(50, run), (51, "head\n" + run + "\ntail"), (52, None), (53, ""), (None, rows[3][1]), (4, "line 1\nline 2"), rows[6]]


@pytest.mark.parametrize(("min_lines", "min_chars"), [(1, None), (2, None), (4, None), (3, None), (5, None), (3, 13), (5, 11), (6, 20)])
def test_lines_equal_brute_force(make, min_lines, min_chars):
    rows = _line_docs(min_lines)
    got = lines.line_report(_docs(make, rows), min_lines=min_lines, min_chars=min_chars)
    assert _bag(got.collect()) == _bag(_brute_lines(rows, min_lines, min_chars))


def test_lone_short_lines_stay(make):
    """Where the rule differs from deleting every line that occurs before."""
    long = "a line of its own length, long enough to be a passage " * 2
    docs = _docs(make, [(1, f"Introduction\n{long}\nThank you"), (2, f"Introduction\nmine\n{long}\nThank you"), (3, "x\nIntroduction")])
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs, min_lines=3, min_chars=80).collect()}
    assert got == {1: f"Introduction\n{long}\nThank you", 2: "Introduction\nmine", 3: "x\nIntroduction"}


def test_line_runs_are_maximal_and_name_their_source(make):
    run = "\n".join(f"shared {k}" for k in range(70))
    docs = _docs(make, [(1, "a\n" + run), (2, "b\nc\n\n" + run + "\nd"), (3, "shared 69\nshared 3")])
    got = {(r.id, r.start, r.lines, r.source.id, r.source.pos) for r in lines.repeated_runs(docs).collect()}
    assert got == {(2, 2, 70, 1, 1), (3, 0, 1, 1, 70), (3, 1, 1, 1, 4)}
    of_three = {(r.id, r.start, r.lines) for r in lines.repeated_runs(docs, min_lines=3).collect()}
    assert of_three == {(2, 2, 70)}
    with pytest.raises(ValueError):
        lines.repeated_runs(docs, min_lines=0)


def test_line_texts_keep_rows_and_columns(make):
    docs = _docs(make, [(1, "a\nb"), (2, "b\n \nc"), (3, "a"), (4, None)])
    done = lines.dedup_lines(docs)
    assert done.columns == docs.columns
    assert {r.doc_id: r.text for r in done.collect()} == {1: "a\nb", 2: " \nc", 3: "", 4: None}
    assert lines.dedup_lines(_docs(make, [])).collect() == []


def test_lines_of_long_texts_that_repeat_themselves(make):
    """Every line begins a run of its own shift; together they hold the square of the lines."""
    n = 100_000
    cycle = [f"cycle {k}" for k in range(3)]
    rows = [(1, "\n".join(["0"] * n)), (2, "\n".join(cycle * (n // 3))), (3, "0\n0\nown\n0")]
    got = {r[0]: r[1:] for r in lines.line_report(_docs(make, rows)).collect()}
    assert got == {1: (n, n - 1, "0"), 2: (n // 3 * 3, n // 3 * 3 - 3, "\n".join(cycle)), 3: (4, 3, "own")}


def test_exact_duplicates(make):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdens. \n") for _ in range(50_000))
    texts = [long, long, long + "x", "x" * 9000, "x" * 9000, "x" * 8999, None, "", "é😀n ", "é😀n "]
    rows = list(enumerate(texts)) + [(None, long), (None, "only"), (7, ""), (9, "é😀n ")]
    got = exact.exact_duplicates(_docs(make, rows))
    plain = [(i, t or "") for i, t in rows]
    want = []
    for i, t in plain:
        same = [j for j, u in plain if u == t]
        keep = max((j for j in same if j is not None), default=None)
        want.append((i, keep, len(same), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert _bag(got.collect()) == _bag(want)
    assert exact.exact_duplicates(_docs(make, [])).collect() == []


def test_chunks_are_the_text(make):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    docs = _docs(make, [(i, "".join(rng.choice("st.n \nab") for _ in range(rng.randrange(20_000)))) for i in range(10)])
    wrong = docs.where(F.array_join(exact.chunks(F.col("text")), "") != F.col("text"))
    assert wrong.count() == 0


def _brute_print(text, n=3):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x.encode()) for x in WORD.findall(text or "")]
    runs = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if runs else 0


def test_near_duplicates_equal_brute_force(make):
    rng = random.Random(3)
    bases = [[rng.choice(["Alpha", "beta", "É", "x"]) + str(rng.randrange(300)) for _ in range(200)] for _ in range(5)]
    rows = []
    for i in range(80):
        mine = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            mine[rng.randrange(len(mine))] = "changed"
        rows.append((i, "  ".join(mine)))
    rows += [(90, None), (91, ""), (92, " \n"), (93, "one two"), (94, "ONE  two"), (None, rows[0][1]), rows[1]]
    got = simhash.near_duplicates(_docs(make, rows)).collect()
    prints = [_brute_print(t) for _, t in rows]
    head = list(range(len(rows)))
    for _ in rows:  # labels settle after at most as many rounds
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    head[a] = head[b] = min(head[a], head[b])
    want = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if head[j] == head[k] and rows[j][0] is not None]
        want.append((i, f"{prints[k]:016x}", min(ids, default=None)))
    assert _bag(got) == _bag(want)
    assert simhash.near_duplicates(_docs(make, [])).collect() == []


@pytest.mark.parametrize("split", [4096, 8])
def test_forest_joins_what_pairs_join(monkeypatch, split):
    """Dense fingerprints in one key, walked whole and split by the free blocks."""
    monkeypatch.setattr(simhash, "SPLIT", split)
    rng = np.random.default_rng(split)
    centre = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    free = [(0, 13), (13, 13), (26, 12)]
    fp = np.unique([int(c) & ~((1 << 38) - 1) | int(rng.integers(0, 1 << 38)) & int(rng.integers(0, 1 << 38)) & int(rng.integers(0, 1 << 38)) for c in centre[[0] * 300]])
    fp = fp.astype(np.uint64)
    run = np.zeros(len(fp), np.int64)

    def classes(links):
        head = list(range(len(fp)))
        for _ in range(len(fp)):
            before = list(head)
            for a, b in links:
                head[a] = head[b] = min(head[a], head[b])
            if head == before:
                return head

    pairs = [(a, b) for a in range(len(fp)) for b in range(a) if int(fp[a] ^ fp[b]).bit_count() <= 3]
    found = simhash._forest(fp, run, free)
    assert classes(found) == classes(pairs)
    assert len(found) < len(fp)


def _runs(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_copies_against_brute_force(make):
    """Pairs of similarity 0.8 to 1 are found, those below and short texts stay apart."""
    rng = random.Random(7)
    texts, want = [], []
    for _ in range(150):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        other = list(base)
        for _ in range(rng.randrange(1, 9)):
            other[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        texts += [" ".join(base), "  ".join(other).upper()]
        a, b = _runs(texts[-2]), _runs(texts[-1])
        want.append(len(a & b) >= 0.8 * len(a | b))
    group = [f"g{k}" for k in range(300)]  # more members than one key lists at once
    for k in range(100):
        texts.append(" ".join([*group[: 2 * k + 5], f"own{k}", *group[2 * k + 6 :]]))
    short = ["yes", "no", "one two three", "one two four"]
    n = len(texts)
    rows = [*enumerate([*texts, *short, "", None, " YES "]), (None, texts[0])]
    got = {r.doc_id: r.component_id for r in copies.near_copies(_docs(make, rows)).collect()}
    found = [got[2 * k + 1] == 2 * k for k in range(150)]
    assert not any(f and not w for f, w in zip(found, want))
    recall = sum(f for f, w in zip(found, want) if w) / sum(want)
    print("recall", sum(want), recall)
    assert recall >= 0.95 and 0 < sum(want) < 150
    assert {got[i] for i in range(300, n)} == {300}
    assert [got[n + k] for k in range(7)] == [n, n + 1, n + 2, n + 3, n + 4, n + 4, n] and got[None] == 0
    assert copies.near_copies(_docs(make, [])).collect() == []


def test_words_are_bytes_split():
    rng = random.Random(5)
    texts = ["".join(rng.choice("aé \n\t\x0b\x1c😀" + "z" * 3) for _ in range(rng.randrange(300))).encode() for _ in range(50)]
    texts += [b"", b"q" * 70_000 + b" x", b" ", b"q" * 70_000]
    got = words.Words(texts)
    for i, t in enumerate(texts):
        spans = range(got.first[i], got.first[i + 1])
        assert [bytes(got.data[got.start[k] : got.end[k]]) for k in spans] == t.split()
    by_word = {}
    for k in range(len(got.start)):
        by_word.setdefault(bytes(got.data[got.start[k] : got.end[k]]), set()).add(int(got.hash[k]))
    assert all(len(v) == 1 for v in by_word.values())
    assert len({next(iter(v)) for v in by_word.values()}) == len(by_word)


def test_pivot_tables_part_a_key_without_losing_a_pair():
    """Three crowds of near fingerprints in one key fall apart, and all near pairs stay together."""
    rng = np.random.default_rng(9)
    heads = rng.integers(0, 1 << 64, (3, copies.WORDS64), dtype=np.uint64)
    flips = np.packbits(rng.random((300, 64 * copies.WORDS64)) < 0.05, axis=1).view(np.uint64)
    fp = heads[np.arange(300) % 3] ^ flips
    parts = copies._parts(fp)
    assert len(parts) == 3 and sorted(np.concatenate(parts).tolist()) == list(range(300))
    loose = rng.integers(0, 1 << 64, (200, copies.WORDS64), dtype=np.uint64)
    fp = np.concatenate([fp, loose, loose[:40] ^ np.uint64(1 << 9), fp[:100]])
    apart = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2)
    part_of = np.empty(len(fp), int)
    for k, part in enumerate(copies._parts(fp)):
        part_of[part] = k
    assert np.all((part_of[:, None] == part_of[None])[apart <= copies.REACH])
    same = copies._parts(np.repeat(heads[:1], 500, axis=0))
    assert len(same) == 1 and len(same[0]) == 500


def test_run_hashes_are_mixed_step_by_step_and_leave_their_input():
    def plain(x):
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = ((x ^ x >> shift) * times) & (1 << 64) - 1
        return x

    given_ = np.random.default_rng(1).integers(0, 1 << 64, 50, np.uint64)
    kept = given_.copy()
    assert words.mix(given_).tolist() == [plain(x) for x in kept.tolist()]
    want = [plain((plain((a * 0x9E3779B97F4A7C15 + b) & (1 << 64) - 1) * 0x9E3779B97F4A7C15 + c) & (1 << 64) - 1)
            for a, b, c in zip(kept.tolist(), kept.tolist()[1:], kept.tolist()[2:])]
    assert words.grams(given_, 3).tolist() == want and (given_ == kept).all()
