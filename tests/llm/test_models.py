"""Trained operators: toxicity, language, quality rules."""

import random
import re

import numpy as np
import pytest

from levelfield.llm import language, rules, toxicity

SCHEMA = "doc_id long, text string, lang string, score double, id string, predicted int"


def _docs(make, rows):
    return make(SCHEMA, [(i, t, lang, 0.0, "id", 9) for i, t, lang in rows])


SYLLABLES = {"aa": "ka lo mi tu ren sol", "bb": "sch ung ver zer lich tag", "cc": "eau oui ment tion que les"}


def _words(rng, lang, n):
    return [rng.choice(SYLLABLES[lang].split()) + rng.choice(SYLLABLES[lang].split()) for _ in range(n)]


def _toxic_rows(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        text = _words(rng, lang, rng.randrange(5, 80))
        bad = rng.random() < 0.3
        if bad:
            text.insert(rng.randrange(len(text)), f"vile{lang}{rng.choice('xyz')}")
        out.append((i, " ".join(text) + ".", lang, int(bad)))
    return out


def test_toxicity_held_out_accuracy(make):
    rows = _toxic_rows(1, 900)
    docs = _docs(make, [r[:3] for r in rows])
    labels = make("doc_id long, toxic int, text string", [(r[0], r[3], "clash") for r in rows[:600]] + [(None, 1, ""), (5, None, "")])
    model = toxicity.train(docs, labels)
    got = {r.id: r for r in toxicity.scores(docs, model).collect()}
    held = rows[600:]
    assert np.mean([got[i].predicted == y for i, _, _, y in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert set(model.languages) == set(SYLLABLES)


def test_toxicity_gives_shuffled_texts_back_first(make, monkeypatch):
    steps, count = [], toxicity._counts
    monkeypatch.setattr(toxicity, "settle", lambda spark: steps.append("settle"))

    def counts(rows):
        steps.append(all(f.endswith(".zstd.parquet") for f in rows.inputFiles()))
        return count(rows)

    monkeypatch.setattr(toxicity, "_counts", counts)
    rows = _toxic_rows(3, 60)
    toxicity.train(_docs(make, [r[:3] for r in rows]), make("doc_id long, toxic int", [(r[0], r[3]) for r in rows]))
    assert steps == ["settle", True]


def test_toxicity_odd_rows(make):
    rows = _toxic_rows(2, 300)
    model = toxicity.train(_docs(make, [r[:3] for r in rows]), make("doc_id long, toxic int", [(r[0], r[3]) for r in rows]))
    odd = [(1, None, None), (2, "", "aa"), (2, "", "aa"), (None, "vileaax " + "kalo " * 30_000, "aa"), (3, "...", "zz")]
    got = toxicity.scores(_docs(make, odd), model).collect()
    assert len(got) == 5 and got[1] == got[2]
    by = {r.id: r for r in got}
    assert by[1].predicted == by[2].predicted == by[3].predicted == 0 and by[None].predicted == 1
    assert by[1].score == by[2].score == by[3].score
    assert toxicity.scores(_docs(make, []), model).collect() == []


def test_toxicity_without_labels(make):
    docs = _docs(make, [(1, "a b", "aa")])
    model = toxicity.train(docs, make("doc_id long, toxic int", []))
    assert [r.predicted for r in toxicity.scores(docs, model).collect()] == [0]


def test_toxicity_gathers_what_loops_gather():
    """The ragged windows and pooling against a plain loop over one text at a time."""
    rng = np.random.default_rng(3)
    texts = [b"", b"one", b"one two", b"a b c d e f g", b"long " * 50]
    ids = [toxicity.tokens([t]) for t in texts]
    model = toxicity._start(ids, np.array([0, 1, 0, 1, 0]), rng)
    together = model.margins(toxicity.tokens(texts))
    for t, got in zip(ids, together):
        x = model.word[t.word] + model.stem[t.stem]
        want = model.out_bias
        for k, w in enumerate(toxicity.WIDTHS):
            windows = [sum(x[i + o] @ model.filters[k][o] for o in range(w)) for i in range(len(x) - w + 1)]
            want += np.maximum(np.max(windows, axis=0) + model.bias[k], 0) @ model.out[k]
        assert got == pytest.approx(want, rel=1e-4, abs=1e-5)


def _language_rows(seed, n):
    rng = random.Random(seed)
    langs = [rng.choice(["aa", "aa", "bb", "cc"]) for _ in range(n)]
    return [(i, " ".join(_words(rng, lang, rng.randrange(3, 60))), lang) for i, lang in enumerate(langs)]


def test_language_held_out_accuracy(make):
    rows = _language_rows(1, 500)
    docs = _docs(make, rows)
    model = language.train(docs.where("doc_id < 300"))
    got = {r.id: r for r in language.predictions(docs, model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows[300:]]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_odd_rows(make):
    model = language.train(_docs(make, _language_rows(2, 120) + [(900, None, "aa"), (901, "kalo", None)]))
    odd = [(1, None, "aa"), (2, "", None), (3, "12 . \n", "aa"), (None, "schung verlich " * 20_000, None), (5, "kalo mitu", "cc"), (5, "kalo mitu", "cc")]
    got = language.predictions(_docs(make, odd), model, carry=["doc_id", "score"]).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "bb", "aa", "aa"]
    assert [r.score for r in got[:3]] == [0, 0, 0] and got[4] == got[5]
    assert [r.carried.doc_id for r in got] == [r[0] for r in odd]
    assert language.predictions(_docs(make, []), model).collect() == []
    untaught = language.train(_docs(make, []))
    assert language.predictions(_docs(make, odd[4:5]), untaught).collect()[0].lang_pred == "und"


def test_presence_is_the_kernel_of_gram_sets():
    """Without slot clashes the product of two rows is the blended cosine of gram sets."""
    texts = ["abcab", "Abd", "x"]
    rows = language.presence(texts)
    sets = [[{t.lower()[i : i + n] for i in range(len(t) - n + 1)} for n in language.ORDERS] for t in texts]
    for a in range(3):
        for b in range(3):
            parts = [len(p & q) / max(1, len(p) * len(q)) ** 0.5 for p, q in zip(sets[a], sets[b])]
            assert rows[a] @ rows[b] == pytest.approx(sum(parts) / len(language.ORDERS), abs=1e-5)


def _brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {x for x in windows if windows.count(x) > 1}
    covered = {i + k for i, x in enumerate(windows) if x in twice for k in range(5)}
    parts = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(parts) - len(set(parts)), len(covered)


def test_rule_counts_equal_brute_force(make):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab é# $c") + rng.choice("xy\n ") for _ in range(rng.randrange(90))) for _ in range(80)]
    texts += [None, "", " \n\t", "a\nb\na\n\na", "x " * 5000, "one two three four five one two three four five"]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(None, "a b", None), (3, texts[3], None)]
    got = rules.statistics(_docs(make, rows)).collect()
    assert sorted(((r[0], *r[1:6]) for r in got), key=str) == sorted(((i, *_brute_counts(t)) for i, t, _ in rows), key=str)


def test_rules_reject_odd_texts_and_keep_clean_ones(make):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        text = _words(rng, "aa", rng.randrange(20, 90))
        bad = rng.random() < 0.1
        if bad:
            text = [w + rng.choice(["***", "$$$", "&&"]) for w in text]
        rows.append((i, " ".join(text), None))
        labels.append((i, int(not bad)))
    rows += [(700, None, None), (701, "too short", None), (702, "a b c d e f g h " * 9, None)]
    got = {r.doc_id: r for r in rules.quality(_docs(make, rows), make("doc_id long, quality int, score int", [(*x, 0) for x in labels])).collect()}
    good = [i for i, y in labels if y]
    assert np.mean([got[i].kept for i in good]) > 0.98
    assert np.mean([got[i].kept for i, y in labels if not y]) < 0.2
    assert [got[i].base_failed for i in (700, 701, 702)] == [True] * 3 and not any(got[i].kept for i in (700, 701, 702))


def test_rules_without_labels_or_rows(make):
    none = make("doc_id long, quality int", [(None, 1), (1, None)])
    got = rules.quality(_docs(make, [(1, "plain words " + " ".join(f"more{k}" for k in range(9)), None), (1, "* " * 40, None)]), none).collect()
    assert sorted(r.kept for r in got) == [False, True]
    assert rules.quality(_docs(make, []), none).collect() == []


def test_isolation_paths():
    """A far point has shorter paths than the crowd, and equal points cannot be told apart."""
    rng = np.random.default_rng(6)
    x = np.r_[rng.normal(0, 1, (500, 3)), [[9, 9, 9]]]
    score = rules.grow(x).score(x)
    assert score[-1] > score[:-1].max()
    same = rules.grow(np.ones((50, 3))).score(np.ones((4, 3)))
    assert np.all(same == same[0])


def test_forest_and_threshold_take_every_labelled_row(make, spark, tmp_path):
    """More labelled rows than the former sample: each is in a tree, and the counts decide."""
    from pyspark.sql import functions as F

    n = 40_000
    rows = spark.range(n).select(F.col("id").alias("mark"), *[F.lit(20 + k).cast("long").alias(c) for k, c in enumerate(rules.COUNTS[:1])],
        (F.lit(100) + F.col("id") % 7).alias("word_chars"), (F.col("id") % 3).alias("n_symbols"),
        F.lit(0).cast("long").alias("n_dup_lines"), F.lit(0).cast("long").alias("n_repeat_words"), F.lit(1).cast("long").alias("n_lines"))
    seen = []
    real = rules._grow
    rules._grow = lambda measure, *more: real(lambda f, level: seen.append(measure(f, level)) or seen[-1], *more)
    try:
        forest = rules.grow_all(rows)
    finally:
        rules._grow = real
    assert seen[0][0].sum() == n and seen[0][0].min() == n // rules.TREES
    assert rules.scored(rows, forest).where("score not between 0 and 1").count() == 0
    score, good, bad = np.array([0.4, 0.5, 0.6, 0.7]), np.array([990, 8, 2, 0]), np.array([0, 1, 30, 9])
    assert rules.cut(score, good, bad) == 0.5 and rules.cut(score, good, 0 * bad) == 1.0


def test_toxicity_learns_from_every_labelled_row(make, monkeypatch):
    """Several learners, long texts too: a sign that only two rows beyond any sample show counts."""
    monkeypatch.setattr(toxicity, "SHARE", 100)
    rows = _toxic_rows(3, 900) + [(1000 + i, "rareword " + "kalo " * 21_000, "aa", 1) for i in range(3)]
    docs, labels = _docs(make, [r[:3] for r in rows]), make("doc_id long, toxic int", [(r[0], r[3]) for r in rows])
    counted = []
    real = toxicity._begin
    monkeypatch.setattr(toxicity, "_begin", lambda w, s, total, rng: counted.append((w, total)) or real(w, s, total, rng))
    held = []
    cal = toxicity._calibrate
    monkeypatch.setattr(toxicity, "_calibrate", lambda m, cell, guess, clean, toxic: held.append(clean.sum() + toxic.sum()) or cal(m, cell, guess, clean, toxic))
    model = toxicity.train(docs, labels)
    assert counted[0][1].sum() + held[0] == len(rows)
    slot = toxicity.tokens([b"rareword"]).word[0]
    assert counted[0][0][1, slot] >= 1
    fresh = _toxic_rows(4, 300)
    got = {r.id: r.predicted for r in toxicity.scores(_docs(make, [r[:3] for r in fresh]), model).collect()}
    assert np.mean([got[i] == y for i, _, _, y in fresh]) > 0.95
