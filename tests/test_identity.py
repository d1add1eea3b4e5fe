"""Fuzzy matching against brute force and known names."""

import itertools
import random

import pytest

from levelfield.functions import text
from levelfield.operators import fuzzyjoin, identity
from levelfield.operators.fuzzyjoin import close_pairs


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        previous = 0
        for j, y in enumerate(b, 1):
            current = row[j]
            row[j] = previous + 1 if x == y else max(row[j], row[j - 1])
            previous = current
    return row[-1]


def ratio(a, b):
    return 200 * lcs(a, b) / (len(a) + len(b)) if a + b else 100.0


def set_ratio(a, b):
    one, two = set(a.split()), set(b.split())
    if not one or not two:
        return 0.0
    shared = " ".join(sorted(one & two))
    ab, ba = " ".join(sorted(one - two)), " ".join(sorted(two - one))
    if shared and (not ab or not ba):
        return 100.0
    gap = 1 if shared else 0
    fa, fb = len(shared) + gap + len(ab), len(shared) + gap + len(ba)
    rests = 100 - 100 * (len(ab) + len(ba) - 2 * lcs(ab, ba)) / (fa + fb)
    if not shared:
        return rests
    return max(rests, 100 - 100 * (1 + len(ab)) / (len(shared) + fa),
               100 - 100 * (1 + len(ba)) / (len(shared) + fb))


@pytest.fixture(scope="module")
def names():
    random.seed(1)
    words = ("fc real ana bo li madrid sociedad barcelona espanyol rcd deportivo alaves x zz al "
             "atletico united city de la").split()
    made = [" ".join(random.choices(words, k=random.randint(1, 4))) for _ in range(140)]
    made += [n[:-1] + random.choice("abcz") for n in made[:70]] + ["a", "b", "ab", "ba", "abc"]
    made = [" ".join(sorted(n.split())) for n in made]
    return sorted(set(made[::2])) + [""], sorted(set(made[1::2]) | {"", "a", "ab"})


def frames(make, names):
    left, right = names
    return (make("block string, left_name string", [("b", n) for n in sorted(set(left))]),
            make("block string, right_name string", [("b", n) for n in right]))


@pytest.mark.parametrize("threshold", [60.0, 80.0, 95.0])
def test_name_pairs_lose_nothing(make, names, threshold):
    got = {(r.left_name, r.right_name): r.score
           for r in identity.name_pairs(*frames(make, names), threshold).collect()}
    want = {(a, b): ratio(a, b) for a, b in itertools.product(*names)}
    want = {k: v for k, v in want.items() if v >= threshold}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("threshold", [70.0, 85.0])
def test_club_pairs_lose_nothing(make, names, threshold):
    got = {(r.left_name, r.right_name): (r.set_score, r.sort_score)
           for r in identity.club_pairs(*frames(make, names), threshold).collect()}
    want = {(a, b): (set_ratio(a, b), ratio(a, b)) for a, b in itertools.product(*names)}
    want = {k: v for k, v in want.items() if v[0] >= threshold - 1e-12}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in got)


def test_long_texts_are_compared_whole(make):
    random.seed(2)
    texts = ["".join(random.choices("abcdef ", k=random.randint(60, 200))) for _ in range(8)]
    df = make("a string, b string", list(itertools.product(texts, texts)))
    for r in df.select("a", "b", text.lcs_length("a", "b").alias("n")).collect():
        assert r.n == lcs(r.a, r.b)


def test_known_scores(make):
    df = make("a string, b string", [("barcelona", "barcelona fc"),
                                     ("barcelona", "barcelona espanyol rcd")])
    got = [r[0] for r in df.select(text.indel_ratio("a", "b")).collect()]
    assert got == pytest.approx([85.714, 58.065], abs=1e-3)


def test_clubs(make):
    clubs = [("1108", "Deportivo Alavés"), ("714", "RCD Espanyol Barcelona"),
             ("150", "Real Betis Balompié"), ("418", "Real Madrid"), ("13", "Atlético de Madrid"),
             ("131", "FC Barcelona")]
    wanted = {"Alaves": "1108", "Espanyol": "714", "Real Betis": "150", "Real Madrid": "418",
              "Atletico Madrid": "13", "Barcelona": "131", "Nadie": None}
    teams = make("block string, team string", [("ES1", t) for t in wanted])
    listed = make("block string, club_id string, name string", [("ES1", i, n) for i, n in clubs])
    got = {r.team: r.club_id for r in identity.match_clubs(teams, listed).collect()}
    assert got == wanted
    twice = listed.union(make("block string, club_id string, name string",
                              [("ES1", "9", "Barcelona FC")]))
    got = {r.team: r.club_id for r in identity.match_clubs(teams, twice).collect()}
    assert got["Barcelona"] is None and got["Alaves"] == "1108"


def test_squad_match(make):
    players = make("entity_id string, player_name string, block string",
                   [("1", "Iñaki Peña", "c"), ("2", "Pedri Gonzalez", "c"), ("3", "Nobody", "c"),
                    ("4", "Nico Perez", "c"), ("5", "Iñaki Peña", "d")])
    squad = make("external_id string, name string, block string",
                 [("a", "Inaki Pena", "c"), ("b", "González, Pedri", "c"),
                  ("x", "Nico Perez", "c"), ("y", "Nico Pérez", "c")])
    got = {r.entity_id: (r.external_id, r.match_confidence)
           for r in identity.match_in_block(players, squad).collect()}
    assert got == {"1": ("a", 95.0), "2": ("b", 95.0), "3": (None, None), "4": ("x", 94.0),
                   "5": (None, None)}


CANDIDATE = "entity_id string, external_id string, name string, club_name string"


def search(make, candidates, team="Barcelona"):
    entities = make("entity_id string, player_name string, team string",
                    [("e", "Robert Lewandowski", team)])
    scored = identity.score_candidates(
        entities, make(CANDIDATE, [("e", *c) for c in candidates]))
    return scored, identity.best_match(entities, scored)


def test_best_match_rules(make):
    _, alone = search(make, [("1", "Robert Lewandowski", "Chicago Fire")])
    assert alone.first().match_confidence == 100.0 and alone.first().match_method == "exact"
    _, club = search(make, [("1", "Robert Lewandowski", "Chicago Fire"),
                            ("2", "Robert Lewandowsky", "FC Barcelona")])
    assert club.first().external_id == "2"
    _, tie = search(make, [("1", "Robert Lewandowski", "Chicago Fire"),
                           ("2", "Robert Lewandowski", None)])
    assert tie.first().match_confidence == 85.0 and tie.first().match_method == "fuzzy"
    _, nobody = search(make, [("1", "Someone Else", None)])
    assert nobody.first().external_id is None


@pytest.mark.parametrize("careers, chosen, method", [
    ([("2", "FC Barcelona"), ("1", "Legia")], "2", "history"),
    ([("2", "FC Barcelona"), ("1", "Barcelona")], "1", "fuzzy"),
    ([("1", "Legia")], "1", "fuzzy"),
])
def test_homonyms_split_by_career(make, careers, chosen, method):
    scored, match = search(make, [("1", "Robert Lewandowski", "Chicago Fire"),
                                  ("2", "Robert Lewandowski", None)])
    history = make("external_id string, club string", careers)
    row = identity.confirm_by_history(match, scored, history).first()
    assert (row.external_id, row.match_method) == (chosen, method)


def test_folding_equals_the_unicode_tables(make):
    """Every character that decomposes to ASCII, against Python's own normalisation."""
    import re
    import sys
    import unicodedata

    chars = [chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.decomposition(chr(c))]
    rows = [(i, f"a{c}b") for i, c in enumerate(chars)] + [(-1, "a\u2009b"), (-2, "Ⅳ x"), (-3, "ß\u3000Ø")]
    got = {r.i: r.n for r in make("i int, t string", rows).select("i", text.normalise_name("t").alias("n")).collect()}
    for i, raw in rows:
        plain = unicodedata.normalize("NFKD", raw).encode("ascii", "ignore").decode().lower()
        assert got[i] == re.sub("[^a-z0-9]+", " ", plain).strip(), raw
    assert got[-1] == "a b" and got[-2] == "iv x"


def test_one_block_of_many_names(make, spark):
    """20,000 names in one block: few candidates, and none lost against all pairs."""
    rng = random.Random(11)
    syllables = [a + b for a in "bcdfglmnprstvz" for b in ("a", "e", "i", "o", "u", "an", "er", "il", "os")]
    word = lambda: "".join(rng.choices(syllables, k=rng.choice([2, 2, 3, 4])))
    names = {" ".join(sorted([word(), word()])) for _ in range(10_000)}
    near = {" ".join(sorted((n[:-1] + rng.choice("aeiou") + rng.choice(["", " de"])).split())) for n in names}
    every = sorted(names | near)
    assert len(every) > 15_000
    left = make("block string, left_name string", [("b", n) for n in every])
    right = make("block string, right_name string", [("b", n) for n in every])
    found = close_pairs(left, right, 85.0, score=False).cache()
    assert found.count() < 0.01 * len(every) ** 2
    probe = set(rng.sample(every, 20))
    got = {(r.left_name, r.right_name) for r in found.where(found.left_name.isin(*probe)).collect()}
    found.unpersist()
    want = {(a, b) for a in probe for b in every if ratio(a, b) >= 85.0}
    assert want <= got and len(want) > 30


def test_cells_and_word_order_lose_nothing(make, names, monkeypatch):
    """Blocks cut into cells of a few texts; without a score, word order does not matter."""
    monkeypatch.setattr(fuzzyjoin, "CELL", 9)
    monkeypatch.setattr(fuzzyjoin, "HELD", 30)
    left, right = frames(make, names)
    scored = {(r.left_name, r.right_name): r.score for r in close_pairs(left, right, 80.0).collect()}
    pairs = list(itertools.product(*names))
    assert scored == pytest.approx({p: ratio(*p) for p in pairs if ratio(*p) >= 80.0})
    loose = [(r.left_name, r.right_name) for r in close_pairs(left, right, 80.0, score=False).collect()]
    assert len(loose) == len(set(loose))
    turned = lambda n: " ".join(reversed(n.split()))
    assert {p for p in pairs if ratio(turned(p[0]), p[1]) >= 80.0 or ratio(*p) >= 80.0} <= set(loose)


def test_names_are_never_broadcast(make):
    """Their files are a tenth of their size in memory, so no join may send a side whole."""
    teams = make("block string, team string", [("1", f"red club {i}") for i in range(9)])
    clubs = make("block string, club_id string, name string", [("1", f"c{i}", f"FC red club {i}") for i in range(9)])
    one, two = teams.toDF("block", "left_name"), clubs.select("block", "name").toDF("block", "right_name")
    players = teams.toDF("block", "player_name").selectExpr("player_name AS entity_id", "*")
    squad = clubs.withColumnRenamed("club_id", "external_id")
    for df in (identity.club_pairs(one, two, 70.0), identity.match_clubs(teams, clubs), identity.match_in_block(players, squad)):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
