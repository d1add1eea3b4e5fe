"""The conversation trie against brute force, whole and cut into shards anywhere."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from levelfield.llm import turntrie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, id long, path string, shard int, node string"


def _turns(make, rows):
    """Rows with extra columns whose names the operator uses inside."""
    return make(SCHEMA, [(*r, 1, "path", 2, "node") for r in rows])


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        own[c].append(((turn is not None, turn or 0), role, _sha(text), text))
    own = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 9
        base = [] if c is None else own.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])
        built[c] = base[:h] + turns[h:]
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    least = lambda of: min((c for c in of if c is not None), default=None)
    children = defaultdict(list)
    for n in nodes:
        if n:
            children[n[:-1]].append(n)
    out = []
    leaves, saved = defaultdict(int), defaultdict(int)
    for n, of in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(of) - 1) * len(n[-1][1].encode()) if n else 0
    for n, of in nodes.items():
        ordered = sorted(ends[n], key=lambda c: (c is not None, c or 0))
        out.append((
            least(of), len(n), least(nodes[n[:-1]]) if n else None, len(of), len(children[n]), leaves[n], saved[n],
            _sha(",".join("" if c is None else str(c) for c in ordered)),
        ))
    return sorted(out, key=str)


def _told(df):
    assert tuple(df.columns) == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def _rows(seed, n=80, most=12):
    rng = random.Random(seed)
    bank = [("user", "hé"), ("assistant", "ok"), (None, None), ("system", "x" * 9), ("user", "")]
    out = []
    for c in rng.sample(range(-20, 3 * n), n):
        out += [(c, t, *rng.choice(bank)) for t in range(rng.randrange(1, most))]
    hot = [(t, *bank[t % 2]) for t in range(11)]
    for c in range(1000, 1060):  # one conversation many times
        out += [(c, *h) for h in hot]
    out += [(None, 1, "user", "of nobody"), (None, None, "user", "first"), (5000, 2, "b", "tie"), (5000, 2, "a", "tie")]
    out += [(5001, None, "user", "x"), (5001, None, "user", "x"), (5001, 0, "user", "y")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("shard", [20_000, 7, 1])
def test_trie_equals_brute_force(make, monkeypatch, shard):
    monkeypatch.setattr(turntrie, "SHARD", shard)
    monkeypatch.setattr(turntrie, "STRETCH", 10)
    rows = _rows(shard)
    assert _told(turntrie.conversation_trie(_turns(make, rows))) == _brute(rows)


def test_empty_and_turnless(make):
    assert _told(turntrie.conversation_trie(_turns(make, []))) == []
    lone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(lone, 0, "user", "gone with the head that is not there")]
    assert _told(turntrie.conversation_trie(_turns(make, rows))) == _brute(rows) == [(lone, 0, None, 1, 0, 1, 0, _sha(str(lone)))]


def test_very_long_conversation(make):
    rows = [(c, t, "user", f"turn {t}") for c in (0, 10, 20, 31) for t in range(3_000)]
    assert _told(turntrie.conversation_trie(_turns(make, rows))) == _brute_long(rows)


def _brute_long(rows):
    """Conversations 0, 10 and 20 are alike, and 31 takes its head from the absent 30."""
    h = zlib.crc32(b"31") % 9
    size = [len(f"turn {t}") for t in range(3_000)]
    both = h == 0
    out = [(0, 0, None, 4, 1 if both else 2, 1 if both else 2, (3 if both else 2) * sum(size), _sha(""))]
    n = 4 if both else 3
    for d in range(1, 3_001):
        last = d == 3_000
        ends = "0,10,20" + ",31" * both if last else ""
        out.append((0, d, 0, n, 0 if last else 1, 1, (n - 1) * sum(size[d - 1 :]), _sha(ends)))
    for d in [] if both else range(1, 3_001 - h):
        last = d == 3_000 - h
        out.append((31, d, 31 if d > 1 else 0, 1, 0 if last else 1, 1, 0, _sha("31" if last else "")))
    return sorted(out, key=str)


def test_shards_add_up():
    """Any cut of the sorted paths gives the same sums."""
    rng = random.Random(5)
    turn = lambda k: hashlib.sha256(bytes([k])).digest()
    rows = []
    for c in range(60):
        ids = [rng.randrange(2) for _ in range(rng.randrange(5))]
        rows.append((c, b"".join(map(turn, ids)), [3 + k for k in ids]))
    rows.sort(key=lambda r: (r[1], r[0]))

    def summed(cuts):
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)]) if a < b]
        split = turntrie.skeleton([(k, p[0][1], p[-1][1]) for k, p in enumerate(parts)])
        sums, whole = defaultdict(lambda: [0] * 4), []
        for k, p in enumerate(parts):
            for r in turntrie.shard_nodes(k, p, *split[k]):
                if r[0] is None:
                    whole.append((r[4], *r[5:9]))
                else:
                    for j in range(4):
                        sums[r[0], r[4]][j] += r[5 + j]
        return sorted(whole + [(d, *v) for (_, d), v in sums.items()])

    want = summed([])
    for _ in range(30):
        assert summed(sorted(rng.sample(range(1, 60), rng.randrange(8)))) == want
