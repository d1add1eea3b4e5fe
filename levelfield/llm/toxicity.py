"""Toxicity: a convolutional text classifier trained on all labelled rows.

Words are hashed to embeddings (the word's slot plus its first letters' slot), filters of
several widths slide over the whole text, each filter's largest answer is kept, and a
logistic layer reads these.  Thresholds are calibrated per language, where the language is
the one the text itself looks like, never a column; the score is the calibrated margin
through a logistic curve, so 0.5 is the threshold of every language.

Training is a number of turns; in a turn every task learns from its part of the rows,
starting from the same weights, and the moves of all tasks are averaged by slot.  Counts
behind the first weights, the languages and the thresholds are sums over all rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levelfield.llm.pieces import settle
from levelfield.llm.words import Words, groups, span_hashes
from levelfield.session import materialise

#: Labelled rows a learner has about, and learners at most; more rows make longer turns.
SHARE, LEARNERS = 4_096, 64
#: Turns over all rows: as many as give about STEPS looks at a row, within these bounds.
STEPS, TURNS = 60_000, (3, 10)
#: Cells a unit of margin is cut into for the thresholds, and margins beyond which all are one.
CELLS, FAR = 1_024, 32
#: Words a training step holds at a time, unless one text has more.
HELD = 100_000
SLOTS, STEM_SLOTS, STEM = 1 << 15, 1 << 12, 5
DIM, FILTERS, WIDTHS = 16, 24, (1, 2, 3)
BATCH, RATE = 32, 0.05
PAD = max(WIDTHS)  # so that a text without words has a window of every width

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c < 128 and not (48 <= c <= 57 or 97 <= c <= 122) else c for c in range(256)
)


@dataclass
class Tokens:
    """Slots of the words of some texts, PAD empty words after every text."""

    word: np.ndarray
    stem: np.ndarray
    first: np.ndarray  # where text i begins; one more entry than texts


def tokens(texts: list[bytes]) -> Tokens:
    """Words after lower-casing A-Z and turning other ASCII signs into blanks."""
    words = Words([t.translate(_FOLD) for t in texts])
    word = (words.hash % np.uint64(SLOTS - 1)).astype(np.int64) + 1
    stem_end = np.minimum(words.end, words.start + STEM)
    stem = (span_hashes(words.data, words.start, stem_end) % np.uint64(STEM_SLOTS - 1)).astype(np.int64) + 1
    first = words.first + PAD * np.arange(len(words.first))
    place = np.arange(len(word)) + PAD * words.text_of
    out_w, out_s = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64)
    out_w[place], out_s[place] = word, stem
    return Tokens(out_w, out_s, first)


@dataclass
class Model:
    word: np.ndarray
    stem: np.ndarray
    filters: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    languages: list[str] = field(default_factory=list)
    looks: np.ndarray | None = None  # word slot -> log odds of each language
    threshold: np.ndarray | None = None  # per language; without one, one for all
    slope: float = 1.0

    def answers(self, t: Tokens) -> list[np.ndarray]:
        """Per width the filter answers at every place; places past a text's end are -inf."""
        x = self.word[t.word] + self.stem[t.stem]
        found = []
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            n = len(x) - w + 1
            a = x[:n] @ f[0]
            for o in range(1, w):
                a += x[o : o + n] @ f[o]
            found.append(a + b)
        return found

    def margins(self, t: Tokens) -> np.ndarray:
        """Every text's answer; windows reach over its PAD empty words and no further."""
        total = np.full(len(t.first) - 1, self.out_bias)
        for k, (w, a) in enumerate(zip(WIDTHS, self.answers(t))):
            a = np.concatenate([a, np.full((w - 1, a.shape[1]), -np.inf, a.dtype)])
            for gone in range(1, w):  # windows that begin at the last w - 1 places reach the next text
                a[t.first[1:] - gone] = -np.inf
            pooled = np.maximum(np.maximum.reduceat(a, t.first[:-1], axis=0), 0)
            total += pooled @ self.out[k]
        return total

    def language_of(self, t: Tokens) -> np.ndarray:
        """Index of the language each text looks like."""
        if self.looks is None or len(self.languages) < 2:
            return np.zeros(len(t.first) - 1, np.int64)
        running = np.cumsum(np.concatenate([np.zeros((1, len(self.languages))), self.looks[t.word]]), axis=0)
        return (running[t.first[1:]] - running[t.first[:-1]]).argmax(1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        t = tokens(texts)
        limit = 0.0 if self.threshold is None else self.threshold[self.language_of(t)]
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.margins(t) - limit), -30, 30)))


def _start(ids: list[Tokens], toxic: np.ndarray, rng: np.random.Generator) -> Model:
    """`_begin` from the counts of some texts."""
    seen = {k: np.zeros((2, n)) for k, n in (("word", SLOTS), ("stem", STEM_SLOTS))}
    for t, y in zip(ids, toxic):
        seen["word"][int(y), np.unique(t.word)] += 1
        seen["stem"][int(y), np.unique(t.stem)] += 1
    return _begin(seen["word"], seen["stem"], np.array([np.sum(toxic == 0), np.sum(toxic == 1)]), rng)


def _begin(words: np.ndarray, stems: np.ndarray, total: np.ndarray, rng: np.random.Generator) -> Model:
    """Small random weights; the first dimension of a slot is its log odds of being toxic,
    from the number of texts of either class that have it."""

    def odds(seen: np.ndarray) -> np.ndarray:
        rate = (seen + 0.5) / (total[:, None] + 1)
        return np.clip(np.log(rate[1] / rate[0]), -3, 3)

    word, stem = (rng.normal(0, 0.1, (n, DIM)).astype(np.float32) for n in (SLOTS, STEM_SLOTS))
    word[:, 0], stem[:, 0] = odds(words) / 2, odds(stems) / 2
    word[0], stem[0] = 0, 0
    filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    return Model(
        word,
        stem,
        filters,
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, (len(WIDTHS), FILTERS)).astype(np.float32),
        0.0,
    )


def _join(parts: list[Tokens]) -> Tokens:
    sizes = np.cumsum([0] + [len(p.word) for p in parts])
    return Tokens(np.concatenate([p.word for p in parts]), np.concatenate([p.stem for p in parts]), sizes)


def _learn(model: Model, batches: Iterable[tuple[Tokens, np.ndarray]], share: float, rate: float) -> None:
    """One turn of Adagrad on the logistic loss; both classes weigh the same, ``share`` of
    all rows being toxic."""
    state: dict[str, np.ndarray] = {}

    def move(name: str, value: np.ndarray, grad: np.ndarray) -> None:
        seen = state.setdefault(name, np.full(value.shape, 1e-3, np.float32))
        seen += grad * grad
        value -= rate * grad / np.sqrt(seen)

    for t, toxic in batches:
        weight = np.where(toxic == 1, 0.5 / share, 0.5 / (1 - share))
        peaks, pooled = [], []
        for w, a in zip(WIDTHS, model.answers(t)):
            place = np.stack([s + a[s : e - w + 1].argmax(0) for s, e in zip(t.first[:-1], t.first[1:])])
            peaks.append(place)
            pooled.append(np.maximum(np.take_along_axis(a, place, 0), 0))
        margin = sum(p @ model.out[k] for k, p in enumerate(pooled)) + model.out_bias
        wrong = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - toxic) * weight / len(toxic)).astype(np.float32)
        slots_w, slots_s, pulls = [], [], []
        for k, w in enumerate(WIDTHS):
            pull = wrong[:, None] * model.out[k][None, :] * (pooled[k] > 0)
            out_grad = pooled[k].T @ wrong + 1e-4 * model.out[k]
            grads = np.zeros_like(model.filters[k])
            for o in range(w):
                spot = np.minimum(peaks[k] + o, len(t.word) - 1)
                x = model.word[t.word[spot]] + model.stem[t.stem[spot]]
                grads[o] = np.einsum("bf,bfd->df", pull, x)
                slots_w.append(t.word[spot].ravel())
                slots_s.append(t.stem[spot].ravel())
                pulls.append((pull[:, :, None] * model.filters[k][o].T[None]).reshape(-1, DIM))
            move(f"f{k}", model.filters[k], grads)
            move(f"b{k}", model.bias[k], pull.sum(0))
            move(f"o{k}", model.out[k], out_grad)
        model.out_bias -= rate * float(wrong.sum())
        for name, table, slots in (("w", model.word, slots_w), ("s", model.stem, slots_s)):
            used, back = np.unique(np.concatenate(slots), return_inverse=True)
            grad = np.zeros((len(used), DIM), np.float32)
            np.add.at(grad, back, np.concatenate(pulls))
            seen = state.setdefault(name, np.full(table.shape, 1e-3, np.float32))
            seen[used] += grad * grad
            table[used] -= rate * grad / np.sqrt(seen[used])
            table[0] = 0


def _looks(model: Model, seen: dict[str, np.ndarray]) -> None:
    """Learn which language a word slot speaks for, from the texts of each that have it."""
    names = sorted(seen)
    model.languages = names or ["any"]
    if len(names) < 2:
        return
    counts = 0.1 + np.stack([seen[name] for name in names], axis=1)
    share = counts / counts.sum(0, keepdims=True)
    looks = np.log(share) - np.log(share).mean(1, keepdims=True)
    looks[0] = 0
    model.looks = looks


def _best_cut(margin: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """The margin with the most right answers of either class, each class weighed alike.

    ``margin`` ascends; the rows of either class at each are counted.
    """
    below_toxic = np.r_[0, np.cumsum(toxic)] / max(toxic.sum(), 1)
    below_clean = np.r_[0, np.cumsum(clean)] / max(clean.sum(), 1)
    cuts = np.r_[margin[0] - 1, (margin[1:] + margin[:-1]) / 2, margin[-1] + 1]
    gain = below_clean - below_toxic
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(cuts[best].mean())


def _calibrate(model: Model, cell: np.ndarray, guess: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> None:
    """Thresholds from the rows counted by cell of their margin and language guessed.

    A language with fewer than ten rows of either class takes the threshold of all.
    """

    def best(mine: np.ndarray) -> float:
        at, back = np.unique(cell[mine], return_inverse=True)
        return _best_cut(at / CELLS, np.bincount(back, clean[mine]), np.bincount(back, toxic[mine]))

    model.threshold = np.full(max(len(model.languages), 1), best(np.ones(len(cell), bool)))
    for k in range(len(model.languages)):
        mine = guess == k
        if min(clean[mine].sum(), toxic[mine].sum()) >= 10:
            model.threshold[k] = best(mine)
    off, n = cell / CELLS - model.threshold[guess], clean + toxic
    mean = (off * n).sum() / n.sum()
    model.slope = float(4 / max(np.sqrt(((off - mean) ** 2 * n).sum() / n.sum()), 1e-6))


def _flat(model: Model) -> np.ndarray:
    """All weights as rows of DIM: word slots, stem slots, then the rest."""
    rest = np.concatenate([*(f.ravel() for f in model.filters), *model.bias, model.out.ravel(), [model.out_bias]])
    return np.concatenate([model.word, model.stem, np.resize(np.r_[rest, np.zeros(-len(rest) % DIM)], (-(-len(rest) // DIM), DIM))])


def _unflat(model: Model, rows: np.ndarray) -> Model:
    rest, at = rows[SLOTS + STEM_SLOTS :].ravel(), 0

    def take(like: np.ndarray) -> np.ndarray:
        nonlocal at
        at += like.size
        return rest[at - like.size : at].reshape(like.shape).astype(np.float32)

    word, stem = rows[:SLOTS].astype(np.float32), rows[SLOTS : SLOTS + STEM_SLOTS].astype(np.float32)
    filters, bias, out = [take(f) for f in model.filters], [take(b) for b in model.bias], take(model.out)
    return Model(word, stem, filters, bias, out, float(rest[at]))


def _batches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Tokens, np.ndarray]]:
    """Up to BATCH rows of (text, toxic) at a time, of about HELD words at most."""
    ids: list[Tokens] = []
    toxic: list[int] = []
    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            ids.append(tokens([text.encode()]))
            toxic.append(y)
            if len(ids) == BATCH or sum(len(t.word) for t in ids) > HELD:
                yield _join(ids), np.array(toxic)
                ids, toxic = [], []
    if ids:
        yield _join(ids), np.array(toxic)


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Texts that have each slot: words and stems by class in the rows learned from, words by
    language in all; and the number of rows by (held, class)."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], np.ndarray] = {}

        def at(kind: str, name: str, slots: np.ndarray) -> None:
            seen.setdefault((kind, name), np.zeros(SLOTS, np.int64))[slots] += 1

        for batch in batches:
            for text, y, lang, held in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "lang", "held"))):
                t = tokens([text.encode()])
                words = np.unique(t.word)
                at("rows", f"{int(held)}{y}", np.zeros(1, np.int64))
                if lang is not None:
                    at("lang", lang, words)
                if not held:
                    at("word", str(y), words)
                    at("stem", str(y), np.unique(t.stem))
        for (kind, name), count in seen.items():
            slot = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(slot)), pa.array([name] * len(slot)), pa.array(slot), pa.array(count[slot])],
                ["kind", "name", "slot", "n"],
            )

    parts = rows.select("text", "toxic", "lang", "held").mapInArrow(add, "kind string, name string, slot long, n long")
    got = parts.groupBy("kind", "name", "slot").agg(F.sum("n").alias("n")).toPandas()  # bounded by slots and languages
    words, stems, total = np.zeros((2, SLOTS)), np.zeros((2, STEM_SLOTS)), np.zeros((2, 2))
    languages = {}
    for (kind, name), g in got.groupby(["kind", "name"]):
        slot, n = g["slot"].to_numpy(), g["n"].to_numpy()
        if kind == "rows":
            total[int(name[0]), int(name[1])] = n.sum()
        elif kind == "lang":
            languages[name] = np.zeros(SLOTS)
            languages[name][slot] = n
        else:
            (words if kind == "word" else stems)[int(name)][slot] = n
    return words, stems, languages, total


def _turn(rows: DataFrame, model: Model, share: float, rate: float) -> Model:
    """A turn of all learners, each over its own part of the rows, from one model; weights
    move by the mean of what the learners that touched them found.

    Moves are summed as whole numbers, so their order does not matter.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    unit = float(1 << 32)
    names = [f"v{k}" for k in range(DIM)]

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = _flat(shared.value)
        mine = _unflat(shared.value, before)
        _learn(mine, _batches(batches), share, rate)
        moved = _flat(mine) - before
        slot = np.flatnonzero(moved.any(1))
        whole = np.round(moved[slot].astype(np.float64) * unit).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(slot), pa.array(np.ones(len(slot), np.int64)), *(pa.array(np.ascontiguousarray(c)) for c in whole.T)],
            ["slot", "n", *names],
        )

    schema = "slot long, n long, " + ", ".join(f"{c} long" for c in names)
    parts = rows.select("text", "toxic").mapInArrow(learn, schema)
    got = parts.groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).toPandas()  # a row a slot
    flat = _flat(model).astype(np.float64)
    flat[got["slot"].to_numpy()] += got[names].to_numpy(np.float64) / unit / got["n"].to_numpy()[:, None]
    return _unflat(model, flat)


def _held_margins(rows: DataFrame, model: Model) -> tuple[np.ndarray, ...]:
    """Counts of clean and toxic rows by cell of the margin and language guessed."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, toxic in _batches(batches):
            cell = np.round(np.clip(shared.value.margins(t), -FAR, FAR) * CELLS).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(shared.value.language_of(t).astype(np.int64)), pa.array(toxic.astype(np.int64))],
                ["cell", "guess", "toxic"],
            )

    found = rows.select("text", "toxic").mapInArrow(make, "cell long, guess long, toxic long").groupBy("cell", "guess")
    got = found.agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic")).toPandas()  # bounded by cells
    return tuple(got[c].to_numpy(t) for c, t in (("cell", np.int64), ("guess", np.int64), ("clean", float), ("toxic", float)))


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    label_col: str = "toxic", seed: int = 1,
) -> Model:
    """A model from all labelled rows: four fifths are learned from, the rest set thresholds.

    Null labels, ids and texts are left out; of repeated ids the highest label counts.
    Without both classes every text scores alike, below 0.5 unless all rows are toxic.
    """
    marks = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).cast("int").alias("toxic"))
    )
    usable = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    rows = usable.join(marks, "id").groupBy("id").agg(
        F.max("toxic").alias("toxic"), F.min("text").alias("text"), F.min("lang").alias("lang")
    )
    learners = int(np.clip(marks.count() // SHARE, 1, LEARNERS))
    mark = F.xxhash64("id")
    dealt = rows.withColumns({"mark": mark, "held": F.pmod(mark, F.lit(5)) == 4})
    own = dealt.repartition(learners, "mark").sortWithinPartitions("mark", "id")
    rows = materialise(own, "toxicity-rows", codec="zstd")
    settle(docs.sparkSession)  # gives the shuffled texts back
    words, stems, languages, total = _counts(rows)
    rng = np.random.default_rng(seed)
    model = _begin(words, stems, total[0], rng)
    if (total == 0).any():
        model.out[:] = 0
        model.out_bias = 2.0 if total.sum() and not total[:, 0].any() else -2.0
        return model
    own = rows.where("NOT held")
    for turn in range(int(np.clip(STEPS // total[0].sum(), *TURNS))):
        model = _turn(own, model, float(total[0, 1] / total[0].sum()), RATE / (1 + turn) ** 0.5)
    _looks(model, languages)
    _calibrate(model, *_held_margins(rows.where("held"), model))
    return model


def scores(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1), predicted (1 from 0.5) of every whole text, one row per row.

    A null or empty text is scored like any other, as a text without words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in groups(batches, "text"):
            score = shared.value.score(texts).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["id", "score", "predicted"]
            )

    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("predicted", T.IntegerType()),
        ]
    )
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(make, schema)
