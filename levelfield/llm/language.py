"""Language identification with a blended-spectrum string kernel.

A text is the set of its hashed character n-grams (n = 1 to 4) over the whole text, kept
per n; the kernel of two texts is the cosine of the two presence sets, blended over n.
Nystroem landmarks turn it into a feature map, and one-versus-rest kernel ridge regression
on that map is one matrix: a batch of texts is scored by two matrix products.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levelfield.llm.words import groups, mix
from levelfield.session import materialise

#: Training rows, at most: the ones whose hashed texts come first.
SAMPLE = 3_000
#: Training texts have at most so many characters, which bounds what the driver holds.
TRAIN_CHARS = 20_000
LANDMARKS = 256
ORDERS = (1, 2, 3, 4)
#: Hash slots of each n-gram order.
SLOTS = (256, 1 << 11, 1 << 12, 1 << 13)
RIDGE = 1e-3
#: Longest passage that is cut out of a training text besides the whole text.
PASSAGE = 600
NO_LANGUAGE = "und"

_LETTER = regex.compile(r"\p{L}")
_OFFSET = np.r_[0, np.cumsum(SLOTS)]
_WIDTH = int(_OFFSET[-1])


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


def presence(texts: list[str]) -> np.ndarray:
    """One row per text: 1 for each n-gram slot that the lower-cased text touches,
    scaled so that every order has unit length.  Runs over whole texts."""
    out = np.zeros((len(texts), _WIDTH), np.float32)
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    owner = np.repeat(np.arange(len(texts)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    place = np.arange(len(codes))
    rolled = np.zeros(len(codes), np.uint64)
    for k, (n, slots) in enumerate(zip(ORDERS, SLOTS)):
        size = max(len(codes) - n + 1, 0)
        rolled = rolled[:size] * np.uint64(0x100000001B3) + codes[n - 1 : n - 1 + size] + np.uint64(1)
        inside = place[:size] + n <= end[:size]
        slot = (mix(rolled) >> np.uint64(20)) % np.uint64(slots)
        part = out[:, _OFFSET[k] : _OFFSET[k + 1]]
        part[owner[:size][inside], slot[inside].astype(np.int64)] = 1
        part /= np.sqrt(np.maximum(part.sum(1, keepdims=True), 1))
    return out / np.float32(np.sqrt(len(ORDERS)))


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # presence rows
    weights: np.ndarray  # landmark kernel -> one margin per language
    scale: float

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score in 0..1; NO_LANGUAGE and 0 without a letter or a model."""
        lettered = np.array([has_letter(t) for t in texts], bool)
        names, score = [NO_LANGUAGE] * len(texts), np.zeros(len(texts))
        rows = np.flatnonzero(lettered)
        if len(rows) and self.languages:
            margin = presence([texts[i] for i in rows]) @ self.landmarks.T @ self.weights[:-1] + self.weights[-1]
            z = np.exp(self.scale * (margin - margin.max(1, keepdims=True)))
            share = z / z.sum(1, keepdims=True)
            best = margin.argmax(1)
            score[rows] = share[np.arange(len(rows)), best]
            for i, b in zip(rows, best):
                names[i] = self.languages[b]
        return names, score


def passages(texts: list[str], labels: list[str]) -> tuple[list[str], list[str]]:
    """Training texts and passages of them, so that short texts are learned as well."""
    out, names = [], []
    for text, label in zip(texts, labels):
        out.append(text)
        names.append(label)
        if len(text) > PASSAGE:
            middle = (len(text) - PASSAGE) // 2
            for size in (40, 160, PASSAGE):
                out.append(text[middle : middle + size])
                names.append(label)
    kept = [i for i, t in enumerate(out) if has_letter(t)]
    return [out[i] for i in kept], [names[i] for i in kept]


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, seed: int = 1) -> Model:
    """Kernel ridge regression of +1/-1 per language on the Nystroem map."""
    texts, labels = passages(texts, labels)
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((0, _WIDTH), np.float32), np.zeros((1, 0), np.float32), 1.0)
    rng = np.random.default_rng(seed)
    index = np.array([languages.index(label) for label in labels])
    per = max(1, landmarks // len(languages))
    chosen = np.concatenate(
        [rng.permutation(np.flatnonzero(index == k))[:per] for k in range(len(languages))]
    )
    marks = np.concatenate([presence([texts[i] for i in chosen[k : k + 64]]) for k in range(0, len(chosen), 64)])
    # Presence rows are wide, so they live for one batch only; kernel rows are kept.
    kernel = np.concatenate([presence(texts[i : i + 128]) @ marks.T for i in range(0, len(texts), 128)])
    kernel = np.c_[kernel, np.ones(len(kernel))].astype(np.float64)
    target = np.where(index[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # Rows of rarer languages weigh more, so each language has the same say.
    weight = (len(index) / len(languages) / np.bincount(index, minlength=len(languages)))[index][:, None]
    own = marks @ marks.T
    penalty = np.zeros((len(chosen) + 1, len(chosen) + 1))
    penalty[:-1, :-1] = own + 1e-6 * np.eye(len(chosen))
    left = kernel.T @ (weight * kernel) + ridge * len(kernel) * penalty
    weights = np.linalg.solve(left + 1e-9 * np.eye(len(left)), kernel.T @ (weight * target))
    return Model(languages, marks, weights.astype(np.float32), 4.0)


def predictions(
    docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """id, lang_pred, score of every whole text, in input order, one row per row.

    A null text, or one without a letter, is NO_LANGUAGE with score 0.  ``carry`` names
    columns to hand through in a struct ``carried``, which saves joining the answer back.
    Repeated rows answer alike, null ids stay null, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []),
    )

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw in groups(batches, "text"):
            texts = [t.decode("utf-8", "replace") for t in raw]
            for at in range(0, len(texts), 128):
                names, score = shared.value.predict(texts[at : at + 128])
                part = rows.slice(at, len(names))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(score), *part.columns[2:]],
                    ["id", "lang_pred", "score", *part.schema.names[2:]],
                )

    schema = T.StructType(
        [
            own.schema["id"],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            *own.schema.fields[2:],
        ]
    )
    return own.mapInArrow(make, schema)


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` rows with a text and a language.

    The sample is split evenly over the languages found, in order of the hashed text, so
    a language with a third of all rows does not crowd out the others.  Equal texts count
    once; texts of over TRAIN_CHARS characters are not learned from.
    """
    usable = docs.where(
        F.col(lang_col).isNotNull() & (F.char_length(text_col) <= TRAIN_CHARS)
    ).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"))
    keys = materialise(usable.select("lang", "h").distinct(), "languages")
    sizes = materialise(keys.groupBy("lang").agg(F.count("*").alias("n")), "language-sizes")
    each = max(1, sample // max(sizes.count(), 1))
    # Rows beyond twice the expected hash go before the window, so that a language with most
    # of the rows leaves no more of them than the others.
    mark = F.shiftrightunsigned("h", 11).cast("double") / F.lit(float(1 << 53))
    near = keys.join(sizes, "lang").where(mark * F.col("n") <= 2 * each + 100)
    order = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 11), "h")
    nth = near.select("lang", "h", F.row_number().over(order).alias("nth"))
    first = materialise(nth.where(F.col("nth") <= each).drop("nth"), "language-sample")
    rows = usable.join(first, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    got = rows.orderBy("lang", "h").toPandas()
    return fit(got["text"].tolist(), got["lang"].tolist())
