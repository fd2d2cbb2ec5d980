"""Quality classifier on supervised subword embeddings.

Every word, every character n-gram within a word (blanks marking its ends) and every step
from a word to the next (same word, or the kinds of characters they end in) is hashed to a
learned vector. A document is the average of each group's vectors, added up; a linear
layer and a softmax give the classes. Vectors and layer are trained by stochastic gradient
descent in numpy, on the driver, over a bounded sample of labelled documents.

A class score is linear in the vectors, so for scoring each vector is multiplied by the
layer once and the products are averaged: the same number, with one value per bucket
instead of a vector.

Defined results: null and empty texts have no features and score by the bias alone; with
one class only, or no label at all, the score is the same for all, by the counts of labels
(add-one); repeated rows score alike; an empty table gives no rows. Labels, ids and other
columns never enter a score. Scoring is one pass without a shuffle, over whole texts, in
slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintry.llm.columns import append, map_batches, slices
from vintry.llm.sampling import class_counts, held_out, labelled_sample, usable_labels

# Training takes at most so many documents of each class.
PER_CLASS = 2000
GRAMS = (3, 4, 5)
BUCKET_BITS = 17
DIMENSIONS = 8
EPOCHS = 6
RATE = 0.3
VECTOR_RATE = 20.0
# Characters hashed at once.
SLICE = 200_000

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BUCKETS = 1 << BUCKET_BITS
GROUPS = 3  # words, n-grams, steps
_BLANKS = np.array([9, 10, 11, 12, 13, 32], np.uint32)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_UP = _powers(_BASE, SLICE * 2)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), SLICE * 2)


def _bucket(hashes: np.ndarray, salt: int) -> np.ndarray:
    mixed = (hashes + np.uint64(salt)) * _MIX
    return ((mixed ^ (mixed >> np.uint64(32))) * _MIX >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _kinds(units: np.ndarray) -> np.ndarray:
    """0 lower case and other letters, 1 capital, 2 digit, 3 sign."""
    kind = np.zeros(len(units), np.uint64)
    kind[(units >= 65) & (units <= 90) | (units >= 192) & (units <= 222)] = 1
    kind[(units >= 48) & (units <= 57)] = 2
    kind[(units < 48) | (units > 57) & (units < 65) | (units > 90) & (units < 97) | (units > 122) & (units < 192)] = 3
    return kind


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of bounded length, cut after a blank where there is one."""
    start = 0
    while len(text) - start > SLICE:
        cut = max(text.rfind(" ", start, start + SLICE), text.rfind("\n", start, start + SLICE))
        cut = cut + 1 if cut > start else start + SLICE
        yield text[start:cut]
        start = cut
    yield text[start:]


def features(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, owner, bucket) of every feature of some texts of bounded joint length."""
    joint = " " + "  ".join(texts) + " "
    units = np.frombuffer(joint.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    blank = np.isin(units, _BLANKS)
    units = np.where(blank, np.uint32(32), units)
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * _UP[: len(units)], out=sums[1:])

    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    words = (sums[ends] - sums[starts]) * _DOWN[starts]
    yield 0, owner[starts], _bucket(words, 1)

    blanks = np.concatenate(([0], np.cumsum(blank)))
    for n in GRAMS:
        if len(units) < n:
            continue
        at = np.arange(len(units) - n + 1)
        # No blank inside; blanks at either end stand for the ends of a word.
        inside = blanks[at + n - 1] == blanks[at + 1]
        at = at[inside & ~(blank[at] & blank[at + n - 1] & (n < 3))]
        grams = (sums[at + n] - sums[at]) * _DOWN[at]
        yield 1, owner[at], _bucket(grams, n)

    if len(starts) > 1:
        kinds = _kinds(units[ends - 1]) * np.uint64(4) + _kinds(units[starts])
        step = kinds[:-1] * np.uint64(16) + kinds[1:]
        step = np.where(words[1:] == words[:-1], np.uint64(1 << 20), step)
        within = owner[starts[1:]] == owner[starts[:-1]]
        yield 2, owner[starts[1:]][within], _bucket(step[within], 99)


def _batches(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Pieces of texts with their owners, of bounded joint length."""
    owners, pieces = [], []
    for i, text in enumerate(texts):
        for piece in _pieces(text or ""):
            owners.append(i)
            pieces.append(piece)
    for a, b in slices(pieces, SLICE):
        yield owners[a:b], pieces[a:b]


@dataclass
class Model:
    """Buckets multiplied by the layer, one value each, and the bias of class 1 over 0."""

    values: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        sums = np.zeros((GROUPS, len(texts)))
        counts = np.zeros((GROUPS, len(texts)))
        for owners, pieces in _batches(texts):
            of, n = np.array(owners), len(pieces)
            for group, owner, bucket in features(pieces):
                # One slice adds to a text once, in the order of its places.
                np.add.at(sums[group], of, np.bincount(owner, self.values[bucket], n))
                np.add.at(counts[group], of, np.bincount(owner, minlength=n))
        logit = (sums / np.maximum(counts, 1)).sum(axis=0) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their weights in the document's vector."""
    found: list[list[np.ndarray]] = [[] for _ in range(GROUPS)]
    for _, pieces in _batches([text]):
        for group, _, bucket in features(pieces):
            found[group].append(bucket)
    every = [np.concatenate(some) if some else np.zeros(0, np.int64) for some in found]
    shares = np.concatenate([np.full(len(some), 1 / max(len(some), 1)) for some in every])
    buckets, places = np.unique(np.concatenate(every), return_inverse=True)
    weights = np.bincount(places, shares, len(buckets))
    return buckets.astype(np.int32), weights.astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], prior: float) -> Model:
    """Stochastic gradient descent, one document at a time.

    The sample holds as many documents of either class as there are; ``prior`` is the
    logarithm of the ratio by which the classes differ from that in all labels.
    """
    random = np.random.default_rng(7)
    vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (_BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = random.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    done, steps = 0, EPOCHS * max(len(rows), 1)
    for _ in range(EPOCHS):
        for i in random.permutation(len(rows)):
            buckets, weights, y = rows[i]
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = weights @ vectors[buckets]
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            back = layer @ p
            layer -= rate * np.outer(hidden, p)
            bias -= rate * p
            # The vectors' own rate is larger, as each has but a small share in a document.
            vectors[buckets] -= (rate * VECTOR_RATE) * weights[:, None] * back
    values = vectors @ (layer[:, 1] - layer[:, 0])
    return Model(values.astype(np.float32), float(bias[1] - bias[0]) + prior)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    per_class: int = PER_CLASS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> Model:
    """Learn from at most ``per_class`` documents of each class that are not held out."""
    usable = usable_labels(labels, label, id_column)
    zeros, ones = class_counts(usable)
    sample = labelled_sample(docs, usable, per_class, id_column, text_column)

    def extracted(texts: pa.Array) -> pa.Array:
        found = [document_features(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([b.tobytes() for b, _ in found], pa.binary()),
             pa.array([w.tobytes() for _, w in found], pa.binary())],
            ["buckets", "weights"],
        )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["__id"])
        learnt = [
            (np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["weights"], np.float32), r["y"])
            for r in rows
        ]
        seen = [sum(1 for r in learnt if r[2] == y) for y in (0, 1)]
        if all(seen):
            model = train(learnt, float(np.log(ones / zeros) - np.log(seen[1] / seen[0])))
            yield pa.RecordBatch.from_pydict({"values": [model.values.tobytes()], "bias": [model.bias]})

    rows = append(sample, extracted, ["text"], "buckets binary, weights binary")
    # The sample is bounded, so one task learns from it; only the model comes to the driver.
    one = rows.select("__id", "y", "buckets", "weights").repartition(1)
    made = map_batches(one, learn, "values binary, bias double").first()
    if made is None:
        return Model(np.zeros(_BUCKETS, np.float32), float(np.log((ones + 1) / (zeros + 1))))
    return Model(np.frombuffer(made["values"], np.float32), made["bias"])


def score(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 if at least 0.5); both are replaced."""

    def scored(texts: pa.Array) -> pa.Array:
        found = model.score(texts.to_pylist())
        return pa.StructArray.from_arrays(
            [pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["score", "predicted"]
        )

    return append(docs, scored, [text_column], "score double, predicted int")


def classified(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    per_class: int = PER_CLASS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Fit on the labels and score every document; adds ``held_out`` as well."""
    model = fit(docs, labels, label, per_class, id_column, text_column)
    return score(docs.withColumn("held_out", held_out(id_column)), model, text_column)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents predicted to be of good quality, with their columns unchanged."""
    model = fit(docs, labels)
    scored = score(docs.select(F.struct("*").alias("__vintry_row"), "text"), model)
    return scored.where("predicted = 1").select("__vintry_row.*")
