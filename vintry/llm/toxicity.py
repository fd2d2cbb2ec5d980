"""Toxicity by gradient-boosted trees over a few dense features.

A document is described by the densities of two lexicons (a fixed list of insults, and
words and word beginnings that are much more frequent in toxic documents), how near second
persons stand to their words, capitals, punctuation and disguised spellings. A bounded
sample of labelled documents is dealt into folds, each class evenly. A document of a fold
is described by the lexicon learnt from the other folds, so that words which are frequent
there by chance earn no weight; later documents by the lexicon learnt from all of them.
The trees are boosted on the whole sample, with the classes weighted as in all labels, but
a rare class as much as a few leaves need at least. Margins of folds left out in turn
calibrate the score by isotonic regression. With a single document of a class no fold can
be left out, and the model's own margins calibrate it.

Defined results: null and empty texts have features of zero and a score like others; where
no labelled document is found, or only documents of one class, all get the same score, by
the counts of labels (add-one);
repeated rows score alike; an empty table gives no rows. Labels, ids and other columns
never enter a score. Scoring is one pass without a shuffle over whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintry.llm.boosting import LEAST_WEIGHT, Boosted, Isotonic, boost, isotonic
from vintry.llm.columns import append
from vintry.llm.sampling import class_counts, held_out, labelled_sample, usable_labels

# Training takes at most so many documents of each class.
PER_CLASS = 3000
# A learnt term is in so many toxic documents and such a share of them at least, and that many
# times as often as in others; the strongest are kept. A term is a word, or the beginning of words.
LEARNT_ROWS = 3
LEARNT_LEAST = 0.01
LEARNT_RATIO = 20.0
LEARNT_TERMS = 400
STEMS = (4, 5, 6)  # letters
THRESHOLD = 0.7
FOLDS = 5
NEAR = 5  # words
NARROW = 20  # words

# Insults.
INSULTS = frozenset(
    """pathetic scum moron morons trash disgusting idiot idiots idiotic loser losers clown
    clowns worthless stupid stupidity imbecile cretin dumb dumbass fool fools garbage filth
    filthy vermin coward cowards jerk bastard bastards bitch bitches asshole assholes
    shithead fuck fucking fucker fuckers shit bullshit crap whore slut retard retarded freak
    freaks lowlife parasite parasites subhuman ugly despicable
    repulsive degenerate braindead idiota imbecil estupido estupida basura asqueroso
    cretino imbécile connard salope ordure abruti dummkopf abschaum arschloch trottel
    widerlich""".split()
)
# Second persons.
SECOND = frozenset(
    """you your yours yourself yourselves u ur youre tu toi vous votre vos usted ustedes
    vosotros tú du dich dir dein deine deinen deiner ihr euch""".split()
)

_WORD = re.compile(r"[^\W_]+")
# A sign between letters; only then are the words around looked at.
_SIGN_INSIDE = re.compile(r"(?<=[^\W\d_])[0-9@$!*#+|][0-9@$!*#+|.\-_]*(?=[^\W\d_])")
_DISGUISED = re.compile(r"[^\W\d_]+(?:[0-9@$!*#+|][0-9@$!*#+|.\-_]*[^\W\d_]+)+")
_PLAIN = str.maketrans("013457@$!|+", "oleastasiit")
_GAPS = re.compile(r"[\W\d_]+")
_CAPITALS = re.compile(r"[A-Z]+")

FEATURES = (
    "words", "insults", "learnt", "hits", "hidden", "disguised", "second", "near",
    "narrow", "capitals", "shouted", "calls", "signs", "digits", "length",
)


@dataclass(frozen=True)
class Lexicon:
    """Learnt words, and learnt beginnings by their length."""

    words: frozenset[str] = frozenset()
    stems: tuple[tuple[int, frozenset[str]], ...] = ()

    def __contains__(self, word: str) -> bool:
        if word in self.words:
            return True
        for length, stems in self.stems:
            if word[:length] in stems:
                return True
        return False


def _spaced(words: list[str]) -> list[str]:
    """What runs of four and more one-letter words spell."""
    found, run = [], []
    for i in [i for i, w in enumerate(words) if len(w) == 1]:
        if run and run[-1] != i - 1:
            found.append(run)
            run = []
        run.append(i)
    return ["".join(words[i] for i in r) for r in [*found, run] if len(r) > 3]


def describe(text: str | None, learnt: Lexicon) -> list[float]:
    """The dense features of a text."""
    if not text:
        return [0.0] * len(FEATURES)
    low = text.lower()
    words = _WORD.findall(low)
    n, size = max(len(words), 1), len(text)
    distinct = set(words)
    insults, seconds = distinct & INSULTS, distinct & SECOND
    known = {w for w in distinct if w in learnt}
    marked = insults | known
    n_hits = n_insults = n_known = n_second = near = narrow = hidden = 0
    if seconds:
        second = np.array([i for i, w in enumerate(words) if w in seconds])
        n_second = len(second)
    if marked:
        hits = np.array([i for i, w in enumerate(words) if w in marked])
        n_hits, n_insults = len(hits), sum(words[i] in insults for i in hits)
        n_known = sum(words[i] in known for i in hits)
        if n_second:
            right = np.searchsorted(second, hits)
            gap = np.minimum(
                np.abs(second[np.minimum(right, n_second - 1)] - hits),
                np.abs(second[np.maximum(right - 1, 0)] - hits),
            )
            near = int((gap <= NEAR).sum())
        narrow = int((np.searchsorted(hits, hits + NARROW) - np.arange(len(hits))).max())
    disguised = len(_SIGN_INSIDE.findall(low))
    if disguised:
        for found in _DISGUISED.findall(low):
            plain = _GAPS.sub("", found.translate(_PLAIN))
            hidden += plain in INSULTS or plain in learnt
    for plain in _spaced(words):
        hidden += plain in INSULTS or plain in learnt
    capitals = _CAPITALS.findall(text)
    blanks = text.count(" ") + text.count("\n")
    return [
        float(np.log1p(n)),
        100 * n_insults / n,
        100 * n_known / n,
        float(n_hits),
        100 * hidden / n,
        100 * disguised / n,
        100 * n_second / n,
        100 * near / n,
        float(narrow),
        sum(map(len, capitals)) / size,
        sum(1 for c in capitals if len(c) > 1) / n,
        text.count("!") / n,
        max(0, size - blanks - sum(map(len, words))) / size,
        sum(map(text.count, "0123456789")) / size,
        size / n,
    ]


@dataclass
class Model:
    learnt: Lexicon
    trees: Boosted | None
    curve: Isotonic | None
    constant: float = 0.0

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.constant)
        x = np.array([describe(t, self.learnt) for t in texts]).reshape(len(texts), len(FEATURES))
        return self.curve(self.trees.margins(x))


def _lexicon(terms: list[str]) -> Lexicon:
    stems = tuple((k, frozenset(t[:-1] for t in terms if t[-1] == "*" and len(t) == k + 1)) for k in STEMS)
    return Lexicon(frozenset(t for t in terms if t[-1] != "*"), stems)


def learnt_terms(sample: DataFrame, most: int = LEARNT_TERMS) -> list[Lexicon]:
    """Words and beginnings of words that mark the toxic documents of a sample.

    ``sample`` holds (fold, y, text). Entry k is learnt without fold k, the last one from
    all folds. All are counted in one pass.
    """
    sizes = {(r["fold"], r["y"]): r["n"] for r in sample.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}

    def without(k: int, y: int) -> int:
        return sum(n for (fold, label), n in sizes.items() if fold != k and label == y)

    learnable = [k for k in range(FOLDS + 1) if without(k, 0) and without(k, 1)]
    if not learnable:
        return [Lexicon()] * (FOLDS + 1)
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))
    longer = [F.transform(F.filter("w", lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*"))) for k in STEMS]
    terms = sample.select("fold", "y", found.alias("w")).select(
        "fold", "y", F.explode(F.array_distinct(F.concat("w", *longer))).alias("term")
    )
    counts = [F.count_if((F.col("y") == y) & (F.col("fold") != k)).alias(f"in{y}_{k}") for k in learnable for y in (0, 1)]
    rates = terms.groupBy("term").agg(*counts).where(F.col(f"in1_{learnable[-1]}") >= LEARNT_ROWS)
    each = [
        F.struct(
            F.lit(k).alias("fold"), F.col(f"in1_{k}").alias("rows"),
            (F.col(f"in1_{k}") / without(k, 1)).alias("share"),
            ((F.col(f"in0_{k}") + 0.5) / without(k, 0)).alias("other"),
        )
        for k in learnable
    ]
    ratio = F.col("share") / F.col("other")
    marked = rates.select("term", F.explode(F.array(*each)).alias("r")).select("term", "r.*").where(
        (F.col("rows") >= LEARNT_ROWS) & (F.col("share") >= LEARNT_LEAST) & (ratio >= LEARNT_RATIO)
    )
    strongest = Window.partitionBy("fold").orderBy((F.col("share") * F.log(ratio)).desc(), "term")
    top = marked.withColumn("rank", F.row_number().over(strongest)).where(F.col("rank") <= most).collect()
    return [_lexicon([r["term"] for r in top if r["fold"] == k]) for k in range(FOLDS + 1)]


def _described(texts: pa.Array, folds: pa.Array, lexicons: list[Lexicon]) -> pa.Array:
    described = [describe(t.as_py(), lexicons[k]) for t, k in zip(texts, folds.to_pylist())]
    return pa.StructArray.from_arrays([pa.array(described, pa.list_(pa.float64()))], ["x"])


def train(x: np.ndarray, y: np.ndarray, fold: np.ndarray, weights: np.ndarray, learnt: Lexicon) -> Model:
    """Trees and their calibration, at any number of rows of two classes."""
    # Leaves have a least weight, which a rare class must reach; the curve sees true weights.
    grown = weights.copy()
    for label in (0, 1):
        own = y == label
        grown[own] *= max(1.0, 4 * LEAST_WEIGHT / weights[own].sum())
    whole = boost(x, y, grown)
    margins = whole.margins(x)
    if min((y == 0).sum(), (y == 1).sum()) > 1:
        for k in np.unique(fold):
            margins[fold == k] = boost(x[fold != k], y[fold != k], grown[fold != k]).margins(x[fold == k])
    return Model(learnt, whole, isotonic(margins, y, weights))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    per_class: int = PER_CLASS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> Model:
    """Learn from at most ``per_class`` documents of each class that are not held out."""
    usable = usable_labels(labels, label, id_column)
    zeros, ones = class_counts(usable)
    sample = labelled_sample(docs, usable, per_class, id_column, text_column).persist()
    try:
        # Ordered by a hash, so that the folds are alike. The ids of a sample are bounded.
        dealt = Window.partitionBy("y").orderBy(F.xxhash64("__id"), "__id")
        folds = sample.select("__id", F.pmod(F.row_number().over(dealt) - 1, F.lit(FOLDS)).alias("fold"))
        folded = sample.join(F.broadcast(folds), "__id")
        lexicons = learnt_terms(folded)
        rows = append(folded, lambda texts, fold: _described(texts, fold, lexicons), ["text", "fold"], "x array<double>")
        table = rows.select(F.xxhash64("__id").alias("h"), "__id", "y", "fold", "x").toArrow()
    finally:
        sample.unpersist()
    table = table.sort_by([("h", "ascending"), ("__id", "ascending")])
    y = np.array(table["y"].to_pylist(), np.float64)
    if not len(y) or y.min() == y.max():
        return Model(Lexicon(), None, None, (ones + 1) / (zeros + ones + 2))
    x = np.array(table["x"].to_pylist())
    weights = np.where(y == 1, ones / (y == 1).sum(), zeros / (y == 0).sum())
    return train(x, y, table["fold"].to_numpy(), weights / weights.mean(), lexicons[-1])


def score(docs: DataFrame, model: Model, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on); both are replaced."""

    def scored(texts: pa.Array) -> pa.Array:
        found = model.score(texts.to_pylist())
        return pa.StructArray.from_arrays(
            [pa.array(found), pa.array((found >= threshold).astype(np.int32))], ["score", "predicted"]
        )

    return append(docs, scored, [text_column], "score double, predicted int")


def scored(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    per_class: int = PER_CLASS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Fit on the labels and score every document; adds ``held_out`` as well."""
    model = fit(docs, labels, label, per_class, id_column, text_column)
    return score(docs.withColumn("held_out", held_out(id_column)), model, text_column)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents not predicted to be toxic, with their columns unchanged."""
    model = fit(docs, labels)
    marked = score(docs.select(F.struct("*").alias("__vintry_row"), "text"), model)
    return marked.where("predicted = 0").select("__vintry_row.*")
