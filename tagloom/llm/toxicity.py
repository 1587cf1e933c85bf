"""Toxicity: cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import least_hashes, settle, text_batches

SAMPLE = 4000  # labelled documents of each class at most: the bound of what is fitted on
GRADES = 3
MIN_DOCS = 5
NOISE = 4.0
PENALTY = 1.0
THRESHOLD = 0.5
CACHE = 200_000  # words that a worker remembers, none longer than ``LONG`` characters
LONG = 64
PREFIXES = (4, 5, 6, 7)
LEVELS = (1, 2, 4)  # occurrences at which a beginning counts anew
SEED = 4
PIECE = 1 << 17  # characters whose words are at hand at once
_word = re.compile(r"\w+")
_gap = re.compile(r"\s")


def word_bases(word: str) -> tuple[str, ...]:
    """A word itself, and what it begins with: words with the same stem and other endings share these."""
    return (word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n))


def text_features(words: Counter) -> set[str]:
    """Features of a text: its words, and their beginnings at each level of occurrences that they reach."""
    totals: Counter = Counter()
    for word, n in words.items():
        for base in word_bases(word):
            totals[base] += n
    return {f for base, n in totals.items() for f in _reached(base, n)}


def _reached(base: str, n: int) -> list[str]:
    return [f"{base}{level}" for level in LEVELS if n >= level] if base.endswith("*") else [base]


def text_words(text: str | None) -> Counter:
    """Occurrences of a text's words, counted piece by piece; pieces end at white space, where words and lower case do."""
    words: Counter = Counter()
    at, size = 0, len(text or "")
    while at < size:
        gap = _gap.search(text, at + PIECE)
        end = gap.start() if gap else size
        words.update(_word.findall(text[at:end].lower()))
        at = end
    return words


@dataclass
class Model:
    """P(grade <= k) = s(cut[k] - w.x), one weight vector for all cuts; x marks the features that a text has."""

    weights: dict[str, float]
    cuts: np.ndarray

    def __post_init__(self):
        self.known: dict[str, tuple[str, ...]] = {}
        self.bases = {f[: f.index("*") + 1] if "*" in f else f for f in self.weights}

    def __getstate__(self):
        return self.weights, self.cuts

    def __setstate__(self, state):
        self.weights, self.cuts = state
        self.__post_init__()

    def score(self, text: str | None) -> float:
        """w.x over the whole text."""
        totals: dict[str, int] = {}
        known, bases = self.known, self.bases
        for word, n in text_words(text).items():
            own = known.get(word)
            if own is None:
                if len(known) >= CACHE:
                    known.clear()
                own = tuple(f for f in word_bases(word) if f in bases)
                if len(word) <= LONG:
                    known[word] = own
            for base in own:
                totals[base] = totals.get(base, 0) + n
        return sum(self.weights.get(f, 0.0) for base in sorted(totals) for f in _reached(base, totals[base]))

    def grades(self, scores: np.ndarray) -> np.ndarray:
        """Probabilities of the grades, a row for each score."""
        below = _logistic(self.cuts[None, :] - scores[:, None])
        edges = np.hstack([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))])
        return np.diff(edges, axis=1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def is_marker(feature: str, other: int, toxic: int, n_other: int, n_toxic: int) -> bool:
    """Words at least 20 times as common among toxic as among other documents of the sample."""
    return "*" not in feature and toxic / n_toxic >= 20 * (other + 0.5) / n_other


def severity_grades(markers: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades of labelled texts: 0 where not toxic; toxic ones 1, or 2 if they have more markers than the median has.

    Labels only say toxic or not. The two grades of toxic texts are derived, from words that the same sample marks: grade 2
    says that a text has more of what tells toxic texts than most toxic texts have, not that somebody called it worse.
    """
    grades = toxic.astype(np.int64)
    if toxic.any():
        grades[toxic & (markers > np.median(markers[toxic]))] = 2
    return grades


def fit(texts: list[str | None], toxic: np.ndarray) -> Model:
    """A model fitted on texts at hand; ``fit_on`` does the same for tables."""
    features = [text_features(text_words(t)) for t in texts]
    counts: dict[str, list[int]] = {}
    for fs, t in zip(features, toxic.tolist()):
        for f in fs:
            counts.setdefault(f, [0, 0])[t] += 1
    n = [int((~toxic).sum()), int(toxic.sum())]
    if not all(n):
        return _nothing()
    share = n[1] / sum(n)
    apart = {f: (c[1] - sum(c) * share) / np.sqrt(sum(c) * share * (1 - share)) for f, c in counts.items() if sum(c) >= MIN_DOCS}
    chosen = sorted((f for f, z in apart.items() if z >= NOISE), key=lambda f: (-apart[f], f))
    column = {f: k for k, f in enumerate(chosen)}
    marks = {f for f in chosen if is_marker(f, *counts[f], *n)}
    return solve(chosen, [sorted(column[f] for f in fs if f in column) for fs in features], np.array([len(fs & marks) for fs in features]), toxic)


def _nothing() -> Model:
    """Without both classes, or features that part them, there is nothing to learn: no weights, and nothing is toxic."""
    return Model({}, np.arange(GRADES - 1) + 8.0)


def solve(chosen: list[str], rows: list[list[int]], markers: np.ndarray, toxic: np.ndarray, rounds: int = 1500) -> Model:
    """Accelerated proximal gradient steps on the cumulative-link likelihood, both classes weighing alike.

    ``rows`` lists the places in ``chosen`` of each document's features. Weights are never negative: features add to a
    severity, and a text without any is what the cuts say. An L1 penalty in proportion to a feature's own noise keeps what
    a few documents share by chance without weight.
    """
    y = severity_grades(markers, toxic)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.array([c for r in rows for c in r], np.int64)
    if not len(cols):
        return _nothing()
    n, k = len(rows), len(chosen)
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    spread = float((weight**2).mean())
    noise = 0.5 * np.sqrt(np.bincount(cols, minlength=k) * spread)  # of a feature's slope, were it to mean nothing
    penalty = PENALTY * noise

    def product(w: np.ndarray) -> np.ndarray:
        return np.bincount(at, w[cols], minlength=n)

    v, size = np.ones(k), 1.0
    for _ in range(30):  # the largest curvature, by powers
        v = np.bincount(cols, (weight * product(v))[at], minlength=k)
        size = float(np.sqrt(v @ v)) or 1.0
        v /= size
    step = 1.0 / (0.5 * (size + 2.0))  # weights and cuts move together
    balanced = np.bincount(y, weight, minlength=GRADES)
    cuts = np.array([np.log(c / (1 - c)) for c in np.clip(np.cumsum(balanced)[:-1], 0.02, 0.98)])
    cuts[1] = max(cuts[1], cuts[0] + 0.5)
    w = u = np.zeros(k)
    t, i = 1.0, np.arange(n)
    for _ in range(rounds):
        s = product(u)
        below = np.hstack([np.zeros((n, 1)), _logistic(cuts[None, :] - s[:, None]), np.ones((n, 1))])
        slope = below * (1 - below)
        p = np.maximum(below[i, y + 1] - below[i, y], 1e-9)
        upper, lower = weight * slope[i, y + 1] / p, weight * slope[i, y] / p
        g = np.bincount(cols, (upper - lower)[at], minlength=k)
        moved = u - step * g
        after = np.maximum(moved - step * penalty, 0)
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, u, t = after, after + (t - 1) / t_after * (after - w), t_after
        g_cut = np.array([lower[y == c + 1].sum() - upper[y == c].sum() for c in range(GRADES - 1)])
        cuts = cuts - step * g_cut
        cuts[1] = max(cuts[1], cuts[0] + 0.1)
    return Model({f: float(w[c]) for c, f in enumerate(chosen) if w[c]}, cuts) if w.any() else _nothing()


def labelled_sample(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic", size: int = SAMPLE) -> DataFrame:
    """``doc, text, y`` of at most ``size`` documents of each class, those with the least hashes of their identifier.

    Identifiers are chosen first; the texts come through a broadcast of these, bounded by ``2 * size`` rows. Labels that
    are null or neither 0 nor 1 are left out, as are labels whose document isn't there. Of several rows with an identifier
    one stands for all: the highest label, the least text.
    """
    rows = labels.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{label}`").cast("int").alias("y")).where("y in (0, 1) and doc is not null")
    rows = settle(rows.groupBy("doc").agg(F.max("y").alias("y")))
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [least_hashes(rows.where(F.col("y") == y), ["doc"], size, SEED, n.get(y, 0)) for y in (0, 1)]
    texts = docs.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    found = texts.join(F.broadcast(parts[0].unionByName(parts[1])), "doc")
    return settle(found.groupBy("doc").agg(F.min("text").alias("text"), F.max("y").alias("y")))


def fit_on(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, **names: str) -> Model:
    """A model fitted on a bounded sample of ``labels``.

    Features are counted on the executors. The driver gets those that are more common in toxic documents by ``NOISE``
    standard deviations or more, all of them (each is in five documents of the bounded sample or more), and for each
    document of the sample which of them it has.
    """
    text_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, size=size, **names)
    found = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = [found.get(0, 0), found.get(1, 0)]
    if not all(n):
        return _nothing()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for y, text in zip(b.column("y").to_pylist(), b.column("text")):
                own = pa.array(sorted(text_features(text_words(text.as_py() if text.is_valid else None))), pa.string())
                yield pa.RecordBatch.from_arrays([own, pa.array(np.full(len(own), y, np.int32))], ["feature", "y"])

    share = n[1] / sum(n)
    counts = sample.mapInArrow(features, "feature string, y int").groupBy("feature").agg(F.count("*").alias("n"), F.sum("y").cast("bigint").alias("n1"))
    apart = (F.col("n1") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    counts = counts.where(F.col("n") >= MIN_DOCS).withColumn("z", apart).where(F.col("z") >= NOISE)
    top = sorted(counts.collect(), key=lambda r: (-r["z"], r["feature"]))
    column = {r["feature"]: k for k, r in enumerate(top)}
    marks = {r["feature"] for r in top if is_marker(r["feature"], r["n"] - r["n1"], r["n1"], *n)}

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            has = [text_features(text_words(t.as_py() if t.is_valid else None)) for t in b.column("text")]
            cols = [sorted(column[f] for f in fs if f in column) for fs in has]
            yield pa.RecordBatch.from_arrays([b.column("doc").cast(pa.string()), b.column("y"), pa.array(cols, pa.list_(pa.int32())), pa.array([len(fs & marks) for fs in has], pa.int32())], ["doc", "y", "cols", "markers"])

    rows = sample.mapInArrow(reduce, "doc string, y int, cols array<int>, markers int").collect()
    rows.sort(key=lambda r: (r["doc"], r["cols"]))  # the order in which rows arrive decides nothing
    return solve([r["feature"] for r in top], [r["cols"] for r in rows], np.array([r["markers"] for r in rows]), np.array([bool(r["y"]) for r in rows], bool))


def score_documents(df: DataFrame, model: Model, doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc, severity, grade, p_toxic, toxic``: expected grade, likeliest grade, P(grade > 0) and whether it is over
    ``threshold``, from each whole text.

    Null and empty texts have no features: they are scored by the cuts alone. Repeated rows are rows.
    """
    text_batches(df.sparkSession)
    slim = df.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    kind = slim.schema["doc"].dataType.simpleString()
    names = ["doc", "severity", "grade", "p_toxic", "toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _probabilities(model, b.column("text"))
            made = [pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(1).astype(np.int32)), pa.array(1 - p[:, 0]), pa.array(1 - p[:, 0] > threshold)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), *made], names)

    return slim.mapInArrow(run, f"doc {kind}, severity double, grade int, p_toxic double, toxic boolean").withColumnRenamed("doc", doc)


def drop_toxic(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, all columns, that are not over ``threshold``."""
    text_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(1 - _probabilities(model, b.column(at))[:, 0] <= threshold))

    return df.mapInArrow(run, df.schema)


def _probabilities(model: Model, texts: pa.Array) -> np.ndarray:
    scores = np.array([model.score(x.as_py() if x.is_valid else None) for x in texts], np.float64)
    return model.grades(scores)
