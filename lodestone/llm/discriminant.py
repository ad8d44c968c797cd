"""Quality classifier: a regularised quadratic discriminant over transformed statistics of documents.

Every text gives a short vector of statistics (length, length of words, shares of letters, capitals, digits, symbols
and punctuation, of distinct, most frequent, repeated words, word pairs and lines); counts enter as logarithms, shares
as smoothed log odds, so that classes come near normal distributions. Each class has its own mean and covariance. A
covariance is shrunk towards a multiple of the identity, in units of the spread within classes, by the weight that
Ledoit and Wolf derive from the data, and by LEAST at least. A score is the logistic function of the difference of log densities,
which are Mahalanobis distances by the classes' Cholesky factors (inverted once, carried with the model), plus the
log odds of the classes.

Scale: one pass over the texts writes the statistics, a few numbers a document. Means, covariances and shrinkage come
from every labelled document outside the held-out fold, as sums of fixed size that tasks add up before anything is
shuffled; nothing is sampled. The model has 2 * d * d numbers, whatever the input. Scoring reads the statistics alone.

Edge cases: a null or empty text has the statistics of no words and is scored like any other; null labels, labels of
documents that aren't there and documents with a null id teach nothing; repeated label rows count once, a document with
both labels counts as good; every row of a repeated id teaches and is scored; where a class has no document, the score
is the share of good ones among the taught, or 0.5 where there are none; an empty table gives an empty result; ids,
labels, lang and source are never inputs of a score; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bucket_of_id, saved, split_words

FOLDS, HELD_OUT = 3, 1
#: Least weight of the identity in a covariance, for statistics without spread in a class.
LEAST = 0.02
#: Log odds beyond which a score is 0 or 1 to all purposes.
LIMIT = 30.0

_BLANK, _UPPER, _LOWER, _DIGIT, _SYMBOL, _OTHER, _FOREIGN = range(7)


def _classes() -> np.ndarray:
    """The class of every ASCII character, and at place 128 that of all others."""
    kind = np.full(129, _OTHER, np.uint8)
    for k, chars in ((_BLANK, " \t\n\x0b\x0c\r"), (_UPPER, map(chr, range(65, 91))), (_LOWER, map(chr, range(97, 123))), (_DIGIT, "0123456789"), (_SYMBOL, "#*$%&|<>")):
        kind[[ord(c) for c in chars]] = k
    kind[128] = _FOREIGN
    return kind


_KINDS = _classes()
NAMES = ("words", "word_length", "upper", "letters", "digits", "symbols", "punctuation", "distinct", "top_word", "stutter", "pairs", "lines", "line_length", "short_words")


def _odds(part: int, whole: int) -> float:
    return math.log((part + 0.5) / (whole - part + 0.5))


def statistics(text: str) -> list[float]:
    """The values of NAMES for a whole text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.bincount(_KINDS[np.minimum(points, 128)], minlength=7).tolist()
    solid = len(points) - n[_BLANK]
    letters = n[_UPPER] + n[_LOWER] + n[_FOREIGN]
    words = split_words(text)
    count = Counter(words)
    pairs = max(len(words) - 1, 0)
    stutter = sum(a == b for a, b in zip(words, words[1:], strict=False))
    distinct_pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in (x.strip() for x in text.split("\n")) if x]
    return [
        math.log1p(len(words)), math.log((solid + 1) / (len(words) + 1)), _odds(n[_UPPER], n[_UPPER] + n[_LOWER]), _odds(letters, solid), _odds(n[_DIGIT], solid), _odds(n[_SYMBOL], solid), _odds(n[_OTHER], solid),
        _odds(len(count), len(words)), _odds(max(count.values(), default=0), len(words)), _odds(stutter, pairs), _odds(pairs - distinct_pairs, pairs),
        _odds(len(lines) - len(set(lines)), len(lines)), math.log((len(words) + 1) / (len(lines) + 1)), _odds(sum(m for w, m in count.items() if len(w) == 1), len(words)),
    ]


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "x": [statistics(t) for t in pdf["text"]]})


def _matrix(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(NAMES)))


def _add_up(batches: Iterator[pd.DataFrame], centre: dict[int, np.ndarray] | None = None, scale: np.ndarray | float = 1.0) -> Iterator[pd.DataFrame]:
    """Sums of one task by class: number, vectors, products of vectors, fourth powers of lengths; of centred and scaled vectors if a centre is given."""
    total: dict[int, list] = {}
    for pdf in batches:
        x, y = _matrix(pdf["x"]), pdf["good"].to_numpy()
        for k in np.unique(y).tolist():
            part = (x[y == k] - (0 if centre is None else centre[k])) / scale
            own = [len(part), part.sum(0), part.T @ part, ((part**2).sum(1) ** 2).sum()]
            total[k] = [a + b for a, b in zip(total[k], own, strict=True)] if k in total else own
    yield pd.DataFrame([(k, n, s.tolist(), p.ravel().tolist(), float(f)) for k, (n, s, p, f) in total.items()], columns=["good", "n", "s", "p", "f"])


def _sums(labelled: DataFrame, **options) -> dict[int, tuple[int, np.ndarray, np.ndarray, float]]:
    """Those of all tasks: one row a class and task is added up in tasks, one a class and entry comes back."""
    parts = labelled.mapInPandas(partial(_add_up, **options), "good int, n long, s array<double>, p array<double>, f double")
    entries = parts.select("good", F.posexplode(F.concat(F.array(F.col("n").cast("double"), "f"), "s", "p")).alias("at", "v"))
    found: dict[int, np.ndarray] = {}
    d = len(NAMES)
    for r in entries.groupBy("good", "at").agg(F.sum("v").alias("v")).collect():  # 2 * (2 + d + d * d) numbers
        found.setdefault(r["good"], np.zeros(2 + d + d * d))[r["at"]] = r["v"]
    return {k: (int(v[0]), v[2 : 2 + d], v[2 + d :].reshape(d, d), float(v[1])) for k, v in found.items()}


def shrunk(covariance: np.ndarray, n: int, fourth: float) -> np.ndarray:
    """Ledoit and Wolf's estimate: the covariance of n centred vectors, nearer to a multiple of the identity the less it is certain; fourth is their sum of fourth powers of lengths."""
    d = len(covariance)
    mean = np.trace(covariance) / d
    spread = ((covariance - mean * np.eye(d)) ** 2).sum()
    doubt = min(max(fourth / n - (covariance**2).sum(), 0.0) / n, spread)
    weight = max(doubt / spread if spread > 0 else 1.0, LEAST)
    return (1 - weight) * covariance + weight * max(mean, 1e-6) * np.eye(d)


class Discriminant:
    """Two normal densities and the classes' log odds; small and picklable. Without densities, the log odds alone."""

    def __init__(self, odds: float):
        self.odds = odds
        self.parts: list[tuple[np.ndarray, np.ndarray, float]] = []  # centre, inverse of the Cholesky factor, log determinant

    def add(self, centre: np.ndarray, covariance: np.ndarray, scale: np.ndarray) -> None:
        factor = np.linalg.cholesky(covariance)
        self.parts.append((centre, np.linalg.inv(factor) / scale, 2 * float(np.log(np.diag(factor)).sum())))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Of class 1 against class 0, for rows x."""
        if len(self.parts) < 2:
            return np.full(len(x), self.odds)
        bad, good = (((x - centre) @ inverse.T) ** 2 for centre, inverse, _ in self.parts)
        return self.odds + 0.5 * (bad.sum(1) - good.sum(1) + self.parts[0][2] - self.parts[1][2])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -LIMIT, LIMIT)))


def fit(labelled: DataFrame) -> Discriminant:
    """labelled (x, good 0 or 1), every row of which teaches."""
    first = _sums(labelled)
    n = {k: first[k][0] if k in first else 0 for k in (0, 1)}
    if not n[0] or not n[1]:
        return Discriminant(0.0 if n[0] == n[1] else LIMIT if n[1] else -LIMIT)
    centre = {k: first[k][1] / n[k] for k in (0, 1)}
    within = sum(np.diag(first[k][2]) - n[k] * centre[k] ** 2 for k in (0, 1)) / (n[0] + n[1])
    scale = np.sqrt(np.maximum(within, 1e-6))
    # Centred anew: differences of large sums would lose digits.
    second = _sums(labelled, centre=centre, scale=scale)
    model = Discriminant(math.log(n[1] / n[0]))
    for k in (0, 1):
        model.add(centre[k], shrunk(second[k][2] / n[k], n[k], second[k][3]), scale)
    return model


def _score(batches: Iterator[pd.DataFrame], model: Discriminant) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": model.scores(_matrix(pdf["x"]))})


def classified(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. labels has the id under the same name."""
    # An id travels as text: pandas would make a column of integers with nulls one of floats.
    own = docs.select(F.col(f"`{doc_id}`").cast("long").cast("string").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    measured = saved(own.mapInPandas(_measure, "doc_id string, x array<double>").withColumn("doc_id", F.col("doc_id").cast("long")), "statistics")
    known = labels.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), (F.col(f"`{label}`") > 0).cast("int").alias("good"))
    known = known.filter((bucket_of_id(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("doc_id").isNotNull() & F.col("good").isNotNull()).groupBy("doc_id").agg(F.max("good").alias("good"))
    model = fit(saved(measured.join(known, "doc_id").select("x", "good"), "labelled"))
    scored = measured.select(F.col("doc_id").cast("string").alias("doc_id"), "x").mapInPandas(partial(_score, model=model), "doc_id string, score double")
    ids = F.col("doc_id").cast("long")
    return scored.select(ids.alias("doc_id"), (bucket_of_id(ids, FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
