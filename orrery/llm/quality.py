"""Document quality by a regularised quadratic discriminant.

Each class has the mean and a shrinkage covariance of transformed document statistics: the sample covariance
is mixed with its own diagonal and with the pooled variances. A document's score is the logistic of the
difference of the two Gaussian log densities (Mahalanobis distances by the cached Cholesky factors) plus the
log ratio of the priors. The class moments are sums over all labelled rows, so nothing is sampled.

The shrinkage and the least variance are those of ``GRID`` with the least cross-validated log loss over the rows that may be
learnt from; rows are dealt to ``FOLDS`` by a hash of their statistics, so copies are never on both sides. The moments of a fold's
complement are the total less the fold's, so all folds take one aggregation, and all losses another one.

Defined results. A null text counts as empty; empty texts have all-zero statistics and a score like any
other. Null labels and labels of unknown documents are passed over; a document with several labels counts
once for each. With no labelled row of one class the score is the other class's (1.0 or 0.0), and 0.5
without any. Repeated rows are scored alike. Neither ids nor further columns enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ._common import fresh, mapped, ship, stored, table

STATISTICS = ("log_bytes", "upper", "symbols", "bangs", "pipes", "digits", "distinct_words", "repeats", "word_bytes", "blanks", "lines")
#: Share of the target in the shrunk covariance, and the least variance of a statistic: where nothing can be cross-validated.
SHRINKAGE, FLOOR = 0.3, 1e-3
#: What is tried for them.
GRID = tuple((s, f) for f in (1e-2, 1e-3, 1e-4) for s in (0.8, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02))
FOLDS = 5
#: Added to the denominators of shares of characters and of words, so that a few odd ones weigh little in a short text. Of 1, 10, 40 and
#: 150, and 1, 10 and 40, these had the least cross-validated log loss on the rows of one table that may be learnt from.
PRIOR_CHARS, PRIOR_WORDS = 40, 10
#: What a symbol is, beside the marks that have a statistic of their own.
SYMBOLS = b"#$%&*+/<=>@\\^_`{}~"

_UPPER, _LOWER, _DIGIT, _SYMBOL = (np.zeros(256, dtype=bool) for _ in range(4))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_SYMBOL[list(SYMBOLS)] = True


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of one whole text: square roots of shares, logarithms of lengths."""
    if not text:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = len(text)
    words = text.split()
    w = len(words) or 1
    upper, lower = int(counts[_UPPER].sum()), int(counts[_LOWER].sum())
    share = lambda k, of, prior=PRIOR_CHARS: (k / (of + prior)) ** 0.5
    return [
        float(np.log1p(n)),
        share(upper, upper + lower),
        share(int(counts[_SYMBOL].sum()), n),
        share(int(counts[33]), n),
        share(int(counts[124]), n),
        share(int(counts[_DIGIT].sum()), n),
        # distinct words fall with length by Heaps' law; the logarithms' ratio hardly does
        float(np.log1p(len(set(words))) / np.log1p(w)),
        share(sum(map(eq, words, words[1:])), w, PRIOR_WORDS),
        float(np.log1p((n - int(counts[32])) / w)),
        share(int(counts[32]), n),
        share(int(counts[10]), n),
    ]


def add_statistics(df: DataFrame, text_col: str, name: str = "stats") -> DataFrame:
    """``df`` with ``name``, an array of doubles in the order of ``STATISTICS``."""
    (data,) = fresh(df, "text_bytes")
    columns, at = df.columns, len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = pa.array([statistics(x.as_py() or b"") for x in batch.column(at)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(at)), stats], [*columns, name])

    schema = StructType([*df.schema.fields, StructField(name, ArrayType(DoubleType()))])
    return mapped(df.withColumn(data, F.col(f"`{text_col}`").cast("binary")), run, schema)


@dataclass(frozen=True)
class Discriminant:
    """Means and inverse Cholesky factors of the classes 0 and 1, and the constant of the log-density difference."""

    means: tuple[np.ndarray, np.ndarray] | None
    roots: tuple[np.ndarray, np.ndarray] | None
    constant: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.constant)
        distances = [(((x - m) @ r.T) ** 2).sum(axis=1) for m, r in zip(self.means, self.roots, strict=True)]
        return 1.0 / (1.0 + np.exp(-np.clip(self.constant + 0.5 * (distances[0] - distances[1]), -500, 500)))


@dataclass(frozen=True)
class Moments:
    """Number, sums and sums of products of a class's rows."""

    n: int
    first: np.ndarray
    second: np.ndarray

    def less(self, other: Moments | None) -> Moments:
        return self if other is None else Moments(self.n - other.n, self.first - other.first, self.second - other.second)


def moments(labelled: DataFrame, by: list[str]) -> dict[tuple, Moments]:
    """The moments of each group of rows with ``stats``: one aggregation with map-side combine."""
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    at = lambda i: F.col("stats")[i]
    sums = [F.sum(at(i)).alias(f"s{i}") for i in range(d)] + [F.sum(at(i) * at(j)).alias(f"p{i}_{j}") for i, j in pairs]
    out = {}
    for r in labelled.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        second = np.zeros((d, d))
        for i, j in pairs:
            second[i, j] = second[j, i] = r[f"p{i}_{j}"]
        out[tuple(r[c] for c in by)] = Moments(r["n"], np.array([r[f"s{i}"] for i in range(d)]), second)
    return out


def discriminant(classes: tuple[Moments, Moments], shrinkage: float, floor: float) -> Discriminant:
    n = [m.n for m in classes]
    means = [m.first / m.n for m in classes]
    covariances = [m.second / m.n - np.outer(mean, mean) for m, mean in zip(classes, means, strict=True)]
    pooled = sum(k * np.diag(c) for k, c in zip(n, covariances, strict=True)) / sum(n)
    roots, logs = [], []
    for c in covariances:
        shrunk = (1 - shrinkage) * c + shrinkage * np.diag(0.5 * np.diag(c) + 0.5 * pooled) + floor * np.eye(len(c))
        factor = np.linalg.cholesky(shrunk)
        roots.append(np.linalg.inv(factor))
        logs.append(2 * float(np.log(np.diag(factor)).sum()))
    return Discriminant((means[0], means[1]), (roots[0], roots[1]), 0.5 * (logs[0] - logs[1]) + float(np.log(n[1] / n[0])))


def fit(labelled: DataFrame, label: str = "label", shrinkage: float | None = None, floor: float | None = None) -> Discriminant:
    """From rows of ``stats`` and a 0/1 label."""
    found = moments(labelled.filter(F.col(label).isin(0, 1)), [label])
    if len(found) < 2:
        return Discriminant(None, None, float(next(iter(found), (0.5,))[0]))
    return discriminant((found[(0,)], found[(1,)]), SHRINKAGE if shrinkage is None else shrinkage, FLOOR if floor is None else floor)


def cross_validated(labelled: DataFrame) -> Discriminant:
    """The model with the constants of ``GRID`` of least log loss on rows it was not fitted to; of equal losses the first."""
    folded = labelled.filter(F.col("label").isin(0, 1)).withColumn("fold", F.pmod(F.xxhash64("stats"), F.lit(FOLDS)).cast("int"))
    parts = moments(folded, ["label", "fold"])
    whole = {}
    for (label, _), m in sorted(parts.items()):
        whole[label] = m if label not in whole else Moments(whole[label].n + m.n, whole[label].first + m.first, whole[label].second + m.second)
    if len(whole) < 2:
        return Discriminant(None, None, float(next(iter(whole), 0.5)))
    training = [tuple(whole[c].less(parts.get((c, k))) for c in (0, 1)) for k in range(FOLDS)]
    if min(m.n for pair in training for m in pair) < 2:
        return discriminant((whole[0], whole[1]), SHRINKAGE, FLOOR)
    models = [[discriminant(pair, *constants) for constants in GRID] for pair in training]

    @pandas_udf("array<double>")
    def losses(stats: pd.Series, label: pd.Series, fold: pd.Series) -> pd.Series:
        out = np.zeros((len(stats), len(GRID)))
        if len(stats):
            x, y = np.stack(stats.to_numpy()), label.to_numpy()
            for k in np.unique(fold):
                rows = (fold == k).to_numpy()
                for g, model in enumerate(models[k]):
                    p = np.clip(model.scores(x[rows]), 1e-9, 1 - 1e-9)
                    out[rows, g] = -np.log(np.where(y[rows] == 1, p, 1 - p))
        return pd.Series(list(out))

    found = folded.select(losses("stats", "label", "fold").alias("loss")).agg(*(F.sum(F.col("loss")[g]).alias(f"g{g}") for g in range(len(GRID)))).first()
    best = min(range(len(GRID)), key=lambda g: (round(found[g], 6), g))
    return discriminant((whole[0], whole[1]), *GRID[best])


def score(df: DataFrame, model: Discriminant, stats_col: str = "stats") -> Column:
    """The score of each row's statistics."""
    ship(df.sparkSession)

    @pandas_udf("double")
    def scored(stats: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(stats.to_numpy())) if len(stats) else np.zeros(0))

    return scored(F.col(stats_col))


def held_out(id_col: str) -> Column:
    """One row in five by the CRC-32 of its id: never learnt from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def learnt(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> Discriminant:
    """The model from the labels of rows that are not held out; ``stats`` has ``id`` and ``stats``."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter(F.col("label").isNotNull() & ~held_out("id"))
    return cross_validated(stored(stats.join(known, "id").select("stats", "label"), "labelled"))


def accepted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more; texts are read once, stored with their statistics, and never shuffled."""
    (stats,) = fresh(docs, "stats")
    rows = stored(add_statistics(docs, text_col, stats), "quality-stats")
    model = learnt(rows.select(F.col(f"`{id_col}`").alias("id"), F.col(stats).alias("stats")), labels, id_col, label_col)
    return rows.filter(score(rows, model, stats) >= threshold).drop(stats)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """Per document: the id, ``held_out``, ``stats``, ``score`` and ``predicted``.

    The statistics are computed once and stored in the shared folder, then joined with the labels as slim rows.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    stats = stored(add_statistics(slim, "text").drop("text"), "quality-stats")
    model = learnt(stats, labels, id_col, label_col)
    scored = stats.withColumn("score", score(stats, model))
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "stats", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document."""
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")
