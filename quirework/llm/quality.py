"""Quality classifier: regularised quadratic discriminant analysis over transformed text statistics.

Each class has a mean and a covariance of the statistics; the covariance is shrunk towards the
pooled one and then towards its own diagonal's mean. Their Cholesky factors are computed once and
kept in the model, and a text's score is the logistic of the difference of the classes' Gaussian
log densities (half the Mahalanobis distance plus the log determinant) and log priors.

Means and covariances come from sums of products per class, added up from all labelled rows by
Spark; only those sums reach the driver. Null and empty texts have all-zero counts and a score like
any other. Without labelled rows of both classes every score is 0.5. Null labels are not learned;
rows may repeat; ids may be null (such rows are scored but not learned).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PUNCT = re.compile(r"[.,;:?]")
_SYMBOL = re.compile(r"[#*$%&|<>!]")
_UPPER = re.compile(r"[A-ZÀ-Þ]")
_DIGIT = re.compile(r"[0-9]")
WIDTH = 10


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; roots and logarithms bring their distributions closer to normal."""
    text = text or ""
    tokens = text.split()
    n, chars = max(1, len(tokens)), max(1, len(text))
    counts = Counter(tokens)
    lines = [x for x in text.split("\n") if x.strip()]
    same = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
    top = counts.most_common(1)[0][1] if counts else 0
    return [
        np.log1p(len(tokens)),
        np.log(chars / n),
        np.sqrt(len(_SYMBOL.findall(text)) / n),
        np.sqrt(len(_UPPER.findall(text)) / chars),
        np.sqrt(len(_DIGIT.findall(text)) / chars),
        np.sqrt(len(_PUNCT.findall(text)) / n),
        np.sqrt(same / n),
        np.log(len(counts) / np.sqrt(n)) if counts else 0.0,
        np.sqrt(top / n),
        np.sqrt((len(lines) - len(set(lines))) / max(1, len(lines))),
    ]


def statistics_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([statistics(t if isinstance(t, str) else None) for t in s], dtype=object)

    return of(text)


class Model:
    """Two Gaussians, each as mean, inverse Cholesky factor and log determinant."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float = 0.1, ridge: float = 0.01) -> None:
        total = sum(n for n, _, _ in sums.values())
        centred = {c: xx - np.outer(x, x) / n for c, (n, x, xx) in sums.items()}
        pooled = sum(centred.values()) / total
        self.parts = {}
        for c, (n, x, _) in sums.items():
            cov = (1 - pool) * centred[c] / n + pool * pooled
            cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / len(cov), 1e-6) * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.parts[c] = (x / n, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(n / total))

    def density(self, x: np.ndarray, c: int) -> np.ndarray:
        mean, inverse, logdet, prior = self.parts[c]
        z = (x - mean) @ inverse.T
        return prior - 0.5 * (logdet + (z * z).sum(axis=1))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.density(x, 1) - self.density(x, 0), -500, 500)))


def fit(stats: DataFrame, labels: DataFrame, id_col: str) -> Model | None:
    """``stats`` has ``id_col`` and ``x``; ``labels`` has ``id_col`` and ``quality``, all of whose rows are learned."""
    known = stats.join(labels.where("quality in (0, 1)").select(id_col, "quality"), id_col)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for rows in batches:
            for c, part in rows.groupby("quality")["x"]:
                x = np.column_stack([np.ones(len(part)), np.stack(part.to_list())])
                sums[int(c)] = sums.get(int(c), 0) + x.T @ x
        for c, s in sums.items():
            yield pd.DataFrame({"c": c, "at": np.arange(s.size), "v": s.ravel()})

    rows = known.select("quality", "x").mapInPandas(add, "c int, at int, v double").groupBy("c", "at").agg(F.sum("v").alias("v")).collect()
    sums: dict[int, np.ndarray] = {}
    for r in rows:
        sums.setdefault(r["c"], np.zeros((WIDTH + 1) ** 2))[r["at"]] = r["v"]
    if len(sums) < 2:
        return None
    square = {c: s.reshape(WIDTH + 1, WIDTH + 1) for c, s in sums.items()}
    return Model({c: (s[0, 0], s[0, 1:], s[1:, 1:]) for c, s in square.items()})


def score_column(df: DataFrame, model: Model | None, x: Column) -> Column:
    """The probability that a text is good, from its statistics."""
    if model is None:
        return F.lit(0.5)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(shared.value.score(np.stack(s.to_list())) if len(s) else np.zeros(0))

    return of(x)
