"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased and whatever is not a letter counts as a space. The 1-, 2- and 3-grams of
those symbols are hashed to ``2**bits`` buckets each; a bucket's log probability per language, with
additive smoothing, makes a matrix that is broadcast (languages x 3 x ``2**bits`` floats). A batch
of texts is scored at once: its n-grams are rows of that matrix, gathered and summed by text.

Null texts and texts without a letter are ``und`` with score 0, and so is every text if nothing
was learned. Null languages are not learned. Texts are scored whole, a slice at a time.
Equal scores go to the first language by code point. Rows may repeat; ids may be null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, first_hashes, fresh

ORDERS = (1, 2, 3)
_SLICE = 1 << 18


@cache
def _fold() -> np.ndarray:
    """The symbol of each code point: its lower case's code point if it is a letter, else 32."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            table[c] = ord(s.lower()[0])
    return table


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of ``texts`` one after another, a space at either end of each and runs of spaces as one, and whose text each is."""
    length = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    s = _fold()[np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), length)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 32) | (s[:-1] != 32) | (owner[1:] != owner[:-1])
    return s[keep], owner[keep]


def buckets(s: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The hash bucket of each n-gram of ``s``."""
    n = len(s) - order + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    h = np.full(n, order, np.uint32)
    for k in range(order):
        h = (h ^ s[k : k + n]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h & np.uint32((1 << bits) - 1)


def grams(s: np.ndarray, owner: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each order, the n-grams' buckets and whose they are; none spans two texts."""
    for i, order in enumerate(ORDERS):
        b = buckets(s, order, bits)
        own = owner[: len(b)]
        inside = own == owner[order - 1 :]
        yield i, b[inside], own[inside]


def batches_of(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``_SLICE`` symbols, and where each begins; a longer text is alone."""
    lo = size = 0
    for hi, t in enumerate(texts):
        if hi > lo and size + len(t) > _SLICE:
            yield lo, texts[lo:hi]
            lo, size = hi, 0
        size += len(t)
    if lo < len(texts):
        yield lo, texts[lo:]


class Model:
    """Log probabilities of each bucket in each language, and how usual texts are in theirs.

    ``usual`` has, of each language, the mean and spread of the learned texts' log probability per symbol.
    """

    def __init__(self, table: dict[str, np.ndarray], documents: dict[str, int], bits: int, alpha: float = 0.5) -> None:
        self.bits, self.langs = bits, sorted(table)
        self.prior = np.log(np.array([documents[x] for x in self.langs], float) / max(1, sum(documents.values())))
        self.log_prob = [np.log(p / p.sum(axis=0)).astype(np.float32) for i in range(len(ORDERS)) if self.langs for p in [np.column_stack([table[x][i] for x in self.langs]) + alpha]]
        self.usual: dict[str, tuple[float, float]] = {}

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A batch's log probabilities, a row a text and a column a language, and how many symbols but spaces each text has.

        The batch is one sparse matrix of n-grams by text; its product with the broadcast matrix is taken a run of n-grams at a time.
        """
        total = np.zeros((len(texts), len(self.langs)))
        letters = np.zeros(len(texts), np.int64)
        for lo, part in batches_of(texts):
            s, owner = symbols(part)
            letters[lo : lo + len(part)] = np.bincount(owner[s != 32], minlength=len(part))
            for i, bucket, owner in grams(s, owner, self.bits):
                for at in range(0, len(bucket), _SLICE):
                    b, own = bucket[at : at + _SLICE], owner[at : at + _SLICE]
                    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    total[lo + own[first]] += np.add.reduceat(self.log_prob[i][b], first, axis=0, dtype=np.float64)
        return total, letters

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of each text the language, its probability, and how many spreads its log probability per symbol lies below the usual."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        total, letters = self.sums([t or "" for t in texts])
        full = total + self.prior
        best = full.argmax(axis=1)
        score = np.where(letters > 0, 1 / np.exp(full - full.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
        langs = [self.langs[b] if n else "und" for b, n in zip(best, letters, strict=True)]
        mean, spread = (np.array([self.usual.get(x, (0.0, np.inf))[k] for x in self.langs]) for k in (0, 1))
        below = (mean[best] - total[np.arange(len(texts)), best] / np.maximum(letters, 1)) / spread[best]
        return langs, score, np.where(letters > 0, below, 0.0)


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = 2_000, bits: int = 14, langs: int = 1_000) -> Model:
    """Counts of the n-grams of at most ``most`` texts of each language, whole: those whose hash comes first.

    The matrix has ``3 * 2**bits`` floats a language; more than ``langs`` languages raise an error, as it would
    outgrow the driver and the broadcast.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    documents = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(langs + 1).collect()}
    if len(documents) > langs:
        raise ValueError(f"over {langs} languages; name more with langs= where the driver has the memory")
    if not documents:
        return Model({}, {}, bits)
    last = F.create_map(*[F.lit(x) for lang, n in documents.items() for x in (lang, first_hashes(min(1, most / n)))])
    # a text that many rows repeat is drawn once or not at all
    drawn = known.where(F.xxhash64(F.lit(4), "text") <= F.element_at(last, F.col("lang"))).dropDuplicates(["lang", "text"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        for rows in batches:
            for lang, texts in rows.groupby("lang")["text"]:
                total = seen.setdefault(lang, np.zeros((len(ORDERS), 1 << bits), np.int64))
                for _, part in batches_of(texts.tolist()):
                    for i, bucket, _ in grams(*symbols(part), bits):
                        total[i] += np.bincount(bucket, minlength=1 << bits)
        for lang, total in seen.items():
            flat = total.ravel()
            at = np.flatnonzero(flat)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": flat[at]})

    table = {lang: np.zeros((len(ORDERS), 1 << bits), np.int64) for lang in documents}
    for r in drawn.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas().itertuples():
        table[r.lang].flat[r.bucket] = r.n
    return Model(table, documents, bits)


def usual(docs: DataFrame, model: Model, lang_col: str = "lang", text_col: str = "text", letters: int = 20) -> Model:
    """``model`` with the mean and spread of its languages, over all texts of at least ``letters`` letters that are said and predicted to be in them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = rows["text"].tolist()
            total, n = shared.value.sums(texts)
            if not len(texts):
                continue
            best = (total + shared.value.prior).argmax(axis=1)
            per = total[np.arange(len(texts)), best] / np.maximum(n, 1)
            found = pd.DataFrame({"lang": [shared.value.langs[b] for b in best], "per": per, "square": per * per, "n": 1})
            yield found[(found["lang"] == rows["lang"].to_numpy()) & (n >= letters)].groupby("lang", as_index=False).sum()

    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    if model.langs:
        bound_batches(docs.sparkSession)
        sums = known.mapInPandas(of, "lang string, per double, square double, n long").groupBy("lang").agg(F.sum("per"), F.sum("square"), F.sum("n")).collect()
        model.usual = {lang: (per / n, max(square / n - (per / n) ** 2, 1e-4) ** 0.5) for lang, per, square, n in sums}
    return model


def predict_column(docs: DataFrame, model: Model, text: Column) -> Column:
    """A struct ``lang_pred``, ``score``, ``below`` for each text."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, below double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            lang, score, below = shared.value.scores([t if isinstance(t, str) else None for t in s])
            yield pd.DataFrame({"lang_pred": lang, "score": score, "below": below})

    return of(text)


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: float = 0.5, spreads: float = 10.0) -> DataFrame:
    """``docs`` without texts of no known language, its columns as they are.

    Those are ``und``, score under ``least``, or have a log probability per symbol ``spreads`` or more below
    what is usual in the language they are most like; naive Bayes alone is sure of one whatever the text.
    """
    model = usual(docs, fit(docs, lang_col, text_col), lang_col, text_col)
    said = fresh(docs.columns, "_said")
    seen = docs.withColumn(said, predict_column(docs, model, F.col(text_col)))
    return seen.where((F.col(f"{said}.lang_pred") != "und") & (F.col(f"{said}.score") >= least) & (F.col(f"{said}.below") < spreads)).drop(said)
