"""Toxicity: a support vector machine over the subsequence string kernel, with Nyström landmarks.

A sentence is scored by its most telling unit: a word without its outer punctuation, a run of
letters written apart (``i d i o t``), or a stretch of a long word; marks stand where a word begins and
ends, so that words of one or two letters can be told as well. The kernel counts the
subsequences of three symbols that two units share, each weighted by ``decay`` to the power of the
stretch it covers, so that gaps and inserted characters lower the similarity a little rather than
break it. Nyström features are a unit's normalised kernel values with the landmarks, times the
inverse root of the landmarks' own kernel matrix; a linear SVM is trained on them. As the SVM is linear in
sums over subsequences, its landmarks fold into one weight for each triple of symbols. So every unit of a
text is scored, exactly and at a cost that does not depend on how many landmarks there are.

Sentences inherit their document's label. In toxic documents only one sentence may be to blame,
so training alternates: units of toxic documents count as toxic while they score so and occur there
more than elsewhere, against all other units of the clean documents' sentences (multiple-instance
SVM). A unit counts once for each pair of neighbours that it has, whatever documents repeat them, so copies
of a document add nothing. The toxic landmarks are all pieces of units that are told from clean ones by more
than chance among as many pieces, save pieces much like one before, and, where insults are too many to be
told one by one, units that only toxic contexts have and chance hardly gives (``rare``); the clean landmarks are as many clean
units, those most like insults. A logistic curve turns the highest score in a document into a probability.

Whole texts are read. Null and empty texts have no units and score at the floor, below which no unit
counts. Without labels of both classes, or any telling unit, every score is 0. Rows may repeat; ids may be null.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, first_hashes

_APART = re.compile(r"(?<!\S)\S(?:\s{1,2}\S){2,}(?!\S)")
_LONG, _HALF = 24, 12
_STRETCH, _STEP = 12, 3
_CACHED = 300_000
_OUTER = ".,;:!?\"'()[]{}<>|*#$%&-_+=/\\~`^…–—“”‘’«»¡¿"
#: Symbols that stand for letters inside words; fixed values.
_STANDS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_BEGIN, _END = "^", "$"
_CELLS = 1 << 22


def windows(unit: str) -> list[str]:
    """The unit between its marks, with stand-ins read as letters and inner punctuation left out; of long ones also stretches."""
    if not unit.isalpha():
        unit = "".join(filter(str.isalnum, unit.translate(_STANDS)))
    n = len(unit)
    if n <= _STRETCH:
        return [_BEGIN + unit + _END] if n else []
    unit = _BEGIN + unit + _END
    found = [unit] if n <= _LONG else [unit[i : i + _LONG] for i in range(0, n - _HALF, _HALF)]
    return found + [unit[i : i + _STRETCH] for i in [*range(0, n + 2 - _STRETCH, _STEP), n + 2 - _STRETCH]]


def tokens(text: str | None) -> set[str]:
    """The distinct units of a text: lower-cased tokens without outer punctuation, and letters written apart joined."""
    text = (text or "").lower()
    found = {t.strip(_OUTER) for t in set(text.split())}
    if apart := _APART.findall(text):
        found.update("".join(x.split()) for x in apart)
    return found


def contexts(text: str | None) -> Iterator[tuple[str, int]]:
    """Each unit of a text with a hash of itself and the tokens beside it; letters written apart are joined first."""
    found = _APART.sub(lambda m: "".join(m[0].split()), (text or "").lower()).split()
    for a, b, c in zip(["", *found], found, [*found[1:], ""], strict=False):
        yield b.strip(_OUTER), hash((a, b, c))


def codes(units: list[str], width: int) -> np.ndarray:
    """Units as rows of code points, 0 after the end."""
    return np.frombuffer("".join(u[:width].ljust(width, "\0") for u in units).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(units), width).astype(np.int32)


def own_kernel(s: np.ndarray, decay: float) -> np.ndarray:
    """Each row's kernel with itself, by dynamic programming over prefixes."""
    return np.concatenate([_diagonal(s[i : i + 4096], decay) for i in range(0, len(s), 4096)]) if len(s) else np.zeros(0, np.float32)


def _diagonal(s: np.ndarray, decay: float, p: int = 3) -> np.ndarray:
    n, width, sq = len(s), s.shape[1], np.float32(decay * decay)
    before = [np.ones((n, width + 1), np.float32)] + [np.zeros((n, width + 1), np.float32) for _ in range(p - 1)]
    total = np.zeros(n, np.float32)
    for i in range(width):
        match = ((s[:, i, None] == s) & (s > 0)) * sq
        total += (match * before[p - 1][:, :-1]).sum(axis=1)
        now = [before[0]]
        for q in range(1, p):
            step, run = np.zeros_like(before[q]), np.zeros(n, np.float32)
            for j in range(width):
                run = run * np.float32(decay) + match[:, j] * before[q - 1][:, j]
                step[:, j + 1] = run
            now.append(before[q] * np.float32(decay) + step)
        before = now
    return total


@cache
def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of every three of ``n`` symbols, in order."""
    i, j, k = np.meshgrid(*[np.arange(n)] * 3, indexing="ij")
    rising = (i < j) & (j < k)
    return i[rising], j[rising], k[rising]


class Triples:
    """Sums over the subsequences of three symbols that units share with fixed strings.

    ``alphabet`` are the fixed strings' symbols; a weight table has a row for each triple of them.
    """

    def __init__(self, strings: Iterable[str], decay: float) -> None:
        self.decay, self.alphabet = decay, np.array(sorted({ord(c) for s in strings for c in s}), np.int32)
        self.base = len(self.alphabet) + 1

    def keys(self, c: np.ndarray, places: tuple[np.ndarray, ...]) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, c), self.base - 2)
        at = np.where(self.alphabet[at] == c, at + 1, 0)  # other symbols are 0, which weighs nothing
        i, j, k = places
        return (at[:, i] * self.base + at[:, j]) * self.base + at[:, k]

    def table(self, strings: list[str]) -> np.ndarray:
        """The normalised sums of each string, a column a string."""
        out = np.zeros((self.base**3, len(strings)), np.float32)
        for n, s in enumerate(strings):
            c = codes([s], len(s))
            places = _triples(len(s))
            if len(places[0]):
                np.add.at(out[:, n], self.keys(c, places)[0], self.decay ** (places[2] - places[0] + 1))
                out[:, n] /= np.sqrt(max(own_kernel(c, self.decay)[0], 1e-12))
        return out

    def products(self, units: list[str], table: np.ndarray) -> np.ndarray:
        """The normalised kernel of each unit with what each column of ``table`` stands for."""
        out = np.zeros((len(units), table.shape[1]), np.float32)
        order = sorted(range(len(units)), key=lambda i: len(units[i]))
        length = np.array([len(units[i]) for i in order])
        for n in np.unique(length):
            rows = np.array(order)[length == n]
            places = _triples(int(n))
            if not len(places[0]):
                continue
            fade = (self.decay ** (places[2] - places[0] + 1)).astype(np.float32)
            step = max(1, 2_000_000 // (len(fade) * table.shape[1]))
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                c = codes([units[i] for i in part], int(n))
                norm = np.sqrt(np.maximum(own_kernel(c, self.decay), 1e-12))
                out[part] = np.einsum("utm,t->um", table[self.keys(c, places)], fade) / norm[:, None]
        return out


def features(units: list[str], landmarks: list[str], decay: float) -> np.ndarray:
    """Normalised kernel values of units with landmarks, some landmarks at a time."""
    parts = [landmarks[i : i + 32] for i in range(0, len(landmarks), 32)]
    return np.column_stack([t.products(units, t.table(p)) for p in parts for t in [Triples(p, decay)]])


class Model:
    """The trained scorer: one weight for each triple of symbols, a bias, the floor and the curve."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, decay: float) -> None:
        self.triples, self.bias, self.floor, self.curve = Triples(landmarks, decay), bias, -1.0, (1.0, 0.0)
        self.weights = np.zeros((self.triples.base**3, 1), np.float32)
        for i in range(0, len(landmarks), 32):
            self.weights += self.triples.table(landmarks[i : i + 32]) @ weights[i : i + 32, None].astype(np.float32)

    def margins(self, units: list[str]) -> np.ndarray:
        return np.maximum(self.floor, self.triples.products(units, self.weights)[:, 0] + self.bias)

    def probability(self, margin: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))


def root_of(kernel: np.ndarray) -> np.ndarray:
    """The inverse root of the landmarks' kernel matrix; directions of no weight are left out."""
    value, vector = np.linalg.eigh(kernel.astype(float))
    return vector @ np.diag(np.where(value > 1e-4, np.maximum(value, 1e-4) ** -0.5, 0)) @ vector.T


def train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> np.ndarray:
    """Primal Newton steps for the L2-regularised squared hinge; the last weight is the bias."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.append(np.ones(x.shape[1]), 1e-3)
    for _ in range(30):
        inside = y * (z @ w) < 1
        zi, ci = z[inside], weight[inside, None] * cost
        new = np.linalg.solve(np.diag(ridge) + (zi * ci).T @ zi, (zi * ci).T @ y[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def logistic(m: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """The curve over margins, by Newton steps on targets kept off 0 and 1."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z, w = np.column_stack([m, np.ones(len(m))]), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (target - p) - 1e-3 * w)
    return float(w[0]), float(w[1])


def ratio(n: np.ndarray, o: np.ndarray, q: float) -> np.ndarray:
    """The log-likelihood ratio of ``n`` toxic and ``o`` clean contexts against a share ``q`` of toxic ones."""
    n, o = np.asarray(n, float), np.asarray(o, float)
    both = np.maximum(n + o, 1)
    part = lambda x, share: x * np.log(np.maximum(x, 1e-9) / (both * share))
    return part(n, q) + part(o, 1 - q)


def marked(unit: str) -> str:
    """A unit between its marks, whole."""
    return _BEGIN + "".join(filter(str.isalnum, unit.translate(_STANDS))) + _END


def stems(pos: Counter, neg: Counter, decay: float) -> list[str]:
    """The pieces of units that tell toxic contexts from clean ones, none much like another; longer ones first where they tell as much.

    A piece tells if its log-likelihood ratio is one that chance would give less than one in seven times
    to any of as many pieces as were tried, and if its rate is over eight times that of clean contexts.
    """
    pieces = lambda u: {u[i : i + k] for k in range(4, min(12, len(u)) + 1) for i in range(len(u) - k + 1)}
    n1, n0 = sum(pos.values()), sum(neg.values())
    able = [(u, n) for u, n in pos.items() if len(u) <= 2 * _LONG and n / n1 > 4 * neg[u] / n0]
    # pieces are first counted by hash, so that only those that may tell are kept by name
    cells = np.zeros(_CELLS, np.int64)
    cell = lambda s: crc32(s.encode("utf-8", "surrogatepass")) % _CELLS
    for u, n in able:
        cells[[cell(s) for s in pieces(u)] or []] += n
    q = n1 / (n1 + n0)
    least = np.log(max(2, int((cells >= 3).sum()))) + 2
    need = max(3, least / -np.log(q))
    found: Counter = Counter()
    for u, n in able:
        for s in pieces(u):
            if cells[cell(s)] >= need:
                found[s] += n
    outside: Counter = Counter()
    for u, n in neg.items():
        for s in pieces(u) & found.keys():
            outside[s] += n
    names = list(found)
    n, o = np.array([found[s] for s in names], float), np.array([outside[s] for s in names], float)
    tells = {names[i]: n[i] / n1 - o[i] / n0 for i in (np.flatnonzero((n / n1 > 8 * o / n0) & (ratio(n, o, q) > least)) if names else [])}
    left = sorted(tells, key=lambda s: (-tells[s], -len(s), s))
    chosen: list[str] = []
    while left:
        c = left[0]
        chosen.append(c)
        t = Triples([c], decay)
        like = t.products(left, t.table([c]))[:, 0]
        left = [s for s, k in zip(left, like, strict=True) if k <= 0.5 and s not in c and c not in s]
    return chosen


def rare(pos: Counter, neg: Counter, chosen: list[str], decay: float, share: float = 0.02, fewest: int = 20, most: int = 2_000) -> list[str]:
    """Units that only toxic contexts have, where hardly any are to be expected by chance: insults too many to be told one by one.

    By chance as many units are in toxic contexts alone as in clean ones alone, for as many contexts. So the
    units taken are those of at least as many uses as leave at most ``share`` times as many clean ones. None is
    much like one of ``chosen`` or one before, and they are at most ``most``; with under ``fewest`` of them there are none.
    """
    n1, n0 = sum(pos.values()), sum(neg.values())
    own = {u: n for u, n in pos.items() if not neg[u] and len(u) > 4}
    by_chance = np.sort([n * n1 / n0 for u, n in neg.items() if not pos[u] and len(u) > 4])
    uses = np.sort(list(own.values()))
    for k in np.unique(uses):
        held = len(uses) - int(np.searchsorted(uses, k))
        if held >= fewest and len(by_chance) - int(np.searchsorted(by_chance, k)) <= share * held:
            break
    else:
        return []
    left, found = sorted((u for u, n in own.items() if n >= k), key=lambda u: (-own[u], -len(u), u)), []
    unlike = lambda c, units: [u for u, v in zip(units, features(units, [c], decay)[:, 0], strict=True) if v <= 0.5 and c not in u]
    for c in chosen:
        left = unlike(c, left) if left else left
    while left and len(found) < most:
        found.append(left[0])
        left = unlike(left[0], left[1:]) if left[1:] else []
    return found


def train(documents: list[tuple[str, int]], decay: float = 0.9, rounds: int = 4, near: int = 20_000) -> Model | None:
    """A model from (text, label) pairs; None without both labels or any telling unit.

    Of the clean units the SVM is trained on the ``near`` that are most like toxic landmarks.
    """
    y = np.array([int(label == 1) for _, label in documents])
    raw, seen = {0: Counter(), 1: Counter()}, set()
    for label in (0, 1):  # a context of clean documents is clean
        for (text, _), v in zip(documents, y, strict=True):
            for u, h in contexts(text) if v == label else ():
                if h not in seen:
                    seen.add(h)
                    raw[label][u] += 1
    del seen
    n1, n0 = (sum(raw[v].values()) for v in (1, 0))
    whole = {v: Counter() for v in raw}
    for v, of in raw.items():
        for u, n in of.items():
            whole[v][marked(u)] += n
    telling = stems(whole[1], whole[0], decay) if n1 and n0 else []
    telling += rare(whole[1], whole[0], telling, decay) if n1 and n0 else []
    if not telling:
        return None
    units = sorted({w for text, _ in documents for t in tokens(text) for w in windows(t)})
    at = {u: i for i, u in enumerate(units)}
    bags = [np.fromiter({at[w] for t in tokens(text) for w in windows(t)}, np.int32) for text, _ in documents]
    often, clean = (np.zeros(len(units)) for _ in range(2))
    for counted, of in ((often, raw[1]), (clean, raw[0])):
        for u, n in of.items():
            for w in windows(u):
                if w in at:
                    counted[at[w]] += n
    del raw, whole
    more = (ratio(often, clean, n1 / (n1 + n0)) > 6) & (often / n1 > 4 * clean / n0)
    accused = np.array([any(t in u for t in telling) if free else False for u, free in zip(units, clean == 0, strict=True)])
    toxic = features(units, telling, decay)
    like = toxic.max(axis=1)
    innocent = np.flatnonzero((clean > 0) & ~more)
    used = np.union1d(np.flatnonzero(accused | more & (like > 0)), innocent[np.lexsort((innocent, -like[innocent]))[:near]])
    names, toxic, often, clean, accused, more = [units[i] for i in used], toxic[used], often[used], clean[used], accused[used], more[used]
    many = max(16, len(telling))
    short = [i for i in np.lexsort((np.arange(len(names)), -clean)) if clean[i] and len(names[i]) <= _STRETCH + 2]
    hard = short[:many]
    for _ in range(2):  # first against frequent clean units, then against the clean units most like insults
        marks = [*telling, *(names[i] for i in hard)]
        root = root_of(features(marks, marks, decay))
        x = np.column_stack([toxic, features(names, marks[len(telling) :], decay)]).astype(float) @ root
        guilty = accused
        for _ in range(rounds):
            speak, fair = np.flatnonzero(guilty), np.flatnonzero((clean > 0) & ~guilty)
            both = np.concatenate([speak, fair])
            said = np.maximum(often[speak], 1)
            weight = np.concatenate([said / said.sum(), np.sqrt(clean[fair]) / np.sqrt(clean[fair]).sum() * 20])
            w = train_svm(x[both], np.repeat([1.0, -1.0], [len(speak), len(fair)]), weight, cost=1000.0)
            margin = x @ w[:-1] + w[-1]
            guilty = accused | (margin > 0) & more
        model = Model(marks, root @ w[:-1], float(w[-1]), decay)
        hard = sorted(short, key=lambda i: (-margin[i], names[i]))[:many]
    margin = model.margins(units)
    highest = np.array([max([model.floor, *margin[b]]) for b in bags])
    model.curve = logistic(highest, (y == 1).astype(float))
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 1_000) -> Model | None:
    """A model from at most ``most`` labelled documents of each class, whole: those whose hash of id and text comes first."""
    known = labels.where("toxic is not null").select(id_col, "toxic").distinct()
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect() if r["toxic"] in (0, 1)}
    if len(n) < 2:
        return None
    last = lambda v: first_hashes(min(1, 2 * most / n[v]))
    drawn = known.where(F.xxhash64(F.lit(1), id_col) <= F.when(F.col("toxic") == 1, F.lit(last(1))).otherwise(F.lit(last(0))))
    pairs = docs.select(id_col, text_col).join(drawn, id_col).select(text_col, "toxic", F.xxhash64(F.lit(1), id_col, text_col).alias("h"))
    told = [r for v in (0, 1) for r in pairs.where(F.col("toxic") == v).orderBy("h").limit(most).collect()]
    return train(sorted((r[0] or "", int(r[1])) for r in told))


class _Scores:
    """Margins of raw units seen by a worker, as many as ``_CACHED``."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def documents(self, texts: Iterable[str | None]) -> np.ndarray:
        floor, found = self.model.floor, [tokens(t) for t in texts]
        new = sorted(set().union(*found) - self.known.keys())
        if len(self.known) + len(new) > _CACHED:
            self.known, new = {}, sorted(set().union(*found))
        parts, owner = [], []
        for i, t in enumerate(new):
            w = windows(t)
            parts += w
            owner += [i] * len(w)
        margin = np.full(len(new), floor)
        if parts:
            np.maximum.at(margin, owner, self.model.margins(parts))
        self.known.update(zip(new, margin.tolist(), strict=True))
        known = self.known
        return np.array([max([floor, *[known[t] for t in d]]) for d in found])


def score_column(docs: DataFrame, model: Model | None, text: Column) -> Column:
    """The probability that each text is toxic."""
    if model is None:
        return F.lit(0.0)
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores = _Scores(shared.value)
        for s in batches:
            out = [scores.documents([t if isinstance(t, str) else None for t in s.iloc[i : i + 256]]) for i in range(0, len(s), 256)]
            yield pd.Series(shared.value.probability(np.concatenate(out)) if out else np.zeros(0))

    return of(text)
