"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A window of a few words is the bag of its words' character n-grams (with word marks) and the words themselves, hashed
into buckets. The bag's mean embedding goes through a linear softmax over clean and toxic; embeddings and softmax are
trained together in numpy. Labels are of documents, of which a toxic one may hold a single bad window, so training
alternates: the windows that score highest in a document stand for it, beside many windows of clean documents.
A document scores by its highest windows, put through a logistic fitted on the same sample.

After averaging everything is linear, so a word's share is one number and one count, kept in a table while scoring;
windows are sums over those. Misspellings and new endings share n-grams with the words seen.
A run of over LONG characters without white space is cut at marks, then every LONG characters with an overlap that keeps
every n-gram, and each piece is a word, in the fit as in scoring.
Null and empty texts have no windows and get the score of a clean text. Rows are scored one by one, whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import fresh

BUCKETS, DIM, SIZES, WINDOW = 1 << 16, 12, (3, 4, 5), 4
#: Most words whose sums are kept at a time, and words looked up at a time; these bound memory and change no score.
TABLE, PART = 60_000, 20_000
MARKS = ".,;:!?\"'()[]{}|*#%&$<>-_"
LONG, CUTS = 60, re.compile(f"[{re.escape(MARKS)}/\\\\=+@~^`、。，；：！？]+")
#: The sample that the model is fitted on: whole documents per class.
PER_CLASS = 2000


def subwords(word: str) -> list[int]:
    w = f"<{word}>"
    n = len(w)
    if w.isascii():
        b = w.encode()
        return [crc32(b) % BUCKETS] + [crc32(b[i : i + k]) % BUCKETS for k in SIZES for i in range(n - k + 1)]
    grams = [w] + [w[i : i + k] for k in SIZES for i in range(n - k + 1)]
    return [crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams]


def split(text: str) -> list[str]:
    words = text.lower().split()
    if not words or max(map(len, words)) <= LONG:
        return words
    return [p for w in words for p in ([w] if len(w) <= LONG else pieces(w))]


def pieces(run: str) -> list[str]:
    """All of a long run, in words of at most LONG characters."""
    lap = max(SIZES) - 1
    return [p[i : i + LONG] for p in CUTS.split(run) for i in range(0, max(1, len(p) - lap), LONG - lap) if p]


class Words(dict):
    """Words to rows of `values`: the sum of the word's subwords' shares, and their number."""

    def __init__(self, share: np.ndarray):
        super().__init__()
        self.share, self.values = share.tolist(), np.zeros((1 << 12, 2))

    def __missing__(self, w: str) -> int:
        bare = w.strip(MARKS)
        ids = subwords(bare) if bare else []
        i = len(self)
        if i == len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[i, 0], self.values[i, 1] = sum(map(self.share.__getitem__, ids)), len(ids)
        self[w] = i
        return i

    def rows(self, words: list[str]) -> np.ndarray:
        out = []
        for k in range(0, len(words), PART):
            if len(self) > TABLE:
                self.clear()
                self.values = np.zeros((1 << 12, 2))
            part = words[k : k + PART]
            at = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            out.append(self.values[at])
        return np.concatenate(out) if out else np.zeros((0, 2))


@dataclass
class Model:
    share: np.ndarray  # per bucket: what its embedding adds to toxic less clean
    bias: float
    slope: float
    shift: float

    def __post_init__(self) -> None:
        self.table = Words(self.share)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def windows(self, text: str) -> np.ndarray:
        """The logit of every window of consecutive words."""
        got = self.table.rows(split(text))
        got = got[got[:, 1] > 0]
        if not len(got):
            return np.array([self.bias])
        sums = np.vstack([np.zeros((1, 2)), np.cumsum(got, axis=0)])
        k = min(WINDOW, len(got))
        part = sums[k:] - sums[:-k]
        return part[:, 0] / part[:, 1] + self.bias

    def raw(self, text: str) -> float:
        """The mean of the highest window and the highest beside it that shares no word with it."""
        w = self.windows(text)
        at = int(w.argmax())
        rest = np.concatenate([w[: max(0, at - WINDOW + 1)], w[at + WINDOW :]])
        return float(w[at] + (rest.max() if len(rest) else w[at])) / 2

    def score(self, text: str | None) -> float:
        z = self.slope * self.raw(text or "") + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift of P(y) by Newton's method, a little regularised."""
    if len(set(y.tolist())) < 2:
        return 0.0, 4.0 if len(y) and y[0] else -4.0
    m, s = x.mean(), x.std() + 1e-9
    a, w = np.stack([(x - m) / s, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 0.05 * w * (1, 0)
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag((0.05, 1e-6))
        w -= np.clip(np.linalg.solve(h, g), -2, 2)
    return float(w[0] / s), float(w[1] - w[0] * m / s)


class Trainer:
    """Embeddings and softmax under AdaGrad, on bags given as flat ids and starts."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.rng, self.e = rng, rng.normal(0, 0.1, (BUCKETS, DIM)).astype("f4")
        self.w, self.b = rng.normal(0, 0.5, (DIM, 2)).astype("f4"), np.zeros(2, "f4")
        self.ge, self.gw = np.full(BUCKETS, 1e-4, "f4"), 1e-4

    def step(self, flat: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        n = np.diff(np.append(starts, len(flat)))
        mean = np.add.reduceat(self.e[flat], starts, axis=0) / n[:, None]
        z = mean @ self.w + self.b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - np.eye(2, dtype="f4")[y]) * (weight / weight.sum())[:, None]
        dm = np.repeat((d @ self.w.T) / n[:, None], n, axis=0)
        order = np.argsort(flat, kind="stable")
        ids, at = np.unique(flat[order], return_index=True)
        g = np.add.reduceat(dm[order], at, axis=0)
        self.ge[ids] += (g * g).mean(1)
        self.e[ids] -= rate * g / np.sqrt(self.ge[ids])[:, None]
        gw = mean.T @ d
        self.gw += float((gw * gw).mean())
        self.w -= 0.3 * rate * gw / np.sqrt(self.gw)
        self.b -= rate * d.sum(0)

    def model(self) -> Model:
        delta = self.w[:, 1] - self.w[:, 0]
        return Model((self.e @ delta).astype("f8"), float(self.b[1] - self.b[0]), 1.0, 0.0)


def misspelt(word: str, rng: np.random.Generator) -> str:
    """The word with one letter inside dropped, doubled or replaced."""
    if len(word) < 4:
        return word
    i, kind = int(rng.integers(1, len(word) - 1)), int(rng.integers(3))
    return word[:i] + ("", word[i] * 2, "aeiou0134*"[int(rng.integers(10))])[kind] + word[i + 1 :]


def bagged(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' subwords as flat ids, sizes and starts."""
    bags = [np.array(subwords(w), np.int32) for w in words] or [np.zeros(0, np.int32)]
    sizes = np.array([len(b) for b in bags] if words else [], np.int64)
    return np.concatenate(bags), sizes, np.append(0, np.cumsum(sizes))[:-1]


def fit(rows: list[tuple[str, int]], rounds: int = 4, steps: int = 150, batch: int = 1024, seed: int = 7) -> Model:
    """Train on (text, 0 or 1)."""
    rows = [(t, y) for t, y in rows if t.strip()]
    if len({y for _, y in rows}) < 2:
        return Model(np.zeros(BUCKETS), 0.0, 0.0, 4.0 if rows and rows[0][1] else -4.0)
    number: dict[str, int] = {}
    docs = [(np.array([number.setdefault(w, len(number)) for w in (x.strip(MARKS) for x in split(t)) if w], np.int64), y) for t, y in rows]
    docs = [(w, y) for w, y in docs if len(w)]
    flat_all, sizes, offset = bagged(list(number))
    rng, trainer = np.random.default_rng(seed), Trainer(seed)
    toxic, clean = [w for w, y in docs if y], [w for w, y in docs if not y]

    def cut(words: np.ndarray, at: int) -> np.ndarray:
        return words[at : at + WINDOW]

    def anywhere(pool: list[np.ndarray], n: int) -> list[np.ndarray]:
        lengths = np.array([len(w) for w in pool], float)
        return [cut(pool[i], int(rng.integers(max(1, len(pool[i]) - WINDOW + 1)))) for i in rng.choice(len(pool), n, p=lengths / lengths.sum())]

    def tops(pool: list[np.ndarray], share: np.ndarray, most: int) -> list[np.ndarray]:
        """Each document's `most` highest windows that share no word."""
        value = np.add.reduceat(share[flat_all], offset)
        out = []
        for w in pool:
            k = min(WINDOW, len(w))
            v, c = np.cumsum(np.append(0, value[w])), np.cumsum(np.append(0, sizes[w]))
            z = (v[k:] - v[:-k]) / (c[k:] - c[:-k])
            for _ in range(most):
                at = int(z.argmax())
                if not np.isfinite(z[at]):
                    break
                out.append(cut(w, at))
                z[max(0, at - WINDOW + 1) : at + WINDOW] = -np.inf
        return out

    for turn in range(rounds):
        if turn == 0:
            positive, hard = None, []
        else:
            share = trainer.model().share
            positive, hard = tops(toxic, share, 2), tops(clean, share, 1)
            # Misspelt copies of both, so that a misspelling itself says nothing.
            names, known = list(number), len(number)
            positive, hard = ([*x, *[np.array([number.setdefault(misspelt(names[i], rng), len(number)) for i in w]) for w in x]] for x in (positive, hard))
            more, n_more, _ = bagged(list(number)[known:])
            flat_all, sizes = np.concatenate([flat_all, more]), np.concatenate([sizes, n_more])
            offset = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for s in range(steps):
            pos = anywhere(toxic, batch // 2) if positive is None else [positive[i] for i in rng.integers(len(positive), size=batch // 3)]
            neg = anywhere(clean, batch // 2) + ([hard[i] for i in rng.integers(len(hard), size=batch // 4)] if hard else [])
            wins = pos + neg
            y = np.array([1] * len(pos) + [0] * len(neg))
            words = np.concatenate(wins)
            n = sizes[words]
            flat = flat_all[np.repeat(offset[words] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]
            per_word = np.append(0, np.cumsum(n))
            lens = np.append(0, np.cumsum([len(w) for w in wins])[:-1])
            trainer.step(flat, per_word[lens], y, np.where(y == 1, len(neg) / len(pos), 1.0).astype("f4"), 0.5 * (1 - s / steps) + 0.05)
    model = trainer.model()
    x = np.array([model.raw(t) for t, _ in rows])
    y = np.array([y for _, y in rows], float)
    model.slope, model.shift = logistic(x, y)
    model.table.clear()
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return fit(labelled.sample(docs, labels, "toxic", per_class))


def scored(df: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """`df` with a score from 0 to 1."""
    return labelled.with_score(df, model, text, out)


def without_toxic(df: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """`df` without the rows that score `least` or more."""
    (name,) = fresh(df, "_toxicity")
    return scored(df, model, text, name).filter(F.col(name) < least).drop(name)
