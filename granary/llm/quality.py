"""Document quality from a linear-chain conditional random field over lines.

Every line gets features of its own (shares of character kinds, word lengths and repeats, runs of one word, whether the
line stood before) and those of the lines next to it. The field labels each line good or bad, with transitions between
lines. It is fitted in numpy on a sample of whole labelled documents: their lines start with the document's label, and
between fits the lines of bad documents are labelled anew by the best label sequence that holds a bad line, so that
sequences which change within a document teach the transitions. Forward-backward marginals, weighted by the lines'
lengths, give the document's share of good text, and a logistic on it gives the score.

Lines are whole, whatever their length; for the fit a document of over SPAN lines is cut into chains of that many.
Null and empty texts count as one empty line. Rows are scored one by one, whole; repeats and ties score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import fresh
from .toxicity import logistic

#: The sample that the model is fitted on: whole documents per class.
PER_CLASS = 1500
#: Bytes counted at a time, lines of a chain in the fit, and lines of a padded batch: these bound memory.
PIECE, SPAN, PADDED = 1 << 16, 200, 20_000


def byte_kinds() -> np.ndarray:
    """0 blank, 1 lower, 2 upper, 3 digit, 4 beyond ASCII, 5 end marks, 6 bars and tabs, 7 exclamation, 8 other signs, 9 control."""
    kind = np.full(256, 9, np.uint8)
    kind[33:127] = 8
    for k, chars in ((0, b" \n\r\f\v"), (1, bytes(range(97, 123))), (2, bytes(range(65, 91))), (3, b"0123456789"), (5, b".,;:?'\"-()"), (6, b"|\t"), (7, b"!")):
        kind[list(chars)] = k
    kind[128:] = 4
    return kind


KIND, KINDS, OWN = byte_kinds(), 10, 20


def lines_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split(b"\n")


def kinds_of(line: bytes) -> np.ndarray:
    """How many bytes of each kind a line has."""
    return sum(np.bincount(KIND[np.frombuffer(line[i : i + PIECE], np.uint8)], minlength=KINDS) for i in range(0, len(line), PIECE))


def own_features(lines: list[bytes]) -> np.ndarray:
    out, seen = np.zeros((len(lines), OWN), "f4"), set()
    for row, s in zip(out, lines, strict=True):
        n = len(s)
        row[0], row[1] = 1.0, min(1.0, np.log1p(n) / 12)
        if not n:
            row[2] = 1.0
            continue
        share = kinds_of(s) / n
        row[3 : 3 + KINDS] = np.sqrt(share)
        words = s.split()
        if words:
            w = len(words)
            row[13] = len(set(words)) / w
            row[14] = min(1.0, n / w / 20)
            row[15] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / w
            # Share of words that end in a sign: tables, shouting and noise put one on most words.
            row[16] = sum(KIND[x[-1]] >= 6 for x in words) / w
            row[17] = float(w < 4)
        row[18] = float(s in seen and n > 20)
        row[19] = float(share[2] > 0.6)
        seen.add(s)
    return out


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, features) with the neighbours' features beside each line's own, and the lines' weights."""
    lines = lines_of(text or "")
    own = own_features(lines)
    edge = np.zeros((1, OWN), "f4")
    return np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge])]), np.array([len(s) + 1.0 for s in lines])


def forward_backward(u: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(good) of each line; u is each line's log odds for good, trans[i, j] the score of j (1 good) after i."""
    n = len(u)
    e00, e01, e10, e11 = np.exp(trans).ravel().tolist()
    g = (1 / (1 + np.exp(-np.clip(u, -30, 30)))).tolist()  # emissions scaled to sum to 1
    ahead, f = [0.0] * n, g[0]
    ahead[0] = f
    for t in range(1, n):
        a, b = ((1 - f) * e01 + f * e11) * g[t], ((1 - f) * e00 + f * e10) * (1 - g[t])
        f = ahead[t] = a / (a + b)
    out, b1 = [0.0] * n, 0.5
    for t in range(n - 1, -1, -1):
        x, y = ahead[t] * b1, (1 - ahead[t]) * (1 - b1)
        out[t] = x / (x + y) if x + y else 0.5
        p, q = g[t] * b1, (1 - g[t]) * (1 - b1)
        one, zero = e11 * p + e10 * q, e01 * p + e00 * q
        b1 = one / (one + zero)
    return np.array(out)


@dataclass
class Model:
    w: np.ndarray
    trans: np.ndarray
    slope: float
    shift: float

    def lines(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Each line's marginal probability of being good, and its weight."""
        x, weight = features(text)
        return forward_backward(x @ self.w, self.trans), weight

    def raw(self, text: str | None) -> float:
        p, weight = self.lines(text)
        return float((p * weight).sum() / weight.sum())

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.raw(text) + self.shift, -40, 40))))


def gradients(x: np.ndarray, y: np.ndarray, mask: np.ndarray, line_w: np.ndarray, w: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood over padded documents (docs, lines, features), by forward-backward in step over all."""
    n, t_max, _ = x.shape
    u = np.clip(x @ w, -30, 30)
    g = 1 / (1 + np.exp(-u))
    em = np.stack([1 - g, g], 2) * mask[..., None] + (1 - mask[..., None]) * 0.5
    m = np.exp(trans)
    ahead, back = np.zeros((n, t_max, 2)), np.full((n, t_max, 2), 0.5)
    ahead[:, 0] = em[:, 0]
    for t in range(1, t_max):
        a = (ahead[:, t - 1] @ m) * em[:, t]
        ahead[:, t] = a / a.sum(1, keepdims=True)
    for t in range(t_max - 2, -1, -1):
        b = (em[:, t + 1] * back[:, t + 1]) @ m.T
        back[:, t] = np.where(mask[:, t + 1, None] > 0, b / b.sum(1, keepdims=True), 0.5)
    post = ahead * back
    post /= post.sum(2, keepdims=True)
    dw = np.einsum("ntf,nt->f", x, (y - post[..., 1]) * mask * line_w)
    both = mask[:, 1:] * mask[:, :-1]
    pair = ahead[:, :-1, :, None] * m[None, None] * (em * back)[:, 1:, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    yy = np.stack([1 - y, y], 2)
    dt = ((yy[:, :-1, :, None] * yy[:, 1:, None, :] - pair) * (both * line_w[:, 1:])[..., None, None]).sum((0, 1))
    return dw, dt


def best_with_bad(u: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The likeliest labels (1 good) of a document's lines among those that hold a bad line, by Viterbi.

    States: 0 bad, 1 good after a bad line, 2 good with none so far; the last state may not be 2.
    """
    n = len(u)
    step = np.array([[trans[0, 0], trans[0, 1], -np.inf], [trans[1, 0], trans[1, 1], -np.inf], [trans[1, 0], -np.inf, trans[1, 1]]])
    at, back = np.array([0.0, -np.inf, u[0]]), np.zeros((n, 3), np.int64)
    for t in range(1, n):
        via = at[:, None] + step
        back[t] = via.argmax(0)
        at = via.max(0) + np.array([0.0, u[t], u[t]])
    state, out = int(at[:2].argmax()), np.zeros(n)
    for t in range(n - 1, -1, -1):
        out[t] = state > 0
        state = back[t, state]
    return out


def batched(docs: list[np.ndarray], y: list[np.ndarray], weight: list[float]) -> list[list[np.ndarray]]:
    """Chains of SPAN lines at most as padded (features, labels, mask, line weights), alike in length, of PADDED lines."""
    chains = sorted(((x[k : k + SPAN], v[k : k + SPAN], w / len(x)) for x, v, w in zip(docs, y, weight, strict=True) for k in range(0, len(x), SPAN)), key=lambda c: len(c[0]))
    out, k = [], 0
    while k < len(chains):
        n = 1
        while k + n < len(chains) and (n + 1) * len(chains[k + n][0]) <= PADDED:
            n += 1
        part, t = chains[k : k + n], len(chains[k + n - 1][0])
        x, mask, label, line = np.zeros((n, t, 3 * OWN), "f4"), *np.zeros((3, n, t), "f4")
        for i, (f, v, w) in enumerate(part):
            x[i, : len(f)], mask[i, : len(f)], label[i, : len(f)], line[i, : len(f)] = f, 1, v, w
        out.append([x, label, mask, line])
        k += n
    return out


def fit(rows: list[tuple[str, int]], rounds: int = 3, steps: int = 60) -> Model:
    """Train on (text, 0 or 1), whole texts."""
    wide = 3 * OWN
    if len({y for _, y in rows}) < 2:
        return Model(np.zeros(wide), np.zeros((2, 2)), 0.0, 4.0 if not rows or rows[0][1] else -4.0)
    docs, label = [features(t)[0] for t, _ in rows], np.array([y for _, y in rows])
    share = [0.5 / (label == v).sum() for v in (0, 1)]
    w, trans = np.zeros(wide), np.zeros((2, 2))
    for turn in range(rounds):
        y = [best_with_bad(x @ w, trans) if turn and not v else np.full(len(x), float(v)) for x, v in zip(docs, label, strict=True)]
        batches = batched(docs, y, [share[v] for v in label])
        m1, m2 = [np.zeros_like(w), np.zeros_like(trans)], [np.zeros_like(w), np.zeros_like(trans)]
        for s in range(1, steps + 1):
            dw, dt = (sum(g) for g in zip(*[gradients(*b, w, trans) for b in batches], strict=True))
            # The first fit is of lines alone: sequences of one label would teach that labels never change.
            for k, (v, g) in enumerate(((w, dw - 1e-4 * w), (trans, dt - 1e-4 * trans))[: 1 + (turn > 0)]):
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                v += 0.15 * (m1[k] / (1 - 0.9**s)) / (np.sqrt(m2[k] / (1 - 0.99**s)) + 1e-8)
    model = Model(w, trans, 1.0, 0.0)
    raw = np.array([model.raw(t) for t, _ in rows])
    model.slope, model.shift = logistic(raw, label.astype(float))
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return fit(labelled.sample(docs, labels, "quality", per_class))


def scored(df: DataFrame, model: Model, text: str = "text", out: str = "quality_score") -> DataFrame:
    """`df` with a score from 0 to 1."""
    return labelled.with_score(df, model, text, out)


def line_labels(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, p_good, weight): one row for each line, or piece of a very long one."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in zip(b.column(0), b.column(1), strict=True):
                p, w = held.value.lines(t.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(p), b.column(0).type), pa.array(np.arange(len(p))), pa.array(p), pa.array(w)], names=["key", "line", "p_good", "weight"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"key {kind}, line bigint, p_good double, weight double").withColumnRenamed("key", key)


def good_only(df: DataFrame, model: Model, text: str = "text", least: float = 0.3) -> DataFrame:
    (name,) = fresh(df, "_quality")
    return scored(df, model, text, name).filter(F.col(name) >= least).drop(name)
