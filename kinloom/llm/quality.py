"""Quality by positive-unlabelled learning.

A network of one hidden layer reads counts of a text: character classes, word
and line repetition, lengths. It is trained on trusted positives (labelled 1) and
unlabelled web text by the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the logistic loss; where the second part falls below zero its gradient is
turned round. The class prior is estimated first, without negatives: a network
that tells positives from unlabelled texts is fitted on one half, and on the
other half the smallest ratio of the two tails' shares over all cuts (with an
allowance for their sampling error) bounds the share of positives from above.

The curve that turns a decision into a probability has two numbers. They minimise
the same unbiased risk, which for the logistic loss is convex in them. Labels 0
are used for nothing.

Samples are chosen by a hash of the id: about ``FIT_POSITIVE`` documents labelled
1 and ``FIT_UNLABELLED`` documents of any kind, whole, of which the driver receives
the counts. Scoring counts whole texts of any length. Null and empty texts have
counts of 0; without positives every score is 0.5; equal texts get equal scores;
a row labelled twice is used twice, a null id never; further columns, whatever
their names, are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import held_out, map_arrow, texts_of
from kinloom.llm.toxicity import labelled_sample, score

FIT_POSITIVE = 2500
FIT_UNLABELLED = 3000
HIDDEN = 24
EPOCHS = 120
THRESHOLD = 0.3
#: Pull of the curve towards the network's own decision; chosen on rows to learn from.
RIDGE = 0.003

_KIND = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 1 if _c in "abcdefghijklmnopqrstuvwxyz" else 2 if "A" <= _c <= "Z" else 3 if "0" <= _c <= "9" else 4 if _c in " \t" else 5 if _c in "\r\n" else 6 if _c in ".,;:" else 7 if _c in "!?" else 8 if _c in "'\"()-" else 9 if _c in "<>{}[]/\\=" else 10 if _c in "|" else 11 if _c in "#$%&*@^~+_" else 12 if _b >= 128 else 0


def features(text: str) -> np.ndarray:
    """Counts of a whole text, as shares and logarithms."""
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(_KIND, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=13)
    share = kinds / max(1, len(raw))
    words = raw.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    times = np.fromiter(counts.values(), np.float64, len(counts))
    most = times.max() / n if len(times) else 0.0
    twice = sum(1 for a, b in zip(words, words[1:]) if a == b) / n
    other = kinds[4:12].sum() - kinds[4] - kinds[5]
    return np.array([
        *np.sqrt(share), np.log1p(len(raw)), np.log1p(len(words)), len(raw) / n / 10, len(counts) / n, len(counts) / np.sqrt(n) / 10, most, twice,
        (times[times > 1].sum() / n) if len(times) else 0.0, len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)), np.log1p(len(raw) / max(1, len(lines))), other / n, kinds[2] / max(1.0, kinds[1] + kinds[2]), float(len(words) == 0),
    ])


def _train(x: np.ndarray, loss_gradient, seed: int, epochs: int = EPOCHS, batch: int = 512) -> list[np.ndarray]:
    """Adam over the weights of a network of one hidden layer; loss_gradient gives d loss / d decision of a batch of row numbers."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    p = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            rows = order[i : i + batch]
            h = np.tanh(x[rows] @ p[0] + p[1])
            g = loss_gradient(rows, h @ p[2] + p[3])
            if g is None:
                continue
            back = np.outer(g, p[2]) * (1 - h * h)
            step += 1
            for k, grad in enumerate((x[rows].T @ back, back.sum(0), h.T @ g, np.array([g.sum()]))):
                grad = grad + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                p[k] = p[k] - 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p


def _decide(x: np.ndarray, p: list[np.ndarray]) -> np.ndarray:
    return np.tanh(x @ p[0] + p[1]) @ p[2] + p[3][0]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(x: np.ndarray, positive: np.ndarray, seed: int = 3) -> float:
    """The share of positives among the unlabelled rows, from above."""
    half = np.random.default_rng(seed).random(len(x)) < 0.5
    a, pos = x[half], positive[half]
    w = np.where(pos, 0.5 / max(1, pos.sum()), 0.5 / max(1, (~pos).sum())) * len(a)
    net = _train(a, lambda rows, z: w[rows] * (_sigmoid(z) - pos[rows]) / len(rows), seed, EPOCHS // 3)
    z, pos = _decide(x[~half], net), positive[~half]
    zp, zu = np.sort(z[pos]), np.sort(z[~pos])
    if not len(zp) or not len(zu):
        return 0.5
    cuts = np.quantile(z, np.linspace(0, 0.995, 400))
    tail = lambda s: 1 - np.searchsorted(s, cuts) / len(s)
    slack = lambda s: np.sqrt(np.log(40) / (2 * len(s)))
    qp, qu = tail(zp), tail(zu)
    ok = qp > 3 * slack(zp)
    bound = (qu + slack(zu) + slack(zp)) / np.maximum(qp, 1e-9)
    at = int(np.argmin(np.where(ok, bound, np.inf)))
    return float(np.clip(qu[at] / max(qp[at], 1e-9), 0.02, 0.98))


def pu_train(x: np.ndarray, positive: np.ndarray, prior: float, seed: int = 5) -> list[np.ndarray]:
    """The network of least non-negative risk; positive marks the trusted rows, the others are unlabelled."""

    def gradient(rows, z):
        pos = positive[rows]
        n_p, n_u = pos.sum(), (~pos).sum()
        if not n_p or not n_u:
            return None
        s = _sigmoid(z)
        loss = np.logaddexp(0, z)  # of calling a row negative
        negative = loss[~pos].mean() - prior * loss[pos].mean()
        g = np.where(pos, -prior * s / n_p, s / n_u)
        if negative < 0:
            return -g
        return g + np.where(pos, -prior * (1 - s) / n_p, 0.0)

    return _train(x, gradient, seed)


@dataclass
class QualityModel:
    net: list[np.ndarray] | None
    mean: np.ndarray
    scale: np.ndarray
    prior: float
    slope: float = 1.0
    level: float = 0.0

    def decide(self, x: np.ndarray) -> np.ndarray:
        return _decide(np.clip((x - self.mean) / self.scale, -8, 8), self.net)

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.net is None or not texts:
            return np.full(len(texts), 0.5)
        return _sigmoid(self.slope * self.decide(np.array([features(t) for t in texts])) + self.level)


def _curve(positive: np.ndarray, unlabelled: np.ndarray, prior: float, ridge: float = RIDGE) -> tuple[float, float]:
    """Slope and level of least unbiased logistic risk, from the decisions of positives and of unlabelled rows."""
    start = np.array([1.0, 0.0])
    x, w = np.stack([unlabelled, np.ones_like(unlabelled)], 1), start
    pull = prior * np.array([positive.mean(), 1.0])
    for _ in range(100):
        p = _sigmoid(x @ w)
        gradient = x.T @ p / len(x) - pull + ridge * (w - start)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(2), gradient)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 0.05)), float(w[1])


def train(positive: list[str], unlabelled: list[str], prior: float | None = None) -> QualityModel:
    of = lambda texts: np.array([features(t) for t in texts])
    return train_features(of(positive), of(unlabelled), prior)


def train_features(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> QualityModel:
    if not len(positive) or not len(unlabelled):
        return QualityModel(None, np.zeros(1), np.ones(1), 0.5)
    x = np.concatenate([positive, unlabelled])
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    is_positive = np.arange(len(z)) < len(positive)
    prior = estimate_prior(z, is_positive) if prior is None else prior
    model = QualityModel(pu_train(z, is_positive, prior), mean, scale, prior)
    model.slope, model.level = _curve(model.decide(positive), model.decide(unlabelled), prior)
    return model


def _counted(rows: DataFrame) -> np.ndarray:
    """The features of rows (doc_id, text), in an order of their own."""

    def run(batches):
        for batch in batches:
            found = [features(t).tolist() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "x"])

    found = map_arrow(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, x array<double>").collect()
    return np.array([r["x"] for r in sorted(found, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["x"]))])


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """docs and labels: the rows that may be learned from."""
    positive = labelled_sample(docs, labels, "quality", {1: FIT_POSITIVE})
    there = docs.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit("unlabelled")), F.lit(1 << 30))
    unlabelled = docs.where(part < int(min(1.0, FIT_UNLABELLED / max(1, there)) * (1 << 30)))
    return train_features(_counted(positive), _counted(unlabelled))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from rows whose id's checksum is no multiple of 5, scores all documents."""
    held = held_out(F.col("doc_id"), 5, 0)
    return score(docs, fit(docs.where(~held), labels.where(~held)), held, THRESHOLD)
