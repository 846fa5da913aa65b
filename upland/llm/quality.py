"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text are all it needs: with the share of positives in unlabelled text (the class
prior, estimated first), the risk of a scorer is written from those two samples alone, and the part that stands for the
negatives is kept from going below zero while it is minimised. A small network over counts of a text does the scoring.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upland.llm.common import byte_view, slices, span_hashes, stash, text_of

MOST_POSITIVES = 20_000      # rows read by the driver to fit the scorer; everything else covers all rows
MOST_UNLABELLED = 40_000
HIDDEN = 16
STEPS = 600
ACCEPT = 0.7

NAMES = ("log_words", "upper", "digit", "symbol", "bang", "bar", "space", "other", "word_bytes", "distinct", "again", "top", "line", "short")


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SPACE, UPPER, DIGIT = _class(b" \t\n\x0b\x0c\r"), _class(bytes(range(65, 91))), _class(bytes(range(48, 58)))
CLASSES = (UPPER, DIGIT, _class(b"#$%&*@^~=+<>{}[]\\_"), _class(b"!?"), _class(b"|/"), SPACE, _class(bytes(range(128, 256))))
NEWLINE, LOWER = 10, np.array([c + 32 if 65 <= c < 91 else c for c in range(256)], np.uint8)


def features(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of NAMES per text: shares of byte classes, and of distinct, repeated, commonest and short words."""
    n = len(ends) - 1
    out = np.zeros((n, len(NAMES)))
    for lo, hi in slices(ends):
        data, off = raw[ends[lo]:ends[hi]], ends[lo:hi + 1] - ends[lo]
        size = np.maximum(np.diff(off), 1)
        part = out[lo:hi]

        def per_text(mask):
            upto = np.concatenate([[0], np.cumsum(mask)])
            return upto[off[1:]] - upto[off[:-1]]

        for i, c in enumerate(CLASSES):
            part[:, 1 + i] = per_text(c[data]) / size
        word = ~SPACE[data]
        edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
        cut = np.zeros(len(data) + 1, bool)
        cut[off] = True
        starts = np.flatnonzero((edge == 1) | cut & np.concatenate([word, [False]]))
        stops = np.flatnonzero((edge == -1) | cut & np.concatenate([[False], word]))
        doc = np.searchsorted(off, starts, "right") - 1
        words = np.bincount(doc, minlength=hi - lo)
        low = LOWER[data]
        h = span_hashes(low, starts, stops)
        size_w = np.maximum(words, 1)
        part[:, 0] = np.log1p(words)
        part[:, 8] = np.minimum(np.bincount(doc, stops - starts, hi - lo) / size_w, 40) / 10
        part[:, 13] = np.bincount(doc, stops - starts <= 2, hi - lo) / size_w
        if len(h) > 1:
            same = (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])
            part[:, 10] = np.bincount(doc[1:], same, hi - lo) / size_w
        order = np.lexsort((h, doc))
        hs, ds = h[order], doc[order]
        new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])]) if len(hs) else np.zeros(0, bool)
        distinct = np.bincount(ds, new, hi - lo)
        part[:, 9] = np.where(words > 1, np.log(np.maximum(distinct, 1)) / np.log(np.maximum(words, 2)), 1)
        if len(hs):
            run = np.diff(np.concatenate([np.flatnonzero(new), [len(hs)]]))
            top = np.zeros(hi - lo)
            np.maximum.at(top, ds[new], run)
            part[:, 11] = top / size_w
        lines = per_text(data == NEWLINE)
        part[:, 12] = np.minimum(lines / size_w, 1)
    return out


def feature_column(text: Column) -> Column:
    def of(texts: pa.Array) -> pa.Array:
        x = features(*byte_view(texts))
        return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))

    return F.arrow_udf(of, "array<double>")(text)


# ---------------------------------------------------------------- learning


@dataclass(frozen=True)
class Scorer:
    """A network with one hidden layer over scaled features; prior is the share of positives it was fitted with."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(_scaled(x, self.mean, self.scale) @ self.w1 + self.b1)
        return np.clip(h @ self.w2 + self.b2, -30, 30)


def _scaled(x, mean, scale):
    return np.clip((x - mean) / scale, -8, 8)


def _fit(positive: np.ndarray, unlabelled: np.ndarray, gradient, mean, scale, steps: int, seed: int):
    rng = np.random.default_rng(seed)
    p, u = _scaled(positive, mean, scale), _scaled(unlabelled, mean, scale)
    theta = [rng.normal(0, 0.4, (p.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1):
        a, b = p[rng.integers(0, len(p), 1024)], u[rng.integers(0, len(u), 2048)]
        x = np.concatenate([a, b])
        h = np.tanh(x @ theta[0] + theta[1])
        g = gradient(np.clip(h @ theta[2] + theta[3], -30, 30), len(a))
        back = np.outer(g, theta[2]) * (1 - h * h)
        grads = [x.T @ back, back.sum(0), h.T @ g, g.sum(keepdims=True)]
        for t, d, m, v in zip(theta, grads, first, second):
            d = d + 1e-4 * t
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            t -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta


def _sigmoid(m):
    return 1 / (1 + np.exp(-m))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int) -> float:
    """The share of positives in unlabelled text: a scorer that tells the two samples apart ranks them, half of each
    sample being kept for this. Whatever part of the positives scores above a threshold, the unlabelled rows above it
    number at least prior times that part, so the smallest ratio over the thresholds bounds the prior; thresholds that
    few rows pass are allowed for their chance error."""
    rng = np.random.default_rng(seed)
    p, u = rng.permutation(positive), rng.permutation(unlabelled)
    mean, scale = u.mean(0), u.std(0) + 1e-3
    hp, hu = len(p) // 2, len(u) // 2

    def gradient(m, n):
        s = _sigmoid(m)
        return np.concatenate([(s[:n] - 1) / n, s[n:] / (len(m) - n)])

    theta = _fit(p[:hp], u[:hu], gradient, mean, scale, 300, seed)
    rank = lambda x: np.sort(np.tanh(_scaled(x, mean, scale) @ theta[0] + theta[1]) @ theta[2])
    a, b = rank(p[hp:]), rank(u[hu:])
    at = np.unique(np.quantile(a, np.linspace(0, 0.98, 200)))
    q_p, q_u = 1 - np.searchsorted(a, at) / len(a), 1 - np.searchsorted(b, at) / len(b)
    slack = np.sqrt(np.log(200 / 0.1) / 2) * (1 / np.sqrt(len(a)) + 1 / np.sqrt(len(b)))
    best = np.argmin((q_u + slack) / np.maximum(q_p, 1e-9))
    return float(np.clip(q_u[best] / max(q_p[best], 1e-9), 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = STEPS, seed: int = 11) -> Scorer:
    """Minimise prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)) with the logistic loss. Where the
    second part falls below zero, steps are taken the other way, so the scorer doesn't make up negatives."""
    prior = estimate_prior(positive, unlabelled, seed) if prior is None else prior
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3

    def gradient(m, n):
        s, loss = _sigmoid(m), np.logaddexp(0, m)      # the loss of calling a row positive when it is not
        rest = loss[n:].mean() - prior * loss[:n].mean()
        g_u, g_n = s[n:] / (len(m) - n), -prior * s[:n] / n
        if rest < 0:
            return np.concatenate([-g_n, -g_u])
        return np.concatenate([prior * (s[:n] - 1) / n + g_n, g_u])

    w1, b1, w2, b2 = _fit(positive, unlabelled, gradient, mean, scale, steps, seed)
    return Scorer(mean, scale, w1, b1, w2, float(b2[0]), prior)


def bounded_sample(df: DataFrame, most: int) -> np.ndarray:
    """At most `most` rows of a feature table, the first by a hash of their id."""
    rows = df.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(most).select("x").toArrow()["x"].combine_chunks()
    return rows.flatten().to_numpy().reshape(-1, len(NAMES))


def learn(rows: DataFrame, labels: DataFrame, most_positives: int = MOST_POSITIVES, most_unlabelled: int = MOST_UNLABELLED, prior: float | None = None) -> Scorer | None:
    """Fit a scorer from a feature table (doc_id, x): positives are the documents labelled 1, unlabelled text is a
    sample of all of them. None where either is missing."""
    good = labels.where("quality = 1").select(labels["doc_id"].alias("id")).distinct()
    positive = bounded_sample(rows.join(good, rows["doc_id"] == F.col("id"), "left_semi"), most_positives)
    unlabelled = bounded_sample(rows, most_unlabelled)
    return fit(positive, unlabelled, prior) if len(positive) >= 8 and len(unlabelled) >= 8 else None


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def score_column(x: Column, scorer: Scorer | None) -> Column:
    if scorer is None:
        return F.lit(0.5)

    def of(rows: pa.Array) -> pa.Array:
        flat = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
        return pa.array(scorer.score(flat))

    return F.arrow_udf(of, "double")(x)


def scores(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from ACCEPT on).

    A null text counts as empty and is scored like any text; a null id is never held out; repeated rows get equal
    scores; null labels are no labels; without positives every score is 0.5; an empty table gives no rows; other
    columns are not looked at."""
    rows = stash(docs.select(docs["doc_id"].alias("doc_id"), feature_column(text_of(docs)).alias("x")))
    own = labels.select(labels["doc_id"].alias("doc_id"), labels["quality"].alias("quality")).where(~held_out(F.col("doc_id")))
    scorer = learn(rows, own, **how)
    out = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(F.col("x"), scorer).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents the classifier accepts, with all their columns."""
    rows = stash(docs.select(docs["doc_id"].alias("doc_id"), feature_column(text_of(docs)).alias("x")))
    own = labels.select(labels["doc_id"].alias("doc_id"), labels["quality"].alias("quality")).where(~held_out(F.col("doc_id")))
    scorer = learn(rows, own, **how)
    if scorer is None:
        return docs
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), feature_column(text_of(docs)).alias("x"))
    return row.where(score_column(F.col("x"), scorer) >= ACCEPT).select("row.*")
