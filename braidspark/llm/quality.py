"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1; unlabelled rows are all training rows, web text of any quality. Other labels are
not looked at. A linear model on hashed style features minimises the non-negative unbiased risk

    prior * R_p(+)  +  max(0, R_u(-) - prior * R_p(-))

with the logistic loss, for which R_p(+) - R_p(-) is linear, so that the risk is the greater of two convex functions:
prior * R_p(+) alone, and with the bracket, the risk on the hidden negatives. A smooth maximum of the two is minimised by
L-BFGS (`fit_nnpu`). The class prior is the least ratio of unlabelled to positive mass above any score of a
plain model of positives against unlabelled rows, fitted on half of the positives and read off the other half
(`estimate_prior`).

Features of all rows are extracted once and written, as half-precision numbers. The risk on unlabelled rows is that of
every row: each evaluation is one map-side scan of the features that returns FEATURES + 1 sums of a task, added up by
Spark. Trusted positives are at most about SAMPLE rows, drawn by a hash; the driver holds their features.

Edge cases: a null or empty text has a score like any other (all its features but the constant are 0); rows whose
label is null, or that have no label, can only be unlabelled rows; a label row that comes
twice counts twice, as does a row; without any positive every score is 0.5;
an empty table gives no rows. Labels, lang, source and doc_id never enter a score.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidspark.llm.common import materialize, mix64, slices, small_batches

#: Trusted positives that the fit uses, about.
SAMPLE = 8000
HASHED = 256
THRESHOLD = 0.3
#: Of sums that tasks return, as whole numbers: their total does not depend on the order.
FIXED = float(1 << 20)
SLICE_CHARS = 1 << 18
_SPACES = re.compile(r"[ \t\r\f\v]+")
STYLE = ("constant", "upper", "digit", "mark", "word_length", "log_words", "distinct_words", "distinct_lines", "line_words", "longest_run", "repeated_pairs", "doubled_words")
FEATURES = HASHED + len(STYLE)


def _kind_table() -> np.ndarray:
    """Code point below 0x250 -> kind: lower, upper, digit, or itself; the rest are letters."""
    kinds = np.arange(0x250, dtype=np.uint32)
    for c in range(0x250):
        ch = chr(c)
        if ch.isdigit():
            kinds[c] = ord("0")
        elif ch.isalpha():
            kinds[c] = ord("A") if ch.isupper() else ord("a")
    return kinds


_KINDS = _kind_table()


def kinds_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 0x250, _KINDS[np.minimum(points, 0x24F)], np.uint32(ord("a")))


def run_shares(texts: list[str]) -> np.ndarray:
    """Roots of the shares of hashed runs of three character kinds in each text, all texts at once.

    Letters in a row are one: what remains is how words are joined, cased and closed.
    """
    kinds = kinds_of("".join(texts))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths)
    letter = kinds == ord("a")
    again = letter[1:] & letter[:-1] & (owner[1:] == owner[:-1])
    kept = np.flatnonzero(np.concatenate([[True], ~again])) if len(kinds) else np.empty(0, np.int64)
    own, of = kinds[kept].astype(np.uint64), owner[kept]
    h = mix64(own[:-2] * np.uint64(0x1F123BB5) + own[1:-1] * np.uint64(0x9E3779B1) + own[2:] * np.uint64(0x85EBCA6B))
    inside = of[:-2] == of[2:]
    cell = of[:-2][inside] * HASHED + (h[inside] & np.uint64(HASHED - 1)).astype(np.int64)
    counts = np.bincount(cell, minlength=len(texts) * HASHED).reshape(len(texts), HASHED)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def style(text: str) -> tuple:
    """STYLE of a text, but for the constant."""
    words = text.split()
    if not words:
        return (0.0,) * (len(STYLE) - 1)
    kinds = kinds_of(text)
    lines = [x for x in (_SPACES.sub(" ", y).strip() for y in text.split("\n")) if x]
    pairs = set(zip(words, words[1:]))
    upper, digit = (kinds == ord("A")).mean(), (kinds == ord("0")).mean()
    marks = 1 - digit - upper - (kinds == ord("a")).mean() - np.isin(kinds, (32, 10, 9, 13)).mean()
    runs = np.diff(np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1], [True]])))
    return (
        upper,
        digit,
        marks,
        min(sum(map(len, words)) / len(words), 40) / 10,
        np.log1p(len(words)) / 10,
        len(set(words)) / len(words),
        len(set(lines)) / max(1, len(lines)),
        min(len(words) / max(1, len(lines)), 200) / 100,
        min(int(runs.max()), 200) / 100,
        1 - len(pairs) / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        sum(map(str.__eq__, words, words[1:])) / len(words),
    )


def features_of(texts: list[str | None]) -> np.ndarray:
    """Style of whole texts, a row each: `run_shares` and STYLE."""
    out = np.zeros((len(texts), FEATURES), np.float16)
    out[:, HASHED] = 1.0
    for a, b in slices(texts, SLICE_CHARS):
        own = [t or "" for t in texts[a:b]]
        out[a:b, :HASHED] = run_shares(own)
        out[a:b, HASHED + 1 :] = [style(t) for t in own]
    return out


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(((x.astype(np.float64) - self.mean) / self.scale) @ self.weights)


UNKNOWN = QualityModel(np.zeros(FEATURES), np.zeros(FEATURES), np.ones(FEATURES), 0.5)


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def _loss(g: np.ndarray) -> np.ndarray:
    """Logistic loss of a score that should be positive."""
    return np.logaddexp(0, -g)


def minimise(f: Callable, w: np.ndarray, precondition: Callable, steps: int = 30, tolerance: float = 1e-3, memory: int = 10) -> np.ndarray:
    """L-BFGS with backtracking. f: w -> value, gradient. precondition: gradient -> a first guess of the step."""
    value, grad = f(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, kept = grad.copy(), []
        for s, y in reversed(past):
            kept.append((s @ q) / (s @ y))
            q -= kept[-1] * y
        q = precondition(q)
        for (s, y), a in zip(past, reversed(kept)):
            q += (a - (y @ q) / (s @ y)) * s
        slope, size = grad @ q, 1.0
        if slope < tolerance * max(abs(value), 1e-2):
            break
        while size > 1e-3:
            new_value, new_grad = f(w - size * q)
            if new_value <= value - 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = -size * q, new_grad - grad
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y)]
        w, value, grad = w + s, new_value, new_grad
    return w


def _preconditioner(positive: np.ndarray, c: np.ndarray, decay: float) -> Callable:
    """A guess at the inverse curvature, from the positives: it changes the path, not the minimum."""
    spread = positive.T @ (positive * c[:, None])
    root = np.linalg.inv(np.linalg.cholesky(0.15 * spread + np.diag(0.05 * np.maximum(np.diag(spread), 0.2)) + decay * np.eye(len(spread))))
    return lambda g: root.T @ (root @ g)


def fit_plain(positive: np.ndarray, of_unlabelled: Callable, counts: np.ndarray, decay: float = 1e-3) -> np.ndarray:
    """Weights of the logistic regression of positives against unlabelled rows, each half of the mass."""
    c = counts / counts.sum()

    def f(w):
        g = positive @ w
        unlabelled, of_u = of_unlabelled(w)
        return c @ _loss(g) + unlabelled + 0.5 * decay * (w @ w), positive.T @ (c * (_sigmoid(g) - 1)) + of_u + decay * w

    return minimise(f, np.zeros(positive.shape[1]), _preconditioner(positive, c, decay))


def fit_nnpu(positive: np.ndarray, of_unlabelled: Callable, prior: float, counts: np.ndarray | None = None, start: np.ndarray | None = None, decay: float = 1e-3, smooth: float = 0.01) -> np.ndarray:
    """Weights of the least non-negative risk, its maximum with 0 rounded within `smooth`.

    positive: rows of the trusted positives; counts: how often each counts. of_unlabelled: w -> R_u(-) and its gradient.
    """
    c = np.ones(len(positive)) if counts is None else counts
    c = c / c.sum()

    def f(w):
        g = positive @ w
        unlabelled, of_u = of_unlabelled(w)
        first, of_first = prior * (c @ _loss(g)) + 0.5 * decay * (w @ w), prior * (positive.T @ (c * (_sigmoid(g) - 1))) + decay * w
        hidden, of_hidden = unlabelled - prior * (c @ _loss(-g)), of_u - prior * (positive.T @ (c * _sigmoid(g)))
        return first + smooth * np.logaddexp(0, hidden / smooth), of_first + _sigmoid(hidden / smooth) * of_hidden

    return minimise(f, np.zeros(positive.shape[1]) if start is None else start, _preconditioner(positive, c, decay))


def estimate_prior(positive: np.ndarray, counts: np.ndarray, share_above: Callable) -> float:
    """Share of positives among the unlabelled rows: the least ratio of unlabelled to positive mass above any score that still has
    a twentieth of the positives, a standard error added to each, since the least of noisy ratios is too small.

    positive, counts: scores of positives that the scores were not fitted on. share_above: cuts -> unlabelled mass from there on.
    """
    order = np.argsort(positive)
    mass = np.cumsum(counts[order]) / counts.sum()
    cuts = np.unique(positive[order][np.minimum(np.searchsorted(mass, np.linspace(0.05, 0.95, 37)), len(order) - 1)])
    above = np.array([counts[positive >= c].sum() / counts.sum() for c in cuts])
    n = counts.sum() ** 2 / (counts**2).sum()
    ratios = share_above(cuts) / above * (1 + np.sqrt((1 - above) / (above * n)))
    return float(np.clip(ratios.min(), 0.02, 0.98))


def extract(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of `docs` with features of its text (`__x`) and a hash of it (`__text_hash`), written once."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            x = features_of(batch.column("__text").to_pylist())
            blobs = pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), batch.column("__text_hash"), blobs], [*keep, "__text_hash", "__x"])

    rows = docs.select(*keep, F.xxhash64("text").alias("__text_hash"), F.col("text").alias("__text"))
    schema = docs.select(*keep).schema.add("__text_hash", "long").add("__x", "binary")
    return materialize(rows.mapInArrow(run, schema), "quality-features")


def _matrix(blobs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), np.float16).reshape(-1, FEATURES).astype(np.float32)


def _sums(rows: DataFrame, size: int, of: Callable) -> np.ndarray:
    """The sum over all rows of `of` (a matrix of features -> `size` sums), added up task by task."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            total += of(_matrix(batch.column("__x")))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(np.rint(total * FIXED).astype(np.int64))], ["i", "v"])

    out = np.zeros(size)
    for i, v in rows.select("__x").mapInArrow(run, "i int, v long").groupBy("i").agg(F.sum("v")).collect():  # `size` rows
        out[i] = v / FIXED
    return out


def _positives(features: DataFrame, labels: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of the trusted positives, and how often each counts. At most about `sample` rows, drawn by a hash on keys alone; c equal
    rows are one that is drawn c times as likely and, where it would be drawn more than once, counts as often."""
    named = labels.where("quality = 1").select(F.col("doc_id").alias("l_doc"))
    marked = features.select("doc_id", "__text_hash").join(named, F.col("doc_id") == F.col("l_doc"))
    once = materialize(marked.groupBy("doc_id", "__text_hash").agg(F.count("*").alias("n")), "positives")
    total = once.agg(F.sum("n")).first()[0]
    if not total:
        return np.empty((0, FEATURES), np.float32), np.empty(0)
    draw = F.pmod(F.xxhash64("doc_id", "__text_hash", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.col("n") * min(1.0, sample / total)
    drawn = once.where(draw < rate).select(F.col("doc_id").alias("d"), F.col("__text_hash").alias("h"), F.greatest(F.lit(min(1.0, sample / total)), rate).alias("weight"))
    drawn = drawn.withColumn("weight", F.greatest(F.lit(1.0), "weight"))
    # about `sample` rows of 24 bytes
    read = features.join(F.broadcast(drawn), (F.col("doc_id") == F.col("d")) & (F.col("__text_hash") == F.col("h")))
    got = read.groupBy("d", "h").agg(F.first("__x").alias("x"), F.first("weight").alias("weight")).orderBy("h", "d").select("x", "weight").toArrow()
    return _matrix(got.column("x")), got.column("weight").to_numpy()


def fit(features: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Fit on features (doc_id, __text_hash, __x), all of them unlabelled web text, and labels (doc_id, quality): rows of quality 1 are
    the trusted positives."""
    positive, counts = _positives(features, labels, sample)
    if not len(positive):
        return UNKNOWN
    moments = _sums(features, 2 * FEATURES + 1, lambda x: np.concatenate([x.sum(axis=0, dtype=float), (x.astype(float) ** 2).sum(axis=0), [len(x)]]))
    n = moments[-1]
    mean = moments[:FEATURES] / n
    scale = np.sqrt(np.maximum(moments[FEATURES:-1] / n - mean**2, 0)) + 1e-2
    mean[HASHED], scale[HASHED] = 0.0, 1.0
    p = (positive.astype(float) - mean) / scale

    def of_unlabelled(w):
        def of(x):
            z = (x - mean.astype(np.float32)) / scale.astype(np.float32)
            g = (z @ w.astype(np.float32)).astype(float)
            return np.append(_sigmoid(g).astype(np.float32) @ z, _loss(-g).sum())

        sums = _sums(features, FEATURES + 1, of) / n
        return sums[-1], sums[:-1]

    def share_above(w):
        def shares(cuts):
            return _sums(features, len(cuts), lambda x: (((x.astype(float) - mean) / scale @ w)[:, None] >= cuts - 1e-9).sum(axis=0)) / n

        return shares

    plain, prior = None, 0.5
    if len(p) > 1:
        half = np.arange(len(p)) % 2 == 0
        plain = fit_plain(p[half], of_unlabelled, counts[half])
        prior = estimate_prior(p[~half] @ plain, counts[~half], share_above(plain))
    return QualityModel(fit_nnpu(p, of_unlabelled, prior, counts, start=plain), mean, scale, prior)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """`fit` on the texts of docs (doc_id, text)."""
    return fit(extract(docs, ["doc_id"]), labels, sample)


def score_features(features: DataFrame, model: QualityModel, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The columns `keep` of extracted features, with score and predicted."""
    shared = features.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = shared.value.score(_matrix(batch.column("__x")))
            predicted = pa.array((s >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s), predicted], [*keep, "score", "predicted"])

    schema = features.select(*keep).schema.add("score", "double").add("predicted", "integer")
    return features.select(*keep, "__x").mapInArrow(run, schema)


def score(docs: DataFrame, model: QualityModel, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The columns `keep` of `docs`, with score and predicted of its text."""
    return score_features(extract(docs, keep), model, keep, threshold)
