"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language in every training row (map side per partition, then one
aggregation of language x bucket counts). The log-probability matrix, `languages x BUCKETS` doubles
and so bounded by the number of languages (at most MAX_LANGS), is broadcast. Scoring hashes the
n-grams of a slice of texts at once, counts them per text into a sparse (text, bucket, count) form
and multiplies it with the matrix in numpy.

Edge cases: a null text, or one without a letter (Unicode's categories L*), is ``und`` with score 0; so is every text if there
is no training row. Rows whose lang is null are scored but not learned from. Repeated rows count as
often as they occur; equal likelihoods go to the language that is first by code point. Texts are
read whole. Clashing column names do not matter: only text (and lang for training) are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidspark.llm.common import lean, slices, small_batches

BUCKETS = 1 << 14
ORDERS = (2, 3)
MAX_LANGS = 1000
#: In the score, not in the decision, a text's log-likelihood counts as that of so many n-grams at most: so scores keep a spread.
FULL_GRAMS = 60
SLICE_CHARS = 1 << 18
UNDETERMINED = "und"
#: Letters, and numbers that are no decimal digits.
LETTER_LIKE = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    log_prior: np.ndarray  # of each language
    log_prob: np.ndarray  # buckets x languages


def has_letter(text: str | None) -> bool:
    """Whether a text holds a character of Unicode's categories L*: a half, a superscript two or a Roman numeral sign is none."""
    return any(m.group().isalpha() for m in LETTER_LIKE.finditer(text or ""))


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, a blank before and after each; non-letters are blanks. And each text's length."""
    padded = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    ascii_letter = (points - np.uint32(97)) < 26
    return np.where(ascii_letter | (points >= 170), points, np.uint32(32)), lengths


def hashed_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of every n-gram, ordered by text, n-gram orders one after the other."""
    points, lengths = _code_points(texts)
    owner = np.repeat(np.arange(len(texts)), lengths)
    owners, buckets = [], []
    for n in ORDERS:
        if len(points) < n:
            continue
        acc = np.full(len(points) - n + 1, n, np.uint32)
        for i in range(n):
            acc = (acc ^ points[i : len(points) - n + 1 + i]) * np.uint32(0x9E3779B1)
            acc ^= acc >> np.uint32(15)
        inside = owner[: len(acc)] == owner[n - 1 :]
        owners.append(owner[: len(acc)][inside])
        buckets.append((acc[inside] & np.uint32(BUCKETS - 1)).astype(np.int64))
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(owners), np.concatenate(buckets)


def _count(batches):
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for a, b in slices(texts, SLICE_CHARS):
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(texts[a:b], langs[a:b]):
                by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                _, buckets = hashed_grams(own)
                counts[lang] = counts.get(lang, 0) + np.bincount(buckets, minlength=BUCKETS)
                docs[lang] = docs.get(lang, 0) + len(own)
    for lang, row in counts.items():
        at = np.flatnonzero(row)
        bucket = np.append(at, -1).astype(np.int32)  # -1: the number of texts
        n = np.append(row[at], docs[lang]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(bucket), pa.array(n)], ["lang", "bucket", "n"])


def train(rows: DataFrame, alpha: float = 0.5) -> LanguageModel:
    """Fit on every row of (text, lang) whose lang and text are not null."""
    small_batches(rows.sparkSession)
    known = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counts = known.mapInArrow(lean(_count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    if (found := counts.where("bucket = -1").count()) > MAX_LANGS:
        raise ValueError(f"{found} languages; at most {MAX_LANGS} are supported")
    table = counts.toArrow()  # at most MAX_LANGS x (BUCKETS + 1) rows
    names = table.column("lang").to_pylist()
    langs = tuple(sorted(set(names)))
    at = {lang: i for i, lang in enumerate(langs)}
    matrix = np.zeros((BUCKETS + 1, len(langs)))
    matrix[table.column("bucket").to_numpy(), [at[x] for x in names]] = table.column("n").to_numpy()
    grams, texts = matrix[:-1], matrix[-1]
    smooth = grams + alpha
    with np.errstate(divide="ignore", invalid="ignore"):
        return LanguageModel(langs, np.log(texts / texts.sum()), np.log(smooth / smooth.sum(axis=0)))


def score_texts(model: LanguageModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Best language's index by the whole likelihood, and its posterior by the tempered one, of each text.

    Where the prior outweighs the tempered likelihood, but not the whole one, the score leaves the prior out.
    """
    owner, bucket = hashed_grams(texts)
    cells = np.bincount(owner, minlength=len(texts))
    # the sparse batch: entries ordered by text, one segment a text and n-gram order
    cuts = np.flatnonzero(np.diff(owner, prepend=-1))
    total = np.zeros((len(texts), len(model.langs)))
    if len(owner):
        sums = np.stack([np.add.reduceat(model.log_prob[:, k][bucket], cuts) for k in range(len(model.langs))], axis=1)
        np.add.at(total, owner[cuts], sums)
    best = (total + model.log_prior).argmax(axis=1)
    likelihood = total * np.minimum(1.0, FULL_GRAMS / np.maximum(cells, 1))[:, None]
    tempered = likelihood + model.log_prior
    tempered = np.where((tempered.argmax(axis=1) == best)[:, None], tempered, likelihood)
    weights = np.exp(tempered - tempered.max(axis=1, keepdims=True))
    return best, weights[np.arange(len(best)), best] / weights.sum(axis=1)


def predict(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """The columns `keep` of `docs`, with lang_pred and score of its text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            pred, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            usable = [i for i, t in enumerate(texts) if model.langs and has_letter(t)]
            for a, b in slices([texts[i] for i in usable], SLICE_CHARS):
                best, sure = score_texts(model, [texts[i] for i in usable[a:b]])
                for i, k, s in zip(usable[a:b], best, sure):
                    pred[i], score[i] = model.langs[k], s
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    source = docs.select(*keep, F.col("text").alias("__text"))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return source.mapInArrow(lean(run), schema)
