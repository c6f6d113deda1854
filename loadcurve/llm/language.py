"""Language identification with error-correcting output codes over character n-grams.

Each language has a codeword of bits. One binary classifier for each bit, linear in the square roots of
the shares of hashed character n-grams, predicts it; the codeword with the least logistic loss,
each bit weighted by how well its classifier did in fitting, is the prediction. `score` is the softmax of the
negative losses, and `ambiguous` marks texts whose two nearest codewords are too close.

Up to seven languages get the exhaustive code (every split into two groups once), more get a random code
whose least distance between codewords is the best of many draws.

Defined cases: null texts and texts without a letter are `und` with score 0; without any language to learn all
are; with a single one all others are that one with score 1; ties go to the first language in order of name;
repeated rows are judged each; result columns replace input columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.llm.common import annotate, character_classes, code_points, hash_share, held_out, without

BUCKETS = 1 << 13
ORDERS = (1, 2, 3)
#: Documents that the classifiers are fitted on, at the most, as many of each language.
FIT_ROWS = 3_200
#: Share of probability between the two nearest codewords under which a prediction is ambiguous.
MARGIN = 0.2
#: Code points that are counted at a time.
CHUNK = 1 << 20
UNKNOWN = "und"


def profile(text: str | None) -> np.ndarray | None:
    """Square roots of the shares of hashed n-grams of letters; None without a letter. Other characters count as one space."""
    if not text:
        return None
    points = code_points(text.lower())
    letters = character_classes()[points]
    letters = (letters == 1) | (letters == 2)
    if not letters.any():
        return None
    points = np.where(letters, points, 32)
    points = points[letters | np.concatenate([[True], letters[:-1]])].astype(np.uint64)
    counts = np.zeros(BUCKETS)
    for at in range(0, len(points), CHUNK):
        part = points[at : at + CHUNK + max(ORDERS) - 1]
        mixed = np.zeros(len(part), np.uint64)
        for order in range(1, max(ORDERS) + 1):
            if len(part) < order:
                break
            mixed = mixed[: len(part) - order + 1] * np.uint64(1_000_003) + part[order - 1 :] + np.uint64(order)
            own = mixed[:CHUNK]
            if order in ORDERS:
                hashed = (own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 13)
                counts += np.bincount(hashed.astype(np.int64), minlength=BUCKETS)
    return np.sqrt(counts / counts.sum())


def code(n: int, seed: int = 5) -> np.ndarray:
    """Codewords of -1 and 1, one row for each of `n` classes."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 7:
        return np.array([[1.0, *rest] for rest in product([1.0, -1.0], repeat=n - 1) if -1.0 in rest]).T
    rng = np.random.default_rng(seed)
    length = int(np.ceil(10 * np.log2(n)))
    best, best_distance = None, -1.0
    for _ in range(200):
        words = rng.choice([-1.0, 1.0], (n, length))
        words = words[:, np.abs(words.sum(axis=0)) < n]
        distance = ((words.shape[1] - words @ words.T) / 2 + 2 * length * np.eye(n)).min()
        if distance > best_distance:
            best, best_distance = words, distance
    return best


@dataclass(frozen=True)
class Coder:
    languages: list[str]
    words: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Loss of each codeword for each row: the mean over bits of log(1 + exp(-bit * margin)), weighted by trust."""
        margins = x @ self.weights + self.bias
        return np.stack([np.logaddexp(0, -margins * w) @ self.trust for w in self.words], axis=1)


def fit_coder(x: np.ndarray, languages: list[str], steps: int = 80, rate: float = 2.0, ridge: float = 1e-5) -> Coder:
    """Fit all bits together by accelerated gradient descent on the logistic loss; languages weigh the same in all."""
    names = sorted(set(languages))
    words = code(len(names))
    of = np.array([names.index(name) for name in languages])
    target = words[of].astype(x.dtype)
    weight = ((1 / np.bincount(of))[of][:, None] / len(names)).astype(x.dtype)
    w, b = np.zeros((x.shape[1], target.shape[1]), x.dtype), np.zeros(target.shape[1], x.dtype)
    ahead, ahead_b = w, b
    scale = x.dtype.type(20)  # profiles have length 1: their margins need large weights
    step, shrink = x.dtype.type(rate), x.dtype.type(ridge)
    for k in range(steps):
        pull = -weight * target / (1 + np.exp(np.clip(target * scale * (x @ ahead + ahead_b), -30, 30)))
        new, new_b = ahead - step * (x.T @ pull + shrink * ahead), ahead_b - step * pull.sum(axis=0)
        momentum = x.dtype.type(k / (k + 3))
        ahead, ahead_b = new + momentum * (new - w), new_b + momentum * (new_b - b)
        w, b = new, new_b
    right = (weight * (target * (x @ w + b) > 0)).sum(axis=0)
    trust = np.maximum(right - 0.5, 1e-3)
    return Coder(names, words, scale * w, scale * b, trust / trust.sum())


def fit(docs: DataFrame, most: int = FIT_ROWS) -> Coder | None:
    """Fit on about `most` documents, as many of each language, chosen by a hash of the id outside the held-out fold."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    shares = F.lit(False)
    for name, n in counts.items():
        shares = shares | ((F.col("lang") == name) & hash_share(["doc_id"], most / len(counts) / n, 23))
    chosen = known.where(shares)
    fields = [T.StructField("profile", T.BinaryType())]
    pdf = annotate(chosen, ["text"], fields, _profiles, ["doc_id", "lang"]).where("profile is not null").limit(2 * most).toPandas()
    if not len(pdf):
        return None
    pdf = pdf.sort_values(["doc_id", "lang"], kind="stable")
    x = np.empty((len(pdf), BUCKETS), np.float32)
    for row, p in zip(x, pdf.pop("profile"), strict=True):
        row[:] = np.frombuffer(p, np.float16)
    return fit_coder(x, list(pdf["lang"]))


def _profiles(texts):
    made = [profile(t) for t in texts]
    return [[None if p is None else p.astype(np.float16).tobytes() for p in made]]


class _Decode:
    def __init__(self, coder: Coder | None):
        self.coder = coder

    def __call__(self, texts):
        names, scores, ambiguous = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        for at in range(0, len(texts), 256):
            made = [(i, p) for i, t in enumerate(texts[at : at + 256], at) if (p := profile(t)) is not None]
            if not made or self.coder is None:
                continue
            losses = self.coder.losses(np.stack([p for _, p in made]))
            # as many units of loss as there are bits stand behind the mean
            odds = np.exp(-(losses - losses.min(axis=1, keepdims=True)) * self.coder.words.shape[1])
            odds /= odds.sum(axis=1, keepdims=True)
            best = losses.argmin(axis=1)
            second = np.sort(odds, axis=1)[:, -2] if odds.shape[1] > 1 else np.zeros(len(odds))
            for (i, _), k, p, q in zip(made, best, odds, second, strict=True):
                names[i], scores[i], ambiguous[i] = self.coder.languages[k], float(p[k]), bool(p[k] - q < MARGIN)
        return [names, scores, ambiguous]


OUTPUT = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]


def predict(docs: DataFrame, coder: Coder | None, keep: list[str] | None = None) -> DataFrame:
    """Add `lang_pred`, `score` and `ambiguous` to the columns `keep` (all by default)."""
    keep = without(docs, [f.name for f in OUTPUT]).columns if keep is None else keep
    return annotate(docs, ["text"], OUTPUT, _Decode(coder), keep)


def identify(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Fit on the documents whose language is given, then predict all."""
    predicted = predict(docs, fit(docs), keep)
    return predicted.select("doc_id", held_out().alias("held_out"), *[c for c in predicted.columns if c not in ("doc_id", "held_out")])
