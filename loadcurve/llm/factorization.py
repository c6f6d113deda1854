"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Score of a sparse input x: w0 + sum w_i x_i + the sum over pairs i < j of <v_i, v_j> x_i x_j. The pair sum is
half of |sum v_i x_i|^2 - sum |v_i x_i|^2, so it takes time linear in the number of features of a text.

Inputs are the distinct words of the whole text, hashed; statistics of its structure; and the metadata
n_chars (the length of the text where that is null or no such column exists). Never: doc_id, lang, source, labels.

Defined cases: null and empty texts have no words and zero statistics, and are scored as such; null labels are
not learned from; without labels of both kinds every score is the share of label 1 (0.5 without any);
repeated rows are scored each; result columns replace input columns of the same name.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.llm.common import BoundedCache, annotate, held_out, labelled_sample, split_words, without
from loadcurve.llm.quality_rules import FEATURES, statistics

BUCKETS = 1 << 15
FACTORS = 8
#: Labelled documents that the machine is fitted on, at the most.
FIT_ROWS = 10_000
#: Scores from here on are predicted as label 1.
CUTOFF = 0.3
DENSE = len(FEATURES) + 1

_bucket = BoundedCache(lambda word: zlib.crc32(word) % BUCKETS, 400_000)


def inputs(text: str | None, n_chars) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the distinct words, and the dense part: structure statistics, then metadata."""
    text = text or ""
    words = set(split_words(text.lower()))
    buckets = np.unique(np.fromiter(map(_bucket.__getitem__, words), np.int64, len(words)))
    length = len(text) if n_chars is None else max(0, n_chars)
    return buckets, np.array([*statistics(text)[1], np.log1p(length)])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # one for each bucket, then one for each dense input
    factors: np.ndarray
    centre: np.ndarray
    spread: np.ndarray

    def dense(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.spread, -4, 4)

    def sums(self, indices: np.ndarray, values: np.ndarray, starts: np.ndarray):
        """Margins of the rows that begin at `starts` in a flat list of inputs, and the factor sums of each row."""
        v = self.factors[indices] * values[:, None]
        total = np.add.reduceat(v, starts, axis=0)
        squares = np.add.reduceat(v * v, starts, axis=0)
        line = np.add.reduceat(self.linear[indices] * values, starts)
        return self.bias + line + 0.5 * (total * total - squares).sum(axis=1), total

    def flat(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        """Each row: its words with equal weights of length 1 in all, then its dense inputs."""
        extra = np.arange(BUCKETS, BUCKETS + DENSE)
        indices = np.concatenate([np.concatenate([b, extra]) for b, _ in rows])
        values = np.concatenate([np.concatenate([np.full(len(b), 1 / np.sqrt(max(1, len(b)))), self.dense(d)]) for b, d in rows])
        sizes = np.array([len(b) + DENSE for b, _ in rows])
        return indices, values, np.cumsum(sizes) - sizes, sizes

    def probability(self, rows) -> np.ndarray:
        out = []
        for i in range(0, len(rows), 256):
            indices, values, starts, _ = self.flat(rows[i : i + 256])
            out.append(1 / (1 + np.exp(-np.clip(self.sums(indices, values, starts)[0], -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def fit_machine(rows, y: np.ndarray, epochs: int = 6, batch: int = 256, rate: float = 0.05, decay: float = 1e-4, seed: int = 3) -> Machine:
    """Logistic loss with per-coordinate step sizes; the rarer label weighs as much as the other in all."""
    rng = np.random.default_rng(seed)
    dense = np.stack([d for _, d in rows])
    machine = Machine(
        0.0, np.zeros(BUCKETS + DENSE), rng.normal(0, 0.02, (BUCKETS + DENSE, FACTORS)), dense.mean(axis=0), dense.std(axis=0) + 1e-6
    )
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    seen_linear, seen_factors, seen_bias = np.full(len(machine.linear), 1e-6), np.full(machine.factors.shape, 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            indices, values, starts, sizes = machine.flat([rows[k] for k in part])
            margin, total = machine.sums(indices, values, starts)
            error = weight[part] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[part]) / len(part)
            each = np.repeat(error, sizes) * values
            touched, at = np.unique(indices, return_inverse=True)
            linear = np.bincount(at, each, len(touched)) + decay * machine.linear[touched]
            own = machine.factors[indices]
            pull = each[:, None] * (np.repeat(total, sizes, axis=0) - own * values[:, None])
            factors = np.stack([np.bincount(at, pull[:, f], len(touched)) for f in range(FACTORS)], axis=1) + decay * machine.factors[touched]
            seen_linear[touched] += linear**2
            seen_factors[touched] += factors**2
            seen_bias += error.sum() ** 2
            machine.linear[touched] -= rate * linear / np.sqrt(seen_linear[touched])
            machine.factors[touched] -= rate * factors / np.sqrt(seen_factors[touched])
            machine.bias -= rate * error.sum() / np.sqrt(seen_bias)
    return machine


def _pack(texts, n_chars):
    pairs = [inputs(t, n) for t, n in zip(texts, n_chars, strict=True)]
    return [[b.tolist() for b, _ in pairs], [d.tolist() for _, d in pairs]]


def _with_length(docs: DataFrame) -> DataFrame:
    known = [c for c in docs.columns if c.lower() == "n_chars"]
    length = F.col(known[0]).cast("bigint") if known else F.lit(None).cast("bigint")
    return docs.withColumn("__length", length)


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Machine | float:
    """A machine fitted on a sample of about `most` labelled rows, or the constant score without both labels."""
    fields = [T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("dense", T.ArrayType(T.DoubleType()))]
    sample = labelled_sample(_with_length(docs), labels, "quality", most)
    pdf = annotate(sample, ["text", "__length"], fields, _pack, ["doc_id", "__label"]).limit(2 * most).toPandas().sort_values("doc_id", kind="stable")
    y = (pdf["__label"].to_numpy() > 0).astype(float)
    if len(set(y)) < 2:
        return float(y[0]) if len(y) else 0.5
    return fit_machine([(np.asarray(b, np.int64), np.asarray(d)) for b, d in zip(pdf["buckets"], pdf["dense"], strict=True)], y)


class _Score:
    def __init__(self, machine: Machine | float):
        self.machine = machine

    def __call__(self, texts, n_chars):
        if isinstance(self.machine, float):
            scores = np.full(len(texts), self.machine)
        else:
            scores = self.machine.probability([inputs(t, n) for t, n in zip(texts, n_chars, strict=True)])
        return [scores, (scores >= CUTOFF).astype(np.int32)]


OUTPUT = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def score(docs: DataFrame, machine: Machine | float, keep: list[str] | None = None) -> DataFrame:
    """Add `score` and `predicted` to the columns `keep` (all by default)."""
    keep = without(docs, [f.name for f in OUTPUT]).columns if keep is None else keep
    return annotate(_with_length(docs), ["text", "__length"], OUTPUT, _Score(machine), keep)


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Fit on the labels outside the held-out fold, then score every document."""
    scored = score(docs, fit(docs, labels), keep)
    return scored.select("doc_id", held_out().alias("held_out"), *[c for c in scored.columns if c not in ("doc_id", "held_out")])
