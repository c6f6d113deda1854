"""Quality rules: boosted trees over document statistics, as flat numpy arrays, with monotonic constraints.

Base rules fail a document for being short or repetitive; gradient-boosted trees over shares of its
statistics judge the rest. More symbols, repeats, capitals and so on can only lower the verdict, more
letters can only raise it: such features are constrained in training by bounds on the leaf values.

Defined cases: null text and empty text have no words, so the base rules fail them; a null label or
label of an unknown id is not learned from; without labels of both kinds every document that passes the
base rules is kept; a result column replaces an input column of the same name; repeated rows are
judged each by itself; ties of equal gain go to the first feature and lowest threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.llm.common import annotate, character_classes, code_points, dense_ids, labelled_sample, release_caches, split_words, without

#: Words in a window of the repetition statistic.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Labelled documents that the trees are fitted on, at the most.
FIT_ROWS = 20_000

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Feature and the direction in which it may move the verdict (0: either).
FEATURES = {
    "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "capital_share": -1, "shout_per_word": -1,
    "digit_share": -1, "stutter_share": -1, "letter_share": 1, "marks_per_word": 0, "word_length": 0, "distinct_share": 0,
}


def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words within windows of `width` words (a power of two) that occur twice or more, first ones included."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    weights = np.random.default_rng(1).integers(1, 2**63, width, dtype=np.uint64) | np.uint64(1)
    mixed = np.zeros(n, np.uint64)
    wide = ids.astype(np.uint64) + np.uint64(1)
    for i, w in enumerate(weights):
        mixed += wide[i : i + n] * w
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():  # no equal hash, so no equal window
        return 0
    names, step = ids, 1
    while step < width:  # numbers of windows of 2, 4, 8 words: equal numbers are equal windows
        names = np.unique(names[:-step] * (names.max() + 1) + names[step:], return_inverse=True)[1]
        step *= 2
    again = (np.bincount(names)[names] > 1).astype(np.int64)
    edges = np.zeros(len(ids) + 1, np.int64)
    edges[:n] += again
    edges[width : width + n] -= again
    return int((np.cumsum(edges)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The five base counts, and the features in the order of FEATURES."""
    text = text or ""
    words = split_words(text)
    n = len(words)
    if not n:
        return [0] * 5, [0.0] * len(FEATURES)
    kinds = np.bincount(character_classes()[code_points(text)], minlength=8)
    ids = dense_ids(words)
    lines = [line for line in text.split("\n") if line.strip(" \t\n\r\x0b\x0c")]
    dup_lines = len(lines) - len(set(lines))
    repeat = repeated_words(ids)
    word_chars = int(len(text) - kinds[4])
    letters = int(kinds[1] + kinds[2])
    features = [
        kinds[5] / n, dup_lines / len(lines), repeat / n, kinds[1] / max(1, letters), kinds[6] / n,
        kinds[3] / word_chars, float((ids[1:] == ids[:-1]).sum()) / n, letters / word_chars, kinds[7] / n,
        word_chars / n, (int(ids.max()) + 1) / n,
    ]
    return [n, word_chars, int(kinds[5]), dup_lines, repeat], [float(x) for x in features]


@dataclass(frozen=True)
class Trees:
    """All trees in flat arrays. A node goes left where its feature is at most the threshold; a leaf leads to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(
    x: np.ndarray, y: np.ndarray, directions: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 5.0
) -> Trees:
    """Boost on the logistic loss with binned features. `least` is the smallest sum of second derivatives of a leaf.

    A split of a constrained feature counts only if its two leaf values are in order, and the values below
    it are bounded by their mean, which keeps the whole tree monotonic in that feature.
    """
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    margin = np.full(len(y), start)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf_value(g, h, low, high):
        return float(np.clip(-g / (h + ridge), low, high))

    def grow(rows, g, h, level, low, high) -> int:
        me = len(feature)
        feature.append(0)
        threshold.append(np.inf)
        left.append(me)
        right.append(me)
        value.append(rate * leaf_value(g[rows].sum(), h[rows].sum(), low, high))
        if level == depth:
            return me
        best = (1e-6, None)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            b = binned[rows, f]
            gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
            gr, hr = total_g - gl, total_h - hl
            wl, wr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
            gain = -(gl * wl + 0.5 * (hl + ridge) * wl**2) - (gr * wr + 0.5 * (hr + ridge) * wr**2)
            w = np.clip(-total_g / (total_h + ridge), low, high)
            gain += total_g * w + 0.5 * (total_h + ridge) * w**2
            allowed = (hl >= least) & (hr >= least) & ((wr - wl) * directions[f] >= 0)
            gain = np.where(allowed, gain, -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (f, k, wl[k], wr[k]))
        if best[1] is None:
            return me
        f, k, wl, wr = best[1]
        goes = binned[rows, f] <= k
        middle = (wl + wr) / 2
        limits = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}
        of_left, of_right = limits[int(directions[f])]
        feature[me], threshold[me], value[me] = f, cuts[f][k], 0.0
        left[me] = grow(rows[goes], g, h, level + 1, *of_left)
        right[me] = grow(rows[~goes], g, h, level + 1, *of_right)
        return me

    everything = np.arange(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(everything, p - y, p * (1 - p), 0, -np.inf, np.inf))
        one = Trees(*map(np.array, (feature, threshold, left, right, value)), np.array(roots[-1:]), depth, 0.0)
        margin += one.margin(x)
    return Trees(*map(np.array, (feature, threshold, left, right, value, roots)), depth, start)


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Trees | None:
    """Fit on a sample of labelled documents of about `most` rows; None without labels of both kinds."""
    rows = annotate(
        labelled_sample(docs, labels, "quality", most), ["text"], [T.StructField("features", T.ArrayType(T.DoubleType()))],
        _features, ["doc_id", "__label"],
    ).limit(2 * most).toPandas()
    rows = rows.sort_values(["doc_id", "__label"], kind="stable")
    y = (rows["__label"].to_numpy() > 0).astype(float)
    if len(set(y)) < 2:
        return None
    return fit_trees(np.stack(rows["features"].to_numpy()).astype(float), y, np.array(list(FEATURES.values())))


def _features(texts):
    release_caches()
    return [[statistics(t)[1] for t in texts]]


class _Judge:
    def __init__(self, trees: Trees | None, cutoff: float):
        self.trees, self.cutoff = trees, cutoff

    def __call__(self, texts):
        release_caches()
        base, features = zip(*map(statistics, texts), strict=True)
        base, features = np.array(base, np.int64), np.array(features)
        n_words, repeats = base[:, 0], base[:, 4]
        failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)
        score = self.trees.probability(features) if self.trees else np.ones(len(base))
        return [*base.T, failed, ~failed & (score >= self.cutoff), score]


OUTPUT = [
    *[T.StructField(n, T.LongType()) for n in BASE], T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()), T.StructField("rule_score", T.DoubleType()),
]


def judge(docs: DataFrame, trees: Trees | None, keep: list[str] | None = None, cutoff: float = 0.5) -> DataFrame:
    """Add the base counts, `base_failed`, `kept` and `rule_score` to the columns `keep` (all by default)."""
    names = [f.name for f in OUTPUT]
    keep = without(docs, names).columns if keep is None else keep
    return annotate(docs, ["text"], OUTPUT, _Judge(trees, cutoff), keep)


def quality_rules(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Fit on the labels, then judge every document by its whole text."""
    return judge(docs, fit(docs, labels), keep)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns as they were."""
    hidden = [F.col(f"`{c}`") for c in docs.columns]
    judged = docs.select(*hidden, F.col("text").alias("__text"))
    fields = [T.StructField(f"__{f.name}", f.dataType) for f in OUTPUT]
    judged = annotate(judged, ["__text"], fields, _Judge(fit(docs, labels), 0.5), docs.columns)
    return judged.where("__kept").select(*hidden)
