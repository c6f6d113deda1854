import random
import re
from collections import Counter

import numpy as np
import pytest

from loadcurve.llm import quality_rules as q
from tests.llm.frames import clashing, documents, odd_texts, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(1 for i, x in enumerate(lines) if x in lines[:i])
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)]


def test_counts_match_a_plain_version():
    rng = random.Random(1)
    texts = [None, "", "a b", "x\n\n x\nx\n \t\nx", "é# ** <ü>| b\x0bc", "a " * 40]
    for _ in range(60):
        words = [rng.choice("abcd") for _ in range(rng.randrange(80))]
        texts.append("".join(w + rng.choice([" ", " ", "\n", "\t"]) for w in words))
    for t in texts:
        assert q.statistics(t)[0] == plain_counts(t)


def test_trees_keep_the_directions_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.standard_normal(3000) + 0.3 * np.sin(9 * x[:, 0]) > 0).astype(float)
    trees = q.fit_trees(x, y, np.array([1, -1, 0]))
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.8
    for f, way in ((0, 1), (1, -1)):
        lines = np.repeat(rng.random((50, 1, 3)), 40, axis=1)
        lines[:, :, f] = np.linspace(-0.1, 1.1, 40)
        steps = np.diff(trees.margin(lines.reshape(-1, 3)).reshape(50, 40), axis=1)
        assert (way * steps >= -1e-9).all() and (steps != 0).any()


def test_flat_scores_match_a_walk():
    rng = np.random.default_rng(2)
    x, y = rng.random((300, 4)), (rng.random(300) > 0.5).astype(float)
    t = q.fit_trees(x, y, np.zeros(4), rounds=5)

    def walk(row, at):
        while t.left[at] != at:
            at = t.left[at] if row[t.feature[at]] <= t.threshold[at] else t.right[at]
        return t.value[at]

    assert np.allclose(t.margin(x), [t.start + sum(walk(r, at) for at in t.roots) for r in x])


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    good = [prose(rng, 60 + rng.randrange(200)) for _ in range(120)]
    bad = [t.upper().replace(" ", "!! ") if i % 2 else t.replace(" ", "### ") for i, t in enumerate(good[:40])]
    docs = documents(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(160)] + [(3, None, 0), (None, 1, 0), (9999, 0, 0)], "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_rules_keep_prose_and_reject_junk(corpus):
    docs, labels = corpus
    rows = q.quality_rules(docs, labels).collect()
    assert len(rows) == 160
    assert all(r.kept for r in rows if r.doc_id < 120)
    assert not any(r.kept for r in rows if r.doc_id >= 120)
    kept = q.keep_good(clashing(docs), labels)
    assert kept.columns == clashing(docs).columns and {r.doc_id for r in kept.collect()} == set(range(120))


def test_odd_rows(spark, corpus):
    docs, labels = corpus
    odd = documents(spark, odd_texts(random.Random(2)), first=500)
    trees = q.fit(docs, labels)
    rows = {r.doc_id: r for r in q.judge(clashing(odd), trees).collect()}
    assert [rows[500 + i].n_words for i in (0, 1, 2, 3, 4)] == [0, 0, 0, 1, 4]
    assert all(rows[i].base_failed and not rows[i].kept for i in (500, 501, 502, 503, 504, 510))
    assert rows[505].n_words == rows[506].n_words == 30_000 and rows[505].rule_score == rows[506].rule_score
    empty = docs.limit(0)
    assert q.quality_rules(empty, labels).count() == 0
    assert q.quality_rules(docs, labels.limit(0)).where("kept").count() == 160 - q.quality_rules(docs, labels.limit(0)).where("base_failed").count()
