import random

import numpy as np

from loadcurve.llm import factorization as fm
from tests.llm.frames import clashing, documents, odd_texts, prose


def test_linear_time_sum_equals_all_pairs():
    rng = np.random.default_rng(0)
    n = fm.BUCKETS + fm.DENSE
    m = fm.Machine(0.3, rng.normal(size=n), rng.normal(size=(n, fm.FACTORS)), np.zeros(fm.DENSE), np.ones(fm.DENSE))
    rows = [(np.sort(rng.choice(fm.BUCKETS, k, replace=False)), rng.normal(size=fm.DENSE)) for k in (0, 1, 7, 30)]
    indices, values, starts, sizes = m.flat(rows)
    margins, _ = m.sums(indices, values, starts)
    for k, (at, size) in enumerate(zip(starts, sizes, strict=True)):
        i, x = indices[at : at + size], values[at : at + size]
        pairs = sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(size) for b in range(a + 1, size))
        assert np.isclose(margins[k], 0.3 + m.linear[i] @ x + pairs)


def _labelled(spark, n=300):
    rng = random.Random(4)
    texts = [prose(rng, 40 + rng.randrange(100)) for _ in range(n)]
    texts = [t.replace(" ", " | ") if i % 4 == 0 else t for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(n)], "doc_id bigint, quality int, toxic int")
    return documents(spark, texts), labels


def test_held_out_accuracy(spark):
    docs, labels = _labelled(spark)
    rows = fm.classify(docs, labels).collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == 300 and 30 < len(out) < 90
    assert sum(r.predicted == int(r.doc_id % 4 != 0) for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_held_out_labels_have_no_part(spark):
    docs, labels = _labelled(spark, 120)
    from loadcurve.llm.common import held_out

    other = labels.selectExpr("doc_id", "CASE WHEN crc32(string(doc_id)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a, b = ({r.doc_id: r.score for r in fm.classify(docs, x).collect()} for x in (labels, other))
    assert a == b and labels.where(held_out()).count() > 0


def test_odd_rows(spark):
    docs, labels = _labelled(spark, 100)
    odd = clashing(documents(spark, odd_texts(random.Random(1)), first=900))
    rows = fm.score(odd, fm.fit(docs, labels)).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (905, 906)} == {next(r.score for r in rows if r.doc_id == 905)}
    assert fm.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in fm.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in fm.classify(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert fm.classify(docs.drop("n_chars"), labels).count() == 100
