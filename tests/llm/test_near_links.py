import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loadcurve.llm import near_links as nl
from tests.llm.frames import clashing, documents, odd_texts, prose
from tests.llm.test_near_join import edited, plain_components, plain_set


def _texts(rng):
    passage = prose(rng, 40, 9)
    texts = [prose(rng, 40, 9) for _ in range(12)]
    texts += [edited(rng, t, rng.randrange(1, 3)) for t in texts[:6] for _ in range(5)] + texts[:4] * 3
    texts += [f"{passage} {prose(rng, rng.randrange(1, 20), 9)}" for _ in range(25)]
    rng.shuffle(texts)
    return [*texts, *odd_texts(rng), None, ""]


def _linked(x, y):
    shared = len(x & y)
    return shared > 0 and 100 * shared >= 75 * len(x | y)


@pytest.mark.parametrize("block", [300, 500_000])
def test_counts_and_pairs_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nl, "BLOCK", block)
    texts = _texts(random.Random(5))
    sets = [plain_set(t) for t in texts]
    want, pairs = [0] * len(texts), set()
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(s, i)
    for i, j in combinations(range(len(texts)), 2):
        if _linked(sets[i], sets[j]):
            want[i] += 1
            want[j] += 1
            if sets[i] != sets[j]:
                pairs.add(tuple(sorted((first[sets[i]], first[sets[j]]))))
    roots, sizes = plain_components(dict(enumerate(texts)))
    docs = documents(spark, texts).repartition(3)
    got = {r.doc_id: (r.n_links, r.component_id, r.n_shingles) for r in nl.link_counts(docs).collect()}
    assert got == {i: (want[i], roots[i], sizes[i]) for i in range(len(texts))}
    found = [tuple(r) for r in nl.links(docs).collect()]
    assert len(found) == len(set(found)) and set(found) == pairs and len(pairs) > 30


def test_copies_no_links_and_no_rows(spark):
    rng = random.Random(6)
    one, two = prose(rng, 20, 9), prose(rng, 20, 9)
    docs = documents(spark, [one, one, one, two, None])
    assert [r.n_links for r in nl.link_counts(docs).orderBy("doc_id").collect()] == [2, 2, 2, 0, 0]
    assert nl.links(docs).count() == 0
    assert nl.link_counts(docs.where("false")).count() == 0 and nl.links(docs.where("false")).count() == 0
    assert sorted(r.n_links for r in nl.link_counts(docs.unionAll(docs)).collect()) == [0, 0, 1, 1, 5, 5, 5, 5, 5, 5]


def test_clashing_columns(spark):
    docs = clashing(documents(spark, ["a b c d e f g h i j", "a b c d e f g h i j"])).withColumn("n_links", F.lit("x"))
    assert [r.n_links for r in nl.link_counts(docs).collect()] == [1, 1]
