import random
import time

import numpy as np
import pytest

from loadcurve.llm import tiling as tl
from tests.llm.frames import clashing, documents, odd_texts, prose


def plain_tiles(doc, item, width):
    """Greedy tiling by its definition: scan for the longest unmarked match, mark it, and again."""
    free_item, free_doc = [True] * len(item), [True] * len(doc)
    tiles = []
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and free_item[i + k] and free_doc[j + k]:
                    k += 1
                if k >= width and (best is None or k > best[0]):
                    best = (k, i, j)
        if best is None:
            return tiles
        k, i, j = best
        tiles.append(best)
        for x in range(k):
            free_item[i + x] = free_doc[j + x] = False


@pytest.mark.parametrize("seed", range(40))
def test_tiles_match_the_definition(seed):
    rng = random.Random(seed)
    item = [rng.randrange(6) for _ in range(rng.randrange(0, 30))]
    doc = [rng.randrange(6) for _ in range(rng.randrange(0, 30))]
    for _ in range(3):
        if len(item) > 8:
            a = rng.randrange(len(item) - 8)
            doc[rng.randrange(len(doc) + 1) : 0] = item[a : a + 8]
    got = tl.tile(np.array(doc, np.uint64), np.array(item, np.uint64), 3)
    assert got == plain_tiles(doc, item, 3)


@pytest.fixture(scope="module")
def benchmark(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, 20 + 2 * i)) for i in range(30)] + [(30, "too short"), (31, None), (32, ""), (None, prose(rng, 25)), (5, "another text of item five here")]
    return spark.createDataFrame(items, "item_id bigint, text string"), items


def _plans(rng, items):
    cut = items[10][1].split(" ")
    return {
        0: prose(rng, 200) + " " + items[3][1] + " " + prose(rng, 100),
        1: items[4][1].upper().replace(" ", "!! "),
        2: " ".join(cut[20:]) + " , and then: " + " ".join(cut[:20]),  # reordered
        3: prose(rng, 60) + " " + " ".join(items[20][1].split(" ")[:8]),  # a small part
        4: prose(rng, 500),
        5: "it is too SHORT, yes",
        6: items[33][1],
        7: "Another text of item five here",
    }


def test_repeated_words_take_no_longer():
    """20,000 equal words against 2,000, and two words in turn: within a second each."""
    for item, doc in (([1] * 2000, [1] * 20_000), ([1, 2] * 1000, [2, 1, 1] * 7000), ([1] * 300 + [2] * 7, [1] * 20_000)):
        start = time.perf_counter()
        tiles = tl.tile(np.array(doc, np.uint64), np.array(item, np.uint64))
        assert time.perf_counter() - start < 1 and sum(k for k, _, _ in tiles) >= (300 if item[-1] != 2 or item[0] == item[1] else 0)
    assert tl.tile(np.ones(20_000, np.uint64), np.ones(2000, np.uint64)) == [(2000, 0, 0)]


@pytest.mark.parametrize("seed", range(15))
def test_long_repetitive_tiles_match_the_definition(seed):
    rng = random.Random(seed)
    item = [rng.randrange(2) for _ in range(60)]
    doc = [rng.randrange(2) for _ in range(70)] + item[20:50] + [1] * 9 + item[:25]
    got = tl.tile(np.array(doc, np.uint64), np.array(item, np.uint64), 4)
    assert got == plain_tiles(doc, item, 4)


@pytest.mark.parametrize(("block_bytes", "least"), [(8 << 20, 1), (2500, 3), (400, 8)])
def test_leaks_are_found_and_clean_texts_left(spark, benchmark, monkeypatch, block_bytes, least):
    monkeypatch.setattr(tl, "BLOCK_BYTES", block_bytes)
    bench, items = benchmark
    n = len(tl.blocks(bench))
    assert n >= least and (n == 1) == (least == 1)
    texts = _plans(random.Random(1), items)
    docs = clashing(documents(spark, list(texts.values())))
    found = {(r.doc_id, r.item_id): r for r in tl.contaminated(docs, bench).collect()}
    assert set(found) == {(0, 3), (1, 4), (2, 10), (5, 30), (6, None), (7, 5)}
    assert found[2, 10].coverage == 1 and found[2, 10].n_tiles == 2 and found[0, 3].longest_tile == len(items[3][1].split())
    kept = tl.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4]


@pytest.mark.parametrize("block_bytes", [8 << 20, 900])
def test_odd_rows(spark, benchmark, monkeypatch, block_bytes):
    monkeypatch.setattr(tl, "BLOCK_BYTES", block_bytes)
    bench, _ = benchmark
    docs = documents(spark, odd_texts(random.Random(3)))
    assert tl.contaminated(docs, bench).count() == 0 and tl.decontaminate(docs, bench).count() == docs.count()
    assert tl.contaminated(docs, bench.limit(0)).count() == 0 and tl.decontaminate(docs, bench.limit(0)).count() == docs.count()
    assert tl.contaminated(docs.limit(0), bench).count() == 0
    again = documents(spark, [(1, "too short"), (1, "too short"), (None, "too short")])
    assert tl.contaminated(again, bench.unionAll(bench)).count() == 3
    dates = bench.where("item_id = 30").selectExpr("date'2020-01-01' AS item_id", "text").unionAll(bench.where("item_id = 4").selectExpr("date'2020-01-02'", "text"))
    assert {str(r.item_id) for r in tl.contaminated(again, dates).collect()} == {"2020-01-01"}
