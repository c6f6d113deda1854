import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loadcurve.llm import sharding as sh
from tests.llm.frames import clashing, documents, odd_texts


def test_large_hypergeometric_draws_follow_the_law():
    rng = np.random.default_rng(1)
    good, bad, drawn = 900_000_000, 2_100_000_000, 400_000
    x = np.array([sh.hypergeometric(rng, good, bad, drawn) for _ in range(400)])
    sd = np.sqrt(drawn * 0.3 * 0.7)
    assert abs(x.mean() - 0.3 * drawn) < 5 * sd / 20 and 0.85 < x.std() / sd < 1.15


@pytest.mark.parametrize("seed", range(5))
def test_matrix_has_both_sums(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 50, 12).tolist()
    caps = sh.shard_sizes(sum(sizes), 5)
    m = sh.draw_matrix(rng, sizes, caps)
    assert m.sum(axis=1).tolist() == sizes and m.sum(axis=0).tolist() == caps and (m >= 0).all()


def _check(rows, n, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == n and set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(k, [])) for k in range(shards)]
    assert max(counts) - min(counts) <= 1


def test_shuffle_is_exact_and_uniform(spark, monkeypatch):
    monkeypatch.setattr(sh, "BLOCK_BITS", 4)
    monkeypatch.setattr(sh, "BLOCKS_A_GROUP", 5)
    monkeypatch.setattr(sh, "RANGE_ROWS", 7)
    df = spark.range(0, 3003, numPartitions=7).toDF("x")
    placed = [sh.uniform_shuffle(df, 4, seed).orderBy("x").collect() for seed in (1, 2, 3)]
    for rows in placed:
        _check(rows, 3003, 4)
        x, shard, slot = (np.array([r[k] for r in rows]) for k in range(3))
        for part in np.array_split(shard, 10):  # about as many of each run of rows in each shard
            assert ((np.bincount(part, minlength=4) - 75) ** 2 / 75).sum() < 25
        assert abs(np.corrcoef(x, slot)[0, 1]) < 0.08
        assert abs(np.corrcoef(slot[:-1], slot[1:])[0, 1]) < 0.08
    a, b = (np.array([r.shard for r in rows]) for rows in placed[:2])
    assert 0.2 < (a == b).mean() < 0.3
    assert placed[0] == sh.uniform_shuffle(df, 4, 1).orderBy("x").collect()


def test_documents(spark):
    texts = odd_texts(random.Random(1)) + ["same"] * 30
    docs = clashing(documents(spark, texts).repartition(3))
    rows = sh.shard_documents(docs, 16).collect()
    _check(rows, len(texts), 16)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    wide = sh.uniform_shuffle(docs, 3)
    assert wide.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"]
    assert Counter(r.text for r in wide.collect()) == Counter(texts)


def test_repeated_rows_and_none(spark):
    _check(sh.shard_documents(documents(spark, [(None, None)] * 40 + [(1, "a")] * 25)).collect(), 65, 16)
    assert sh.shard_documents(documents(spark, ["a"]).limit(0)).count() == 0
    _check(sh.shard_documents(documents(spark, ["a", "b"])).collect(), 2, 16)
