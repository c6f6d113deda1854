import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loadcurve.llm import packing as pk
from tests.llm.frames import clashing, documents, odd_texts, prose


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(1)
    texts = [t or "" for t in odd_texts(rng)] + [
        " a", "a ", "a  b", "a\n b", "a \nb", "a\tb c", " a b", "a b", "don't 's ' s", "x<|endoftext|>y", "1 2,3  .", "é ü\n\nß", " ", "\n",
    ]
    texts += ["".join(rng.choice("ab1.é' \n\t ") for _ in range(40)) for _ in range(300)]
    encode = pk.encoder()
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 100])
    counts = Counter(rng.randrange(1, capacity + 1) for _ in range(rng.choice([0, 5, 80, 500])))
    bins = pk.plan(dict(counts), capacity)
    used = Counter()
    for lengths, n in bins:
        assert sum(lengths) <= capacity and n > 0
        for s in lengths:
            used[s] += n
        assert sum(3 * s > capacity for s in lengths) <= 2
    assert used == counts
    total = sum(s * c for s, c in counts.items())
    simple = first_fit_falling(counts, capacity)
    assert -(-total // capacity) <= sum(n for _, n in bins) <= simple * 1.1 + 1


def first_fit_falling(counts, capacity):
    bins = []
    for s in sorted(counts.elements(), reverse=True):
        for i, b in enumerate(bins):
            if b + s <= capacity:
                bins[i] += s
                break
        else:
            bins.append(s)
    return len(bins)


def check(rows, texts, tokenizer, capacity):
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        for k, r in enumerate(pieces):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == capacity)
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids) and (len(ids) > capacity or len(pieces) == 1)
    for group in by_bin.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_bin)


def test_documents_round_trip(spark, tokenizer):
    rng = random.Random(2)
    texts = dict(enumerate(odd_texts(rng) + [prose(rng, rng.randrange(1, 300)) for _ in range(150)]))
    docs = clashing(documents(spark, list(texts.values())).repartition(5))
    rows = pk.pack_documents(docs, capacity=256).collect()
    n = check(rows, texts, tokenizer, 256)
    assert n <= -(-sum(r.length for r in rows) // 256) * 1.02 + 1
    ids = pk.tokenize(docs, 256, with_ids=True).where("doc_id = 20").orderBy("piece").collect()
    assert np.frombuffer(b"".join(r.ids for r in ids), "<u4").tolist() == [*tokenizer.encode(texts[20], add_special_tokens=False).ids, 0]


def test_empty_and_repeated(spark):
    empty = documents(spark, ["x"]).limit(0)
    assert pk.pack_documents(empty).collect() == []
    rows = pk.pack_documents(documents(spark, [(1, "a b"), (1, "a b"), (None, None)])).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == [("1", 3), ("1", 3), ("None", 1)] and len({r.offset for r in rows}) == 3
