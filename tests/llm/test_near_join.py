import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from loadcurve.llm import near_join as nj
from loadcurve.llm import partenum as pe
from loadcurve.llm.components import components
from tests.llm.frames import clashing, documents, odd_texts, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_components(texts: dict):
    sets = {i: plain_set(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(texts, 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in texts}, {i: len(s) for i, s in sets.items()}


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        k = rng.randrange(len(words))
        words[k : k + rng.randrange(2)] = [rng.choice(["zz", "yy", "xx"])]
    return " ".join(words)


def test_sets_match_a_plain_version():
    rng = random.Random(1)
    for t in [*odd_texts(rng), "A b\x0bC d\te f", "É É É É É é", "a b c d e", "a b c d e a b c d e", "ÀB c"]:
        h = pe.shingles(t)
        assert len(h) == len(plain_set(t)) and (np.diff(h.astype(object)) > 0).all()
    assert (pe.shingles("ONE two three") == pe.shingles("one Two three")).all()
    assert pe.fingerprint(pe.shingles("one two")) != pe.fingerprint(pe.shingles("two one"))


def test_bands_hold_all_partners():
    for n in range(1, 3000):
        p = n * 4 // 3
        assert np.searchsorted(pe.BANDS, p) - np.searchsorted(pe.BANDS, n) <= 1


@pytest.mark.parametrize(("second", "chosen"), [(2, 1), (3, 2), (1, 1)])
def test_near_sets_share_as_many_signatures_as_promised(monkeypatch, second, chosen):
    monkeypatch.setattr(pe, "SECOND", second)
    monkeypatch.setattr(pe, "CHOSEN", chosen)
    rng = np.random.default_rng(second)
    for n in [1, 2, 3, 4, 5, 8, 13, 30, 77, 200, 600] * 6:
        union = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        spare = len(union) // 4
        a, b = np.sort(rng.choice(union, len(union) - rng.integers(0, spare + 1), replace=False)), union
        if not nj.linked(len(np.intersect1d(a, b)), len(a), len(b)):
            continue
        if rng.random() < 0.5:  # differences on both sides
            gone = rng.integers(0, spare + 1)
            a, b = np.sort(union[gone:]), np.sort(union[: len(union) - (spare - gone)])
        of_a = {i: s for s, i, _ in pe.signatures(a)}
        shared = {i: (len(np.intersect1d(of_a[i], s)), slack) for s, i, slack in pe.signatures(b if len(b) >= len(a) else a) if i in of_a}
        larger = pe.signatures(b if len(b) >= len(a) else a)
        smaller = {i: s for s, i, _ in pe.signatures(a if len(b) >= len(a) else b)}
        shared = [(len(np.intersect1d(smaller[i], s)), slack) for s, i, slack in larger if i in smaller]
        assert any(n_shared > slack >= 0 for n_shared, slack in shared) or any(n_shared for n_shared, _ in shared)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(4)
    for n in [1, 2, 5, 40, 300, 2000]:
        for p in [1, n, n + n // 3 + 1]:
            x, y = (np.unique(rng.integers(0, 2**64, k, dtype=np.uint64)) for k in (n, p))
            y = np.unique(np.concatenate([y[: p // 2], x[: p // 2]]))
            assert nj.least_difference(nj.sketch(x), nj.sketch(y)) <= len(np.setxor1d(x, y))
            assert nj.least_difference(nj.sketch(x), nj.sketch(x)) == 0


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(60)]
    edges = [*chain, (100, 100), (None, 3), *[(500, k) for k in range(501, 530)], *[(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def _texts():
    rng = random.Random(6)
    passage = prose(rng, 55)
    texts = [prose(rng, rng.randrange(3, 160)) for _ in range(60)]
    for i in range(25):  # near and not so near copies of one another
        texts += [edited(rng, texts[i], rng.randrange(0, 12)) for _ in range(rng.randrange(1, 5))]
    texts += [edited(rng, texts[-1], 1) for _ in range(3)]
    base = prose(rng, 150)
    texts += [edited(rng, base, k % 9) for k in range(40)]  # a large group of near copies
    texts += [prose(rng, 40) + " " + passage + " " + prose(rng, 30) for _ in range(40)]  # a common passage
    texts += [base] * 30 + [base.upper()] * 3
    texts += [" ".join(f"w{k}" for k in range(i)) for i in range(12)] + [" ".join(f"w{k}" for k in range(1, i)) for i in range(12)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("small", [False, True])
def test_components_match_brute_force(spark, monkeypatch, small):
    if small:  # ranges, packets and blocks of a few
        monkeypatch.setattr(nj, "BYTES_A_SIGNATURE", 1)
        monkeypatch.setattr(nj, "RANGE", 9000)
        monkeypatch.setattr(nj, "PACKET", 500)
        monkeypatch.setattr(nj, "BLOCK", 700)
        monkeypatch.setattr(nj, "BROADCAST_ROWS", 3)
    texts = dict(enumerate(_texts(), 10))
    docs = documents(spark, list(texts.values()), first=10).repartition(4)
    rows = nj.near_duplicates(docs).collect()
    want, sizes = plain_components(texts)
    assert len(rows) == len(texts) and {r.doc_id: r.n_shingles for r in rows} == sizes
    assert {r.doc_id: r.component_id for r in rows} == want


def test_one_of_each_component_stays(spark):
    texts = dict(enumerate(_texts()))
    docs = clashing(documents(spark, list(texts.values())).repartition(3))
    kept = nj.keep_one(docs)
    want, sizes = plain_components(texts)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, root in want.items() if i == root or not sizes[i])


def test_odd_rows(spark):
    texts = odd_texts(random.Random(3))
    rows = {r.doc_id: r for r in nj.near_duplicates(clashing(documents(spark, texts))).collect()}
    assert [rows[i].n_shingles for i in (0, 1, 2, 3, 4)] == [0, 0, 0, 1, 1]
    assert rows[6].component_id == 5 and all(rows[i].component_id == i for i in (0, 1, 2, 3, 4, 5, 7, 8, 9, 10))
    empty = documents(spark, ["x"]).limit(0)
    assert nj.near_duplicates(empty).count() == 0 and nj.keep_one(empty).count() == 0
    ids = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (None, "q"), (4, "r s"), (4, "r s"), (None, None), (None, None)]
    rows = nj.near_duplicates(documents(spark, ids)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == sorted(
        [("None", 2, "4"), ("None", 2, "4"), ("4", 2, "4"), ("None", 1, "None"), ("4", 1, "4"), ("4", 1, "4"), ("None", 0, "None"), ("None", 0, "None")]
    )
    kept = [r.text for r in nj.keep_one(documents(spark, ids)).collect()]
    assert sorted(map(str, kept)) == ["None", "None", "a b c d e f", "q", "r s"]


def _kept(a, b):
    """Whether the pair is met where just the signatures that both have are common: the hardest case for the join."""
    of_a = {i: (s, slack) for s, i, slack in pe.signatures(a)}
    for s, i, slack in pe.signatures(b):
        if i in of_a and (shared := len(np.intersect1d(of_a[i][0], s))) and shared > max(slack, of_a[i][1]):
            return True
    return False


@pytest.mark.parametrize("width", [64, 62, 59])
def test_every_superset_is_met(width):
    """Of sets of each size up to 60; hashes below 2**62 or 2**59 fall into few parts."""
    rng = np.random.default_rng(width)
    for n in range(1, 61):
        for p in range(n, n * 4 // 3 + 1):
            for _ in range(6):
                b = np.unique(rng.integers(0, 2**width, p, dtype=np.uint64))
                a = np.sort(rng.choice(b, n, replace=False))
                assert nj.linked(n, n, p) and _kept(a, b) and _kept(b, a), (n, p)


def _parts(text):
    h = pe.shingles(text)
    return ((h >> np.uint64(32)) * np.uint64(6) >> np.uint64(32)).tolist()


def test_short_texts_and_their_supersets_are_linked(spark):
    """Texts of 3 shingles and one more: all in one of 6 parts; and, of a passage that others share, the own ones in one part."""
    word = lambda k: f"w{k}"
    texts, found, k = [], 0, 0
    while found < 3:
        k += 8
        words = [word(k + j) for j in range(8)]
        if len(set(_parts(" ".join(words)))) == 1:
            texts += [" ".join(words[:7]), " ".join(words)]
            found += 1
    passage = [f"p{j}" for j in range(6)]
    own = set(_parts(" ".join(passage)))
    while found < 6:
        k += 2
        text = " ".join([*passage, word(k), word(k + 1)])
        both = set(_parts(" ".join(text.split()[2:])))
        if len(both) == 1 and not both & own:
            texts += [text.rsplit(" ", 1)[0], text]
            found += 1
    texts += [" ".join([*passage, f"other{j}"]) for j in range(8)]
    rng = random.Random(7)
    shared = prose(rng, 30)
    for n in range(1, 61):  # by words at the end, without and with a passage that many have
        for more in {n // 3, (n + 3) // 6}:
            first = "" if n % 2 else shared[: rng.randrange(len(shared))] + " "
            text = (first + " ".join(word(rng.randrange(10**9)) for _ in range(n + 4))).split()[: n + 4]
            texts += [" ".join(text), " ".join([*text, *(word(rng.randrange(10**9)) for _ in range(more))])]
    texts = dict(enumerate(texts))
    got = {r.doc_id: r.component_id for r in nj.near_duplicates(documents(spark, list(texts.values()))).collect()}
    assert got == plain_components(texts)[0]


def _sent(texts, ranges):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "key", "text"])
    return [row for out in nj._send(ranges)([batch]) for row in out.select(["range", "signatures", "names", "common"]).to_pylist() if row["signatures"] is not None]


@pytest.mark.parametrize("ranges", [1, 63, 4000])
def test_bytes_of_a_signature_do_not_grow_with_the_ranges(ranges):
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(5, 400), 6) for _ in range(60)]
    rows = _sent(texts, ranges)
    made = sum(len(v) for t in texts for v, _, _ in pe.signatures(pe.shingles(t)))
    assert sum(len(r["signatures"]) + len(r["names"]) for r in rows) <= 16 * made
    assert sum(len(r["names"]) for r in rows) == sum(len(r["signatures"]) for r in rows)


def test_frequent_signatures_leave_one_mark_in_their_range():
    rng = random.Random(4)
    passage = prose(rng, 300, 9)
    rows = _sent([passage + " " + prose(rng, 3) for _ in range(200)], 7)
    sent = np.concatenate([np.frombuffer(r["signatures"], np.uint64) for r in rows if not r["common"]])
    assert np.unique(sent, return_counts=True)[1].max() <= nj.RUN
    assert any(r["common"] and r["range"] >= 7 for r in rows)


@pytest.mark.parametrize("packet", [4_000, 60_000])
def test_components_where_a_passage_is_frequent(spark, monkeypatch, packet):
    """Marks of some packets, names of others, copies in several packets: the links are those of brute force."""
    monkeypatch.setattr(nj, "BYTES_A_SIGNATURE", 1)
    monkeypatch.setattr(nj, "RANGE", 9000)
    monkeypatch.setattr(nj, "PACKET", packet)
    rng = random.Random(7)
    passage = prose(rng, 60, 9)
    texts = [f"{passage} {prose(rng, rng.randrange(1, 40), 9)}" for _ in range(60)]
    texts += [edited(rng, t, 2) for t in texts[::4]] + texts[::7] + [prose(rng, 50, 9) for _ in range(20)] + [passage] * 9
    rng.shuffle(texts)
    want, _ = plain_components(dict(enumerate(texts)))
    got = {r.doc_id: r.component_id for r in nj.near_duplicates(documents(spark, texts).repartition(4)).collect()}
    assert got == want and len(set(want.values())) > 20
