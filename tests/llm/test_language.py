import random
from collections import Counter

import numpy as np
import pytest

from loadcurve.llm import language as lg
from tests.llm.frames import clashing, documents

PARTS = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ver", "ung"], "cc": ["eau", "qué", "oi"], "dd": ["ción", "ado", "ñez"]}


def _corpus(spark, n=40):
    rng = random.Random(3)
    rows = []
    for k, (name, parts) in enumerate(PARTS.items()):
        for i in range(n):
            text = " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(rng.randrange(5, 60)))
            rows.append((k * 1000 + i, text, name, "s", len(text)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_profile_counts_all_ngrams():
    text = "Ab, cd é!x"
    letters = "ab cd é x"
    want = Counter(len(letters[i : i + k]) for k in lg.ORDERS for i in range(len(letters) - k + 1))
    got = lg.profile(text) ** 2
    assert np.isclose(got.sum(), 1) and np.isclose(got.min(), 0)
    assert np.isclose(got[got > 0].min() * sum(want.values()), 1)
    assert np.allclose(lg.profile("ab cd é x"), lg.profile(text))
    assert lg.profile("123 !?") is None and lg.profile("") is None and lg.profile(None) is None


def test_long_texts_are_counted_in_chunks(monkeypatch):
    text = "abc déf gh " * 300
    whole = lg.profile(text)
    monkeypatch.setattr(lg, "CHUNK", 97)
    assert np.allclose(lg.profile(text), whole)


@pytest.mark.parametrize("n", [2, 3, 4, 7, 12])
def test_codewords_are_apart(n):
    words = lg.code(n)
    distance = ((words.shape[1] - words @ words.T) / 2)[~np.eye(n, dtype=bool)]
    assert set(np.unique(words)) == {-1.0, 1.0} and distance.min() >= (2 ** (n - 2) if n <= 7 else words.shape[1] / 4)
    assert (np.abs(words.sum(axis=0)) < n).all()  # each bit splits the classes


def test_decoding_corrects_a_wrong_bit():
    words = lg.code(4)
    coder = lg.Coder(list("abcd"), words, np.eye(7), np.zeros(7), np.full(7, 1 / 7))
    for k, w in enumerate(words):
        for wrong in range(7):
            margins = 2.0 * w
            margins[wrong] *= -1
            assert coder.losses(margins[None])[0].argmin() == k


def test_held_out_accuracy(spark):
    rows = lg.identify(_corpus(spark)).collect()
    out = [r for r in rows if r.held_out]
    names = list(PARTS)
    assert len(rows) == 160 and len(out) > 10
    assert all(r.lang_pred == names[r.doc_id // 1000] and 0.5 < r.score <= 1 for r in out)


def test_odd_rows(spark):
    docs = _corpus(spark, 15)
    odd = clashing(documents(spark, [None, "", "12 34", "kalomi", "kalomi", "sch" * 100_000, "kaschlover"], first=9000))
    rows = {r.doc_id - 9000: r for r in lg.predict(odd, lg.fit(docs)).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 and rows[i].ambiguous for i in (0, 1, 2))
    assert rows[3].lang_pred == rows[4].lang_pred == "aa" and rows[3].score == rows[4].score and rows[5].lang_pred == "bb"
    assert lg.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in lg.predict(docs, lg.fit(docs.selectExpr("doc_id", "text", "string(null) AS lang"))).collect()} == {"und"}
    assert {(r.lang_pred, r.score) for r in lg.identify(docs.where("lang = 'aa'")).collect()} == {("aa", 1.0)}
