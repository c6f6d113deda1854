import random

import pytest

from loadcurve.llm import token_counts as tc
from tests.llm.frames import clashing, documents, odd_texts


def greedy(word, pieces):
    n = at = 0
    while at < len(word):
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pieces), 0)
        if not size:
            return -1
        n, at = n + 1, at + size
    return n


@pytest.mark.parametrize("seed", range(30))
def test_automaton_matches_greedy(seed):
    rng = random.Random(seed)
    pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 15))}
    automaton = tc.LongestMatch(pieces)
    for _ in range(300):
        word = bytes(rng.choice(b"abcd" if rng.random() < 0.05 else b"abc") for _ in range(rng.randrange(0, 14)))
        assert automaton.count(word) == greedy(word, pieces)


def test_agrees_with_a_word_piece_library():
    from tokenizers import models, pre_tokenizers, Tokenizer

    rng = random.Random(1)
    starts = {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 5))) for _ in range(20)} | set("abcd")
    inside = {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 5))) for _ in range(20)} | set("abcd")
    names = ["[UNK]", *starts, *["##" + p for p in inside]]
    other = Tokenizer(models.WordPiece({p: i for i, p in enumerate(names)}, unk_token="[UNK]"))
    other.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    automaton = tc.LongestMatch([b" " + p.encode() for p in starts] + [p.encode() for p in inside])
    for _ in range(300):
        word = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 20)))
        assert automaton.count(b" " + word.encode()) == len(other.encode(word).ids)


def test_work_is_linear_in_the_word():
    automaton = tc.LongestMatch([b"a", b"a" * 50 + b"b"])
    assert automaton.count(b"a" * 200_000) == 200_000


def test_documents(spark):
    rng = random.Random(3)
    texts = odd_texts(rng)
    rows = {r.doc_id: r for r in tc.token_counts(clashing(documents(spark, texts))).collect()}
    pieces = set(tc.pieces_of_file())
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        assert rows[i].n_words == len(words) and rows[i].n_unknown == 0
        if len(words) < 2000 and len(t or "") < 10_000:
            assert rows[i].n_tokens == sum(greedy(b" " + w, pieces) for w in words)
    assert rows[5].n_tokens == rows[6].n_tokens and rows[0].n_tokens == 0
    assert tc.token_counts(documents(spark, ["x"]).limit(0)).count() == 0
