"""Small frames for the tests of the operators."""

from __future__ import annotations

import random

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, first=0, **more):
    """Documents of these texts, with ids from `first`; ids may be given as (id, text)."""
    rows = []
    for i, t in enumerate(texts, first):
        i, t = t if isinstance(t, tuple) else (i, t)
        rows.append((i, t, more.get("lang", "en"), "src0", None if t is None else len(t)))
    return spark.createDataFrame(rows, DOC)


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    out = []
    for k in range(words):
        w = "".join(rng.choice(["an", "the", "re", "ion", "es", "ou", "nd"]) for _ in range(1 + rng.randrange(vocabulary) % 3))
        out.append(w + ("." if k % 12 == 11 else ""))
    return " ".join(out)


def odd_texts(rng: random.Random) -> list:
    """Null, empty, blank, short, long, repeated and odd texts."""
    long = prose(rng, 30_000)
    return [None, "", "  \n\t ", "a", "one two three four", long, long, "é ß ü 漢字  x", "!!!" * 50, "x" * 200_000, "of " * 500]


def clashing(df):
    """The frame with further columns, some with the names of results."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("SCORE", "kept", "shard", "n_tokens", "key", "label", "sequence_id", "findings", "component_id", "item_id", "set")})
