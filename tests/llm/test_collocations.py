import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loadcurve.llm import collocations as co
from tests.llm.frames import clashing, odd_texts, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _plain(rows, least, top):
    """The contract, phrase by phrase."""
    f, n = {}, Counter()
    for lang, text in rows:
        counts = f.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for i in range(len(words)):
                for j in range(1, min(5, len(words) - i) + 1):
                    counts[tuple(words[i : i + j])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = set()
        for p, a in found.items():
            for j in range(2, len(p)):
                for i in range(len(p) - j + 1):
                    if 100 * a >= 100 * counts[p[i : i + j]]:
                        inside.add(p[i : i + j])
        rows = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]], k))
        for rank, (score, a, phrase, left, right, k) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score, k))
    return sorted(out)


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string")


@pytest.mark.parametrize(("least", "hot"), [(4, 50), (9, 10**9)])
def test_equal_to_plain_counts(spark, rng, monkeypatch, least, hot):
    monkeypatch.setattr(co, "MIN_COUNT", least)
    monkeypatch.setattr(co, "HOT_LEAST", hot)
    monkeypatch.setattr(co, "CHUNK_BYTES", 20_000)
    passage = "Take the Long road, then the long road again and again; the end"
    rows = [(["en", "de", None, "und"][k % 4], prose(rng, rng.randrange(200), 12) + ". " + passage * (k % 3)) for k in range(150)]
    rows += [("en", t) for t in odd_texts(rng)] + [("xx", "a a a a a a\ta a")] * 3 + [("xx", "É é É é. É é")] * 5
    docs = clashing(_frame(spark, rows)).repartition(7)
    got = sorted(tuple(r) for r in co.collocations(docs, top=40).collect())
    want = _plain(rows, least, 40)
    assert got == want and len(want) > 60


def test_small_tables(spark):
    assert co.collocations(_frame(spark, [])).count() == 0
    assert co.collocations(_frame(spark, [("en", None), (None, ""), ("en", " . ")])).count() == 0
    many = _frame(spark, [("en", "one two")] * 100 + [(None, "one two")] * 99)
    assert [tuple(r) for r in co.collocations(many).collect()] == [("en", 1, "one two", 100, 100, 100, 200, 2000, 1)]


def test_scores_beyond_64_bits(spark):
    """The arithmetic of the query: 38 digits, floored."""
    row = spark.createDataFrame([(4_000_000_000_000, 9_000_000_000_000, 4_000_000_000_001, 4_000_000_000_003)], "a bigint, n bigint, l bigint, r bigint")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    row = row.select((F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")).alias("x"), (wide("l") * wide("r")).alias("y"))
    assert row.selectExpr("x div y").first()[0] == 1000 * 4_000_000_000_000 * 9_000_000_000_000 // (4_000_000_000_001 * 4_000_000_000_003)


def test_words_of_bytes():
    w = co.Words(pa.array(["", None, "A b\t\tÉ,c\x0bd", "", "x", "  "]))
    assert [w.texts[int(i)].as_py() for i in w.word] == ["a", "b", "É", "c", "d", "x"]
    assert w.doc.tolist() == [2, 2, 2, 2, 2, 4]
    assert len({*w.piece[:3].tolist()}) == 1 and len({*w.piece.tolist()}) == 4


def test_marked_phrases_are_found(spark):
    phrases = [("en", " ".join(f"w{i % 7}{j}" for j in range(1 + i % 4)), i) for i in range(3000)]
    table = co.phrase_table(spark.createDataFrame(phrases, "lang string, phrase string, f bigint"), 10**6).value
    marks = co.word_marks([b"en"] * len(phrases))
    for i, (_, p, _f) in enumerate(phrases):
        for word in p.split():
            marks[i] = co.follow(marks[i : i + 1], co.word_marks([word.encode()]))[0]
    assert co.is_marked(table[0], marks).all()
    assert not co.is_marked(table[1], marks).any()
    assert co.is_marked(table[0], np.arange(1, 10**6, 7919, dtype=np.uint64) * np.uint64(2**40 + 12345)).mean() < 0.01


def test_prefixes_are_numbered_in_one_sort_while_there_is_room():
    rng = np.random.default_rng(4)
    lang, words = rng.integers(0, 3, 5000), [rng.integers(0, 9, 5000) for _ in range(4)]
    want = np.unique(np.stack([lang, *words], 1), axis=0, return_inverse=True)[1].ravel()
    sorts, unique = [], np.unique
    for room, most in ((1 << 62, 1), (3 * 9**3, 3), (9, 4)):
        sorts.clear()
        np.unique = lambda *a, **k: sorts.append(1) or unique(*a, **k)
        try:
            got = co._prefix_numbers(lang, words, 9, room)
        finally:
            np.unique = unique
        assert (got == want).all() and len(sorts) <= most
    assert (co._prefix_numbers(lang, [], 9) == lang).all()


def test_small_tables_are_stored_in_one_file_each(spark):
    docs = spark.createDataFrame([("en", f"w{i % 7} w{i % 5} w{i % 3} same old words") for i in range(3000)], "lang string, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1k")  # many tasks for the merge, as with much text
    try:
        merged = co.merged_stripes(docs, 0, None).cache()
        assert merged.rdd.getNumPartitions() > 1
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        assert len(co._stored_whole(merged).inputFiles()) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")
        merged.unpersist()
