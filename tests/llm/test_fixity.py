import random

from pyspark.sql import functions as F

from loadcurve.llm import fixity as fx

RECORD = "file string, offset bigint, length bigint, digest string"


def _plain(left, right):
    """Places whose rows differ, by a look at every row."""
    def places(rows):
        out = {}
        for f, o, n, d in rows:
            out.setdefault((f or "", -1 if o is None else o), []).append((-1 if n is None else n, d or ""))
        return {k: sorted(v) for k, v in out.items()}

    a, b = places(left), places(right)
    return {(f, o): "missing" if (f, o) not in b else "extra" if (f, o) not in a else "changed" for f, o in a.keys() | b.keys() if a.get((f, o)) != b.get((f, o))}


def _audit(spark, left, right):
    rows = fx.audit(spark.createDataFrame(left, RECORD), spark.createDataFrame(right, RECORD)).collect()
    found = {(r.file, r.offset): r.kind for r in rows}
    assert len(found) == len(rows)
    return found


def test_audit_finds_just_the_damage(spark):
    rng = random.Random(1)
    left = [(f"f{k}", o * 40_000, 1000, f"{rng.random()}") for k in range(5) for o in range(60)]
    left += [("f0", 2**35, 5, "far"), (None, 0, 1, "x"), ("f1", None, None, None), ("f2", 0, 1000, "second at one place"), ("f3", 7, 7, "twice"), ("f3", 7, 7, "twice")]
    right = list(left)
    right[3] = (*right[3][:3], "changed")
    right[70] = (*right[70][:2], 999, right[70][3])
    for i in sorted((len(left) - 1, 100, 130, 200), reverse=True):
        del right[i]
    right += [("f4", 123, 4, "new"), ("new file", 0, 1, "n"), ("f1", None, None, "y")]
    want = _plain(left, right)
    assert len(want) == 9 and _audit(spark, left, right) == want
    assert _audit(spark, left, left) == {}
    assert _audit(spark, [], []) == {}
    assert set(_audit(spark, left[:3], []).values()) == {"missing"} and set(_audit(spark, [], left[:3]).values()) == {"extra"}


def test_roots_tell_the_order(spark):
    a = [("f", 0, 1, "x"), ("f", 1, 1, "y")]
    b = [("f", 0, 1, "y"), ("f", 1, 1, "x")]
    roots = [fx.tree(spark.createDataFrame(r, RECORD))[0].first().node for r in (a, b, a[::-1])]
    assert roots[0] == roots[2] != roots[1]


def test_volumes_of_pages(spark):
    rows = [(i, f"http://a/{i}", f"<p>{i}é</p>") for i in range(2500)] + [(None, None, None), (7, None, "")] + [(5, "u", "same")] * 50
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("file", F.lit("clash"))
    body = F.col("html")
    records = fx.warc_records(pages, {"a": body, "b": F.when(F.col("page_id") == 9, "other").otherwise(body)}).collect()
    assert sum(r.copies for r in records) == len(rows)
    files = {}
    for r in records:
        files.setdefault(r.file, []).append(r)
    for group in files.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length * r.copies
    frame = spark.createDataFrame(records)
    found = fx.audit(fx.replica(frame, "a"), fx.replica(frame, "b")).collect()
    assert [(r.kind, r.file) for r in found] == [("changed", "pages-0-0")]
    empty = fx.warc_records(pages.limit(0), {"a": body, "b": body})
    assert fx.audit(fx.replica(empty, "a"), fx.replica(empty, "b")).count() == 0
