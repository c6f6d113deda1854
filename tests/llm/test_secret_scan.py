import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from loadcurve.llm import secret_scan as sc
from tests.llm.frames import clashing, documents, odd_texts, prose

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")


def _hex(rng, n=40):
    return "".join(rng.choice("0123456789abcdef") for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    texts, planted = [], {}
    for i in range(200):
        t = prose(rng, 40)
        if i % 4 == 0:
            planted[i] = _hex(rng)
            t += f' {rng.choice(["token", "API_KEY", "password"])} = "{planted[i]}" ' + prose(rng, 20)
        elif i % 4 == 1:
            t += " " + "".join(rng.choice(["an", "the", "ion"]) for _ in range(9)) + " and " + prose(rng, 10)
        elif i % 4 == 2:
            t += f" card {rng.randrange(10**15, 10**16)} of"
        texts.append(t)
    return documents(spark, texts), texts, planted


def test_findings_match_a_plain_search(corpus):
    docs, texts, planted = corpus
    rows = sc.secrets(docs).collect()
    want = sorted((i, w, k, len(v)) for i, t in enumerate(texts) for w, word in enumerate(re.split(r"[\x20\x09-\x0D]+", t)) for k, v in enumerate(CANDIDATE.findall(word)))
    assert sorted((r.doc_id, r.word, r.part, r.length) for r in rows) == want
    assert {r.doc_id for r in rows if r.is_secret} == set(planted)
    assert all(r.is_secret == (r.score >= sc.CUTOFF) and 0 <= r.score <= 1 for r in rows)


def test_expressions_score_as_the_forest(corpus):
    docs, _, _ = corpus
    known = sc.dictionary(docs)
    found = sc.with_words(docs).select(F.explode(sc.findings(known)).alias("x")).select("x.f").withColumn("label", sc.weak_labels(F.col("f")))
    forest = sc.fit(found)
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=sc.FEATURES, outputCol="features").transform(found.withColumn("share", sc.verdict(forest, F.col("f"))).select("share", "f.*"))
    votes = None
    for tree in forest.trees:
        out = [r.prediction for r in tree.transform(rows).select("prediction").collect()]
        votes = out if votes is None else [a + b for a, b in zip(votes, out, strict=True)]
    assert [round(r.share * len(forest.trees)) for r in rows.select("share").collect()] == votes


def test_dictionary_counts_all_words(spark):
    docs = documents(spark, ["the the cat. Cat THE dog", "dogs a an é the", None])
    assert sc.dictionary(docs, 2) == ["cat", "the"]


def test_redaction(corpus):
    docs, texts, planted = corpus
    rows = {r.doc_id: r for r in sc.redact(clashing(docs)).collect()}
    assert len(rows) == 200 and sc.redact(clashing(docs)).columns == clashing(docs).columns
    for i, t in enumerate(texts):
        want = t.replace(planted[i], "[secret]") if i in planted else t
        assert rows[i].text == want and rows[i].n_chars == len(want)


def test_no_python_in_the_plan(corpus):
    docs, _, _ = corpus
    plan = sc.redact(docs)._jdf.queryExecution().executedPlan().toString() + sc.secrets(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows(spark, corpus):
    docs, texts, planted = corpus
    key = planted[0]
    odd = odd_texts(random.Random(1)) + [f'token = "{key}"', f'token = "{key}" {key}{key}', f'token = "{key}"']
    both = clashing(docs.unionAll(documents(spark, odd, first=1000)))
    rows = {r.doc_id: r.text for r in sc.redact(both).collect()}
    assert [rows[1000 + i] for i in range(len(odd) - 3)] == odd[:-3]
    assert rows[1011] == rows[1013] == 'token = "[secret]"'
    assert sc.secrets(docs.limit(0)).count() == 0 and sc.redact(docs.limit(0)).count() == 0
    plain = documents(spark, ["no findings here", None])
    assert sc.secrets(plain).count() == 0 and sorted(str(r.text) for r in sc.redact(plain).collect()) == ["None", "no findings here"]
    assert {r.doc_id for r in sc.secrets(docs.where("doc_id % 4 = 0"), None).where("is_secret").collect()} == set(planted)


GIVEN = [
    ('password = "S3cure!Pass" and', "S3cure!Pass"), ("pwd=hunter2hunter, then", "hunter2hunter"), ("api_key: AKIA12x9", "AKIA12x9"),
    ("DB_PASSWORD='p4ss#w0rd$x';", "p4ss#w0rd$x"), ('{"user":"me","password":"a1!b2@c3","n":1}', "a1!b2@c3"), ('secret "q7w8!e9r0t" of', "q7w8!e9r0t"),
    ("see postgres://me:l3t@db.local/x and", "l3t"), ("from ftp://postgres:postgres@host/", "postgres"),
]


def test_short_and_marked_values_after_key_words(spark, corpus):
    docs, _, planted = corpus
    texts = [f"the {t} ion" for t, _ in GIVEN] + ["password: required ion", "the author: Shakespeare wrote", "l3t me http://host:8080/x a@b"]
    rows = sc.secrets(docs.unionAll(documents(spark, texts, first=1000))).collect()
    found = {(r.doc_id - 1000, r.digest) for r in rows if r.is_secret and r.doc_id >= 1000}
    assert found == {(i, hashlib.sha256(v.encode()).hexdigest()) for i, (_, v) in enumerate(GIVEN)}
    assert {r.doc_id for r in rows if r.is_secret and r.doc_id < 1000} == set(planted)
    clean = {r.doc_id - 1000: r.text for r in sc.redact(docs.unionAll(documents(spark, texts, first=1000))).where("doc_id >= 1000").collect()}
    for i, (t, v) in enumerate(GIVEN[:-1]):
        assert clean[i] == f"the {t.replace(v, '[secret]')} ion"
    assert "postgres" not in clean[len(GIVEN) - 1] and [clean[len(GIVEN) + k] for k in range(3)] == texts[len(GIVEN) :]


#: Lines that hold no secret, though a key word stands in a longer word, or a value only names or checks something.
HARMLESS = [
    "author: Smith2020", 'authority="Ofgem2019a"', "tokenizer: BertTokenizer2", "secretary: Johnson1", 'author="J.Smith-1999"', "TOKENIZER=BertTokenizer2",
    "compassword1 x", "authentic: Vermeer1665", "Secretariat=Brussels1958", "see commit {hex}", "checksum {hex}", "sha256: {hex}", "uuid {hex}", "etag {hex}",
]
SECRET = [
    'password = "{mixed}"', "dbToken={mixed}", "DB_TOKEN: {mixed}", "auth_token={mixed}", "auth: {mixed}", "Authorization: {mixed}", "API-KEY={mixed}",
    "mypassword={mixed}", 'secrets = "{mixed}"', "credentials: {mixed}", "accessKey={mixed}", "ftp://me:{mixed}@host/x",
]


def test_precision_and_recall_on_planted_lines(spark, corpus):
    docs, _, planted = corpus
    rng = random.Random(8)

    def filled(line):
        mixed = "".join(rng.choice("abcdefghjkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(rng.randrange(12, 30))) + "7x"
        return line.replace("{hex}", _hex(rng)).replace("{mixed}", mixed)

    lines = [(filled(line), True) for line in SECRET * 12] + [(filled(line), False) for line in HARMLESS * 12]
    texts = [f"{prose(rng, 12)} {line} {prose(rng, 12)}" for line, _ in lines]
    rows = sc.secrets(docs.unionAll(documents(spark, texts, first=1000))).where("doc_id >= 1000 and is_secret").collect()
    found = {r.doc_id - 1000 for r in rows}
    true = {i for i, (_, secret) in enumerate(lines) if secret}
    assert len(found & true) >= 0.95 * len(true) and len(found & true) >= 0.95 * len(found), sorted({lines[i][0] for i in found ^ true})


def test_scores_do_not_depend_on_the_partitioning(spark, corpus, monkeypatch):
    docs, _, _ = corpus
    monkeypatch.setattr(sc.fit, "__defaults__", (20, 11))
    scores = [sorted((r.doc_id, r.word, r.part, r.score) for r in sc.secrets(docs.repartition(n)).collect()) for n in (1, 6)]
    assert scores[0] == scores[1]
