"""Secret scan with a random forest that removes false positives, in DataFrame and SQL functions only.

Candidates are long runs of letters, digits and the marks of encoded values, in the words of a text; values of
8 or more characters, marks included, that are assigned or quoted right after a key word; and passwords of any
length in addresses (`user:pass@host`). Each gets features: its length, the transitions between kinds of characters in it, the share of it that words of a
dictionary cover, marks of paths, and what its neighbouring words are. A forest fitted on labelled findings
tells secrets from the rest. Its trees are written out as CASE expressions, so scoring happens inside
the row: no explode, join or shuffle of texts, and nothing is lost whatever the ids are.

Where no findings are labelled, `weak_labels` labels the clear ones by rule and leaves the others open. The
dictionary is the most frequent short words of all documents.

Defined cases: null and empty texts have no findings; without labelled findings of both kinds the rule of
`weak_labels` decides alone, with scores 0 and 1; equal candidates at two places are two findings; the share of trees
must reach CUTOFF, a tie included; result columns replace input columns of the same name.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcurve.llm.common import stored, without

#: What a candidate is, and which words next to one speak for or against it.
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
SPACE = r"[\x20\x09-\x0D]+"
#: A key word starts a word, a part of one (DB_TOKEN, dbToken), or is one for passwords; and it ends there, but for a plural s.
KEY_WORDS = (
    r"((?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?i:token|secret|api.?key|access.?key|private.?key|auth(?:.?(?:key|token))?|authorization|credential|bearer)"
    r"s?(?![a-z])(?!(?<=[A-Z])[A-Z])|(?i:passw(?:or)?ds?|passphrase|pwd)(?![a-z])(?!(?<=[A-Z])[A-Z]))"
)
#: Words that say of a value next to them that it names or checks something.
NAMING_WORDS = r"(?i)(?<![a-z])(checksum|sha-?\d*|md5|digest|commit|revision|uuid|guid|etag|hash|fingerprint|build|version|isbn|doi|id)s?(?![a-z])"
#: A value (group 2) assigned or quoted right after a key word: to the closing quote, or to the space less closing marks.
VALUE = r"""(?<=")[^\s"]{8,}|(?<=')[^\s']{8,}|(?<=`)[^\s`]{8,}|(?<!["'`])[^\s"'`]\S{6,}[^\s"'`,;.)\]}>]"""
GIVEN = KEY_WORDS + r"""[^\s=:"'`]{0,40}["'`)\]]{0,3}\s*+(?:[:=]+>?\s*+[(\[{]*+["'`]?+|["'`])(""" + VALUE + ")"
GIVEN_LAST = GIVEN + r"(?=\S*$)"
#: A password (group 1) in an address.
ADDRESS = r"://[^\s/:@]*:([^\s/]+)@"
#: Least characters of a value that is replaced wherever it stands; shorter ones only in their address.
SHORT = 8
HARMLESS_PATH = r"(?i)(test|example|sample|fixture|mock|docs?/|readme)"
#: Words of the dictionary, and their least and most letters.
DICTIONARY_WORDS = 200
DICTIONARY_LETTERS = (3, 8)
#: Labelled findings of each kind that the forest is fitted on, at the most.
FIT_ROWS = 4_000
TREES, DEPTH = 20, 6
CUTOFF = 0.5

FEATURES = [
    "length", "kind_changes", "case_changes", "digit_share", "capital_share", "distinct_share", "dictionary_share",
    "path_marks", "path_harmless", "key_near", "assigned", "quoted", "words_near", "mark_share", "in_address",
    "naming_near",
]


def dictionary(docs: DataFrame, most: int = DICTIONARY_WORDS) -> list[str]:
    """The most frequent words of all texts, of a few letters each, in order of length, then letters."""
    low, high = DICTIONARY_LETTERS
    words = docs.select(F.explode(F.split("text", SPACE)).alias("w")).where(F.length("w").between(low, high + 2))
    counted = words.groupBy("w").agg(F.count("*").alias("n"))
    plain = counted.select(F.regexp_extract(F.lower("w"), rf"^([a-z]{{{low},{high}}})[.,;]?$", 1).alias("w"), "n").where("w <> ''")
    top = plain.groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(most).collect()
    return sorted((r["w"] for r in top), key=lambda w: (-len(w), w))


def _features(value: Column, before: Column, word: Column, neighbours: list[Column], path: Column, known: str) -> list[Column]:
    size = F.length(value).cast("double")

    def count(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern)).cast("double")

    def flag(condition: Column) -> Column:
        return F.coalesce(condition.cast("double"), F.lit(0.0))

    near = F.concat_ws(" ", *neighbours[:2], before)
    left = F.length(F.regexp_replace(F.lower(value), known, ""))
    columns = [
        size,
        count("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])") / size,
        count("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / size,
        count("[0-9]") / size,
        count("[A-Z]") / size,
        F.size(F.array_distinct(F.split(value, ""))) / size,
        1 - left / size,
        count("[/_-]") / size,
        flag(path.rlike(HARMLESS_PATH)),
        flag(near.rlike(KEY_WORDS)),
        flag(near.rlike(r"[=:]\W*$")),
        flag(before.rlike("[\"'`]$")),
        sum((flag(F.lower(n).rlike(rf"^(?:{known})\W?$")) for n in neighbours), F.lit(0.0)),
        count("[^A-Za-z0-9+/_=-]") / size,
        flag(before.rlike("://[^/:@]*:$")),
        flag(near.rlike(NAMING_WORDS)),
    ]
    return [c.cast("double").alias(n) for c, n in zip(columns, FEATURES, strict=True)]


def with_words(docs: DataFrame) -> DataFrame:
    """Add `__words`, the words of the texts that hold a candidate: split once for all that looks at them."""
    text = F.col("text")
    holds = text.rlike(CANDIDATE) | text.rlike(GIVEN) | text.rlike(ADDRESS)
    return without(docs, ["__words"]).withColumn("__words", F.when(holds, F.split("text", SPACE)))


def findings(known: list[str], path: str | None = None) -> Column:
    """The candidates in the column `__words`: array of (word, part, value, features). The words are bound once, not split anew for each."""
    return F.get(F.transform(F.array(F.col("__words")), lambda words: _of_words(words, known, path)), F.lit(0))


def _of_words(words: Column, known: list[str], path: str | None) -> Column:
    pattern = f"(?:{'|'.join(known)})" if known else "(?!)"
    where = F.col(path).cast("string") if path else F.lit(None).cast("string")

    def of_word(w: Column, i: Column) -> Column:
        def neighbour(k: int) -> Column:
            return F.get(words, i + F.lit(k))

        around = [neighbour(-2), neighbour(-1), neighbour(1)]

        runs = F.regexp_extract_all(w, F.lit(CANDIDATE), F.lit(0))

        def run(v: Column) -> Column:
            return F.struct(v.alias("v"), F.call_function("substring_index", w, v, F.lit(1)).alias("before"))

        def given(m: Column) -> Column:
            v = F.regexp_extract(m, GIVEN + "$", 2)
            return F.struct(v.alias("v"), F.substring(m, F.lit(1), F.length(m) - F.length(v)).alias("before"))

        def in_address(m: Column) -> Column:
            v = F.regexp_extract(m, ADDRESS, 1)
            return F.struct(v.alias("v"), F.substring(m, F.lit(1), F.length(m) - F.length(v) - 1).alias("before"))

        def of_value(x: Column, k: Column) -> Column:
            return F.struct(i.cast("int").alias("word"), k.cast("int").alias("part"), x["v"].alias("value"), F.struct(*_features(x["v"], x["before"], w, around, where, pattern)).alias("f"))

        more = F.concat(
            F.transform(F.regexp_extract_all(with_two(w, i), F.lit(GIVEN_LAST), F.lit(0)), given),
            F.transform(F.regexp_extract_all(w, F.lit(ADDRESS), F.lit(0)), in_address),
        )
        return F.transform(F.concat(F.transform(runs, run), F.filter(more, lambda x: ~F.array_contains(runs, x["v"]))), of_value)

    def with_two(w: Column, i: Column) -> Column:
        return F.concat_ws(" ", F.get(words, i - F.lit(2)), F.get(words, i - F.lit(1)), w)

    def holds(x: Column) -> Column:
        w = x["w"]
        return w.rlike(CANDIDATE) | ((F.length(w) >= SHORT) & with_two(w, x["i"]).rlike(GIVEN_LAST)) | (w.contains("@") & w.rlike(ADDRESS))

    numbered = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), holds)
    return F.flatten(F.transform(numbered, lambda x: of_word(x["w"], x["i"])))


def weak_labels(f: Column) -> Column:
    """1 for a mixed value that a key word is assigned and for a password in an address, 0 for one of letters or digits
    only or made of dictionary words, one next to a word that names or checks (and to no key word), or a plain short word
    after a key word; else null."""
    mixed = (f["digit_share"] >= 0.1) & (f["digit_share"] < 1) & (f["kind_changes"] >= 0.05) & (f["length"] >= 20)
    named = (f["key_near"] == 1) & (f["assigned"] == 1)
    plain = (f["digit_share"] == 0) | (f["digit_share"] == 1) | ((f["dictionary_share"] >= 0.5) & ~named)
    given = (f["length"] < 20) & (f["key_near"] == 1) & ((f["assigned"] == 1) | (f["quoted"] == 1))
    short = given & (f["digit_share"] > 0) & (f["digit_share"] < 1) & (f["kind_changes"] > 0)
    a_word = given & (f["digit_share"] == 0) & (f["mark_share"] == 0) & (f["path_marks"] == 0) & (f["case_changes"] * f["length"] <= 1)
    return F.when((mixed & named) | short | (f["in_address"] == 1), 1.0).when((plain & ~named & ~given) | a_word | ((f["naming_near"] == 1) & (f["key_near"] == 0)), 0.0)


def fit(found: DataFrame, most: int = FIT_ROWS, seed: int = 11):
    """A forest for findings with the columns `f` and `label` (null: not labelled); None without both labels.

    Of more than `most` of a label those are taken whose hash of features and, if there is one, of the column `place` is small.
    """
    place = [F.col(c) for c in ("place",) if c in found.columns]
    rows = found.where("label is not null").select("label", F.xxhash64(F.lit(seed), "f", *place).alias("__spread"), "f.*")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    space = 1 << 30
    spread = F.pmod(F.col("__spread"), F.lit(space))
    wanted = F.lit(False)
    for label, n in counts.items():
        wanted = wanted | ((F.col("label") == label) & (spread < int(space * min(1.0, most / n))))
    sample = stored(rows.where(wanted).repartition(1).sortWithinPartitions(*rows.columns).drop("__spread"))  # at most some 2 x `most` rows
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt").fit(vectors.select("label", "features"))


def tree_expression(text: str, f: Column) -> Column:
    """One tree of the forest, as its printed form says, over the features `f`."""
    lines = [line.strip() for line in text.splitlines() if re.match(r"\s*(If|Else|Predict)", line)]
    at = 0

    def node() -> Column:
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict"):
            return F.lit(float(line.split(":")[1]))
        index, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = node()
        at += 1  # the line of Else
        high = node()
        return F.when(f[FEATURES[int(index)]] <= float(bound), low).otherwise(high)

    return node()


def verdict(forest, f: Column) -> Column:
    """Share of trees that call a finding a secret; without a forest what the rule says."""
    if forest is None:
        return F.coalesce(weak_labels(f), F.lit(0.0))
    return sum((tree_expression(t.toDebugString, f) for t in forest.trees), F.lit(0.0)) / len(forest.trees)


def scan(docs: DataFrame, path: str | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """Add `findings`: array of (word, part, value, score, is_secret), null where a text has no candidate.

    `path` names the column with the path of a document, if any. `labelled` has rows with `f` (as `findings`
    makes it) and `label`; by default the clear ones of `docs` themselves.
    """
    known = dictionary(docs)
    docs = with_words(without(docs, ["findings"]))
    found = findings(known, path)
    if labelled is None:
        rows = docs.select(F.explode(found).alias("x")).select("x.f", F.xxhash64("x.value", "x.word", "x.part").alias("place")).withColumn("label", weak_labels(F.col("f")))
        labelled = stored(rows.where("label is not null"))
    forest = fit(labelled)

    def judged(x: Column) -> Column:
        return F.struct(x["word"].alias("word"), x["part"].alias("part"), x["value"].alias("value"), verdict(forest, x["f"]).alias("score"))

    def decided(x: Column) -> Column:
        return F.struct(x["word"].alias("word"), x["part"].alias("part"), x["value"].alias("value"), x["score"].alias("score"), (x["score"] >= CUTOFF).alias("is_secret"))

    return docs.withColumn("findings", F.transform(F.transform(found, judged), decided)).drop("__words")


def secrets(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each candidate: doc_id, word, part, length, digest, score, is_secret. Values are not shown."""
    rows = scan(docs, path).select("doc_id", F.explode("findings").alias("x"))
    return rows.select(
        "doc_id", "x.word", "x.part", F.length("x.value").cast("bigint").alias("length"), F.sha2("x.value", 256).alias("digest"), "x.score", "x.is_secret"
    )


def redact(docs: DataFrame, path: str | None = None, mark: str = "[secret]") -> DataFrame:
    """The documents with each secret in `text` replaced by `mark`; a column n_chars follows the new text."""
    columns = docs.columns
    scanned = scan(docs, path)
    values = F.array_distinct(F.transform(F.filter("findings", lambda x: x["is_secret"]), lambda x: x["value"]))

    def replaced(text: Column, v: Column) -> Column:
        inside = F.replace(text, F.concat(F.lit(":"), v, F.lit("@")), F.lit(f":{mark}@"))
        return F.when(F.length(v) < SHORT, inside).otherwise(F.replace(text, v, F.lit(mark)))

    longest_first = F.array_sort(values, lambda a, b: F.length(b) - F.length(a))
    cleaned = F.aggregate(longest_first, F.col("text"), replaced)
    has = F.size(values) > 0
    changed = scanned.withColumn("__clean", F.when(has, cleaned))
    out = {"text": F.coalesce("__clean", "text")}
    for c in columns:
        if c.lower() == "n_chars":
            out[c] = F.when(F.col("__clean").isNotNull(), F.length("__clean").cast(docs.schema[c].dataType)).otherwise(F.col(c))
    return changed.withColumns(out).select(*[F.col(f"`{c}`") for c in columns])
