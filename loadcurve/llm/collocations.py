r"""Phrase collocations by stripes: each prefix keys an associative counter of the words that follow it.

A pass for each prefix length (0 to 4 words) turns the texts into stripes, `prefix -> {next word: count}`, one for each prefix of a
chunk of text; stripes of one prefix are merged element by element. The entry of no word (`""`) counts the places where the piece
ends or where no frequent phrase can follow, so that the sum of a stripe is the count of its prefix. One merged stripe thus
yields the extensions (its entries), the prefix total (its sum) and the subsumption maximum (its largest entry); the stripe of
the empty prefix yields the words and their total `n`.

A prefix of k words gets a stripe only if it may itself be frequent, and an entry only if the k words that end with the next word
may be, too: all other phrases are below the least count, whatever follows. "May be" is asked of a bit table of a fixed size
(`BITS`) that is made from the frequent phrases of the pass before; a false yes costs a row and changes no result. Stripes of very
frequent prefixes, which the same table marks, are dealt over `SLOTS` parts by a hash of the next word, so no task holds all
words that follow one word. The stripes of a chunk travel in one packet for each language and bucket of prefixes. Whole texts of all documents are counted, exactly, in 64 bits; scores are worked out in 38 digits.

Defined results: a null text counts as empty, a null language as `und`; repeated rows count each; a table without frequent
phrases gives no rows. Columns other than `lang` and `text` are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcurve.llm.common import release_caches, slices, stored

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
#: Text that is counted together in a task before its stripes are sent.
CHUNK_BYTES = 4 << 20
#: Bits of the table of frequent phrases, 8 MB however many there are; a second one of this size marks the hot ones.
BITS = 1 << 26
#: A prefix that makes up one of HOT_SHARE words or more (and HOT_LEAST in all) has its stripe dealt over SLOTS parts. There are at
#: most HOT_SHARE of them, however large the corpus.
HOT_SHARE, HOT_LEAST = 500, 1000
SLOTS = 64
#: Buckets of prefixes, for each shuffle partition of the session.
BUCKETS_EACH = 4
#: A packet's stripes, one a line: the prefix, its next words and their counts (both joined by spaces, which no word holds), divided by tabs.
PACKETS = "lang string, bucket int, stripes string"

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_FACTOR, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


class Words:
    """The words of some texts: their places in a dictionary, their text's number and their piece's number."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        kind = _KIND[data]
        inside, first = kind == 0, np.zeros(len(data) + 1, bool)
        first[ends] = True
        outside_before = np.concatenate([[True], ~inside[:-1]]) if len(data) else np.zeros(0, bool)
        outside_after = np.concatenate([~inside[1:], [True]]) if len(data) else np.zeros(0, bool)
        starts = np.flatnonzero(inside & (outside_before | first[:-1]))
        lengths = np.flatnonzero(inside & (outside_after | first[1:])) + 1 - starts
        self.piece = np.cumsum((kind == 2) | first[:-1], dtype=np.int64)[starts]
        self.doc = np.searchsorted(ends, starts, "right") - 1
        places = np.concatenate([[0], np.cumsum(lengths)])
        buffers = [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(_LOWER[data[inside]])]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
        self.word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.texts = coded.dictionary.cast(pa.large_string()).cast(pa.string())
        self.marks = word_marks(coded.dictionary.to_pylist())


def word_marks(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def follow(marks: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase followed by one more word, from the hashes of both; an empty phrase has the hash of its language."""
    with np.errstate(over="ignore"):
        mixed = (marks * _FACTOR) ^ word
        mixed = (mixed ^ (mixed >> _TURN)) * _FACTOR
    return mixed ^ (mixed >> _TURN)


def bit_places(marks: np.ndarray) -> list[np.ndarray]:
    """The two bits of each hash in a table of BITS bits."""
    return [(marks & np.uint64(BITS - 1)).astype(np.int64), ((marks >> np.uint64(32)) & np.uint64(BITS - 1)).astype(np.int64)]


def is_marked(table: np.ndarray, marks: np.ndarray) -> np.ndarray:
    one, two = bit_places(marks)
    held = lambda at: (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
    return (held(one) & held(two)).astype(bool)


def phrase_table(phrases: DataFrame, hot_from: int):
    """Broadcast bit tables (all, those of a count of `hot_from`) of the phrases (lang, phrase, f); None where there is no phrase.

    The words of the tables are joined by OR in Spark; at most BITS / 64 of them reach the driver.
    """

    def places(batches):
        for batch in batches:
            marks = word_marks([x.encode() for x in batch.column(0).to_pylist()])
            texts = [x.encode().split(b" ") for x in batch.column(1).to_pylist()]
            longest = max(map(len, texts), default=0)
            for k in range(longest):
                rows = np.array([i for i, t in enumerate(texts) if len(t) > k], np.int64)
                marks[rows] = follow(marks[rows], word_marks([texts[i][k] for i in rows]))
            hot = batch.column(2).to_numpy() >= hot_from
            for at in bit_places(marks):
                bit = np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(bit), pa.array(np.where(hot, bit, 0))], names=["place", "bits", "hot"])

    rows = phrases.select("lang", "phrase", "f").mapInArrow(places, "place bigint, bits bigint, hot bigint")
    rows = rows.groupBy("place").agg(F.bit_or("bits").alias("bits"), F.bit_or("hot").alias("hot")).toArrow()
    if not rows.num_rows:
        return None
    tables = np.zeros((2, BITS >> 6), np.uint64)
    at = rows["place"].to_numpy()
    tables[0, at], tables[1, at] = rows["bits"].to_numpy().view(np.uint64), rows["hot"].to_numpy().view(np.uint64)
    return phrases.sparkSession.sparkContext.broadcast(tables)


def chunk_packets(langs: pa.Array, texts: pa.Array, length: int, tables: np.ndarray | None, buckets: int) -> pa.RecordBatch:
    """The stripes of all prefixes of `length` words in these texts, in packets. `tables` as of `phrase_table`, for `length` words."""
    w = Words(texts)
    langs = langs.fill_null("und").dictionary_encode()
    lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[w.doc]
    places = max(0, len(w.word) - max(0, length - 1))  # where a prefix may start
    word, size = w.word, len(w.texts) + 1
    marks = word_marks([x.encode() for x in langs.dictionary.to_pylist()])[lang][:places]
    for k in range(length):
        marks = follow(marks, w.marks[word[k : k + places]])
    if length:
        good = (w.piece[:places] == w.piece[length - 1 :]) & is_marked(tables[0], marks)
    else:
        good = np.ones(places, bool)
    at = np.flatnonzero(good)
    if not len(at):
        return pa.RecordBatch.from_pylist([], schema=_PACKET_SCHEMA)
    # the next word, or none: the last number
    after = np.minimum(at + length, len(word) - 1)
    on = (at + length < len(word)) & (w.piece[at] == w.piece[after])
    if length:
        on &= np.append(good, False)[at + 1]
    following = np.where(on, word[after], size - 1)
    prefix = _prefix_numbers(lang[at], [word[at + k] for k in range(length)], size)
    pairs, counts = np.unique(prefix * size + following, return_counts=True)
    prefix_of, following = np.divmod(pairs, size)
    example = np.zeros(prefix_of[-1] + 1, np.int64)
    example[prefix[::-1]] = at[::-1]
    # parts of a stripe, and their bucket
    hot = is_marked(tables[1], marks[example]) if length else np.ones(len(example), bool)
    slot = np.where(hot[prefix_of], np.append(w.marks, np.uint64(0))[following] % np.uint64(SLOTS), np.uint64(0))
    bucket = (follow(marks[example][prefix_of], slot) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((prefix_of, bucket, lang[example][prefix_of]))
    prefix_of, following, bucket, counts = prefix_of[order], following[order], bucket[order], counts[order]
    words = pa.concat_arrays([w.texts, pa.array([""], pa.string())])
    stripe = _starts(prefix_of, bucket)
    start = example[prefix_of[stripe]]
    names = [words.take(pa.array(word[start + k])) for k in range(length)]
    prefixes = pc.binary_join_element_wise(*names, " ") if names else pa.array([""] * len(stripe), pa.string())
    joined = lambda values, starts, mark: pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), values), mark)
    lines = pc.binary_join_element_wise(
        prefixes, joined(words.take(pa.array(following)), stripe, " "), joined(pa.array(counts).cast(pa.string()), stripe, " "), "\t"
    )
    packet = _starts(lang[start], bucket[stripe])
    columns = [langs.dictionary.take(pa.array(lang[start[packet]])), pa.array(bucket[stripe[packet]].astype(np.int32)), joined(lines, packet, "\n")]
    return pa.RecordBatch.from_arrays(columns, schema=_PACKET_SCHEMA)


_PACKET_SCHEMA = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("stripes", pa.string())])


def _prefix_numbers(lang: np.ndarray, words: list[np.ndarray], size: int, room: int = 1 << 62) -> np.ndarray:
    """Numbers of the tuples (lang, words), in their order, gapless if there are words; sorted only where a product would leave `room`."""
    number, most = lang, int(lang.max()) + 1
    for i, word in enumerate(words):
        number, most = number * size + word, most * size
        if i == len(words) - 1 or most * size >= room:
            number = np.unique(number, return_inverse=True)[1]
            most = int(number.max()) + 1
    return number


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    changed = np.ones(len(columns[0]), bool)
    changed[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(changed)


def _entries(part: Column) -> Column:
    """The entries of a packet's line, given as its three parts: structs of prefix, next word and count."""
    pairs = F.arrays_zip(F.split(part[1], " ", -1).alias("next"), F.split(part[2], " ", -1).alias("f"))
    return F.transform(pairs, lambda e: F.struct(part[0].alias("prefix"), e["next"].alias("next"), e["f"].alias("f")))


def merged_stripes(docs: DataFrame, length: int, tables) -> DataFrame:
    """Stripes of all documents (in parts, if hot): lang, bucket, prefix, total, best (largest entry) and the entries of MIN_COUNT or more."""
    buckets = BUCKETS_EACH * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        release_caches()
        held, size = [], 0
        for part in slices(batches):
            held.append(part)
            size += part.nbytes
            if size >= CHUNK_BYTES:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    def counted(parts):
        whole = pa.Table.from_batches(parts).combine_chunks()
        lang, text = (c.cast(pa.large_string()).combine_chunks() for c in whole.columns)
        lang, text = (pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in (lang, text))
        return chunk_packets(lang.cast(pa.string()), text, length, None if tables is None else tables.value, buckets)

    packets = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, PACKETS).repartition("lang", "bucket")
    key = ["lang", "bucket", "prefix"]
    # lines are divided before the parts are used: an expression within a lambda is worked out for each element
    parts = F.transform(F.split("stripes", "\n", -1), lambda line: F.split(line, "\t", -1))
    packed = F.flatten(F.transform(parts, _entries))
    entries = packets.select("lang", "bucket", F.inline(packed))
    sums = entries.groupBy(*key, "next").agg(F.sum(F.col("f").cast("bigint")).alias("f"))
    extends = F.col("next") != ""
    return sums.groupBy(*key).agg(
        F.sum("f").alias("total"), F.max(F.when(extends, F.col("f"))).alias("best"),
        F.collect_list(F.when(extends & (F.col("f") >= MIN_COUNT), F.struct("next", "f"))).alias("entries"),
    )


def _stored_whole(df: DataFrame) -> DataFrame:
    """As `stored`, in files of full size: what is left of the many tasks of a merge is little, and each file that Spark writes costs its
    executor a forked process and a task of every later reader."""
    return stored(df.hint("rebalance"))


def extensions(stripes: DataFrame) -> DataFrame:
    """The frequent phrases that stripes hold: lang, phrase, f."""
    e = stripes.select("lang", "prefix", F.inline("entries"))
    return e.select("lang", F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next")).alias("phrase"), "f")


def all_stripes(docs: DataFrame) -> list[DataFrame]:
    """Merged stripes by prefix length, from 0 words on, as stored tables; ends where no phrase is frequent."""
    made, tables = [], None
    for length in range(MAX_WORDS):
        made.append(_stored_whole(merged_stripes(docs, length, tables)))
        if not length:
            words = made[0].agg(F.sum("total")).first()[0] or 0
        tables = phrase_table(extensions(made[-1]), max(HOT_LEAST, words // HOT_SHARE))
        if tables is None:
            break
    return made


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score and the chosen cut (words of the first part)."""
    stripes = all_stripes(docs)
    n = stripes[0].groupBy("lang").agg(F.sum("total").alias("n"))
    union = lambda frames: reduce(DataFrame.unionAll, frames)
    count = lambda c: F.size(F.split(c, " ", -1))
    none = stripes[0].limit(0)
    found = union([extensions(s) for s in stripes[1:]] or [extensions(none)])
    found = _stored_whole(found.select("lang", "phrase", F.col("f").alias("a"), count("phrase").alias("words")))
    # counts of the phrases of 1 to 4 words, each with its largest extension to the right
    totals = union(stripes[1:] or [none]).groupBy("lang", F.col("prefix").alias("part")).agg(F.sum("total").alias("f"), F.max("best").alias("right"))
    totals = _stored_whole(totals.where(F.col("f") >= MIN_COUNT))
    left = found.groupBy("lang", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase")).agg(F.max("a").alias("left"))
    right = totals.select("lang", F.col("part").alias("phrase"), "right")
    kept = (
        found.join(left, ["lang", "phrase"], "left").join(right, ["lang", "phrase"], "left")
        .where((F.coalesce("left", F.lit(0)) < F.col("a")) & (F.coalesce("right", F.lit(0)) < F.col("a")))
    )
    first = F.expr("substring_index(phrase, ' ', k)")
    cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": first, "rest": F.expr("substring(phrase, length(substring_index(phrase, ' ', k)) + 2)")})
    side = lambda c, name: totals.select("lang", F.col("part").alias(c), F.col("f").alias(name))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).join(n, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"__over": F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), "__under": wide("l") * wide("r")})
    cuts = cuts.withColumn("score", F.expr("__over div __under"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.select("lang", "phrase", "a", "n", "best.*").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score", F.col("k").cast("bigint").alias("cut"))
