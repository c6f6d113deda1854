"""Best-fit packing of tokenized documents into sequences by large-item matching.

A document is its byte-level BPE ids and an end id. One longer than a sequence is cut, its first piece
taking what is over; full pieces are sequences of their own. Of the rest, pieces above a third of the
capacity fit at most twice into a sequence, so they are paired greedily (each with the largest that
still fits beside it), and smaller pieces best-fit the gaps, in falling order of length. The plan needs
only the number of pieces of each length, at most `capacity` numbers at any input size. Pieces then
find their place by their rank among pieces of equal length.

Defined cases: null and empty texts hold the end id alone; equal rows are packed each; equal lengths are
ranked by stored row number; an empty table gives no rows; result columns replace input columns of the same name.
"""

from __future__ import annotations

import base64
import json
import struct
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from loadcurve.llm.common import BoundedCache, slices, stored, without

CAPACITY = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k"
#: Chunks of text whose ids a worker keeps.
CACHED_CHUNKS = 300_000
#: Rows of one block of the ranking: 2 to this power.
BLOCK_BITS = 12


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY):
    """A function from text to its ids as little-endian unsigned 32-bit bytes.

    The ids are those of the tokenizer file of this name. Its ranks are also given for the quicker of two
    public libraries, which is used; texts that hold the name of a special token take the tokenizer file itself.
    A space between two characters that are no white space always begins a token, so text is cut there
    and chunks are looked up; texts with other spacing are encoded whole.
    """
    import public_tokenizers
    import regex
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    quick = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    file = public_tokenizers.path(f"{vocabulary}.json")
    with open(file, "rb") as described:
        specials = [t["content"] for t in json.load(described)["added_tokens"]]
    loaded: list = []  # the tokenizer itself, once a text needs it

    def full(text: str) -> list[int]:
        if not loaded:
            loaded.append(Tokenizer.from_file(file))
        return loaded[0].encode(text, add_special_tokens=False).ids

    unusual = regex.compile(r"[^\S \n]|  | \n|\n ")

    def whole(text: str) -> bytes:
        return quick.encode_to_numpy(text).astype("<u4").tobytes()

    def short(chunk: str) -> bytes:
        ids = quick.encode_ordinary(" " + chunk)
        return struct.pack(f"<{len(ids)}I", *ids)

    chunks = BoundedCache(short, CACHED_CHUNKS)

    def encode(text: str) -> bytes:
        if any(s in text for s in specials):
            return np.array(full(text), "<u4").tobytes()
        if unusual.search(text) or text.startswith(" ") or text.endswith(" "):
            return whole(text)
        first, *rest = text.split(" ")
        return whole(first) + b"".join(map(chunks.__getitem__, rest))

    return encode


def pieces_of(ids: bytes, capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, bytes]]:
    """(piece, start, length, ids) of one document; the first piece is the shorter one."""
    n = len(ids) // 4
    start = 0
    length = n % capacity or capacity
    piece = 0
    while start < n:
        yield piece, start, length, ids[4 * start : 4 * (start + length)]
        start, piece, length = start + length, piece + 1, capacity


def tokenize(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, and with `with_ids` the ids as bytes."""
    fields = "piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    source = docs.select("doc_id", "text")
    schema = T.StructType([source.schema["doc_id"], *T.StructType.fromDDL(fields)])
    names = schema.names
    end = END_ID.to_bytes(4, "little")

    def run(batches):
        encode = encoder(vocabulary)
        for batch in slices(batches):
            source_rows, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for piece, start, length, ids in pieces_of(encode(text or "") + end, capacity):
                    source_rows.append(i)
                    rows.append((piece, start, length, zlib.crc32(ids), *([ids] * with_ids)))
            if rows:
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                made = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source_rows)), *made], names=names)

    return source.mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences to fill, as (lengths in order, number of such sequences), from the number of pieces of each length."""
    left = {s: c for s, c in sorted(counts.items()) if c}
    out: list[tuple[tuple[int, ...], int]] = []
    if left.get(capacity):
        out.append(((capacity,), left.pop(capacity)))
    open_bins: dict[int, list[list]] = {}  # by gap: [lengths, number]
    gaps: list[int] = []

    def put(lengths, number):
        gap = capacity - sum(lengths)
        if gap not in open_bins:
            open_bins[gap] = []
            insort(gaps, gap)
        open_bins[gap].append([lengths, number])

    large = [s for s in left if 3 * s > capacity]
    while large:
        s = large[-1]
        partner = bisect_right(large, capacity - s) - 1
        if partner < 0:
            put((s,), left.pop(s))
        elif large[partner] == s:
            pairs, single = divmod(left.pop(s), 2)
            if pairs:
                put((s, s), pairs)
            if single and partner:  # one is over: it takes the next smaller
                p = large[partner - 1]
                put((s, p), 1)
                left[p] -= 1
            elif single:
                put((s,), 1)
        else:
            p = large[partner]
            number = min(left[s], left[p])
            put((s, p), number)
            left[s] -= number
            left[p] -= number
        large = [x for x in large if left.get(x)]
    for s in sorted((x for x in left if left[x]), reverse=True):
        number = left[s]
        while number:
            at = bisect_right(gaps, s - 1)  # the smallest gap that holds it
            if at == len(gaps):
                each = capacity // s
                bins, over = divmod(number, each)
                if bins:
                    put((s,) * each, bins)
                if over:
                    put((s,) * over, 1)
                break
            gap = gaps[at]
            lengths, bins = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap]
                gaps.pop(at)
            each = min(gap // s, number)
            used = min(bins, number // each)
            put(lengths + (s,) * each, used)
            number -= used * each
            if bins > used:
                put(lengths, bins - used)
    return out + [(tuple(lengths), number) for held in open_bins.values() for lengths, number in held]


def places(sequences: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of ranks: (length, first rank, rank after the last, first sequence, offset, pieces of it in each sequence)."""
    ranks: dict[int, int] = {}
    rows = []
    first = 0
    for lengths, number in sequences:
        offset = 0
        for s in lengths:
            begin = ranks.get(s, 0)
            rows.append((s, begin, begin + number, first, offset))
            ranks[s] = begin + number
            offset += s
        first += number
    return rows


def ranked(pieces: DataFrame, by: str) -> DataFrame:
    """Add `__rank`, from 0 without gaps among rows of equal `by`. Blocks of stored rows are counted, then ranked each."""
    rows = stored(pieces.withColumn("__row", F.monotonically_increasing_id())).withColumn("__block", F.shiftright("__row", BLOCK_BITS))
    before = Window.partitionBy(by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(by, "__block").agg(F.count("*").alias("__n"))
    starts = counts.select(by, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(by, "__block").orderBy("__row")) - 1
    return rows.withColumn("__inside", inside).join(starts, [by, "__block"]).withColumn("__rank", F.col("__before") + F.col("__inside")).drop("__block", "__before", "__inside")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add `sequence_id` and `offset` to pieces with a `length` of 1 to `capacity`."""
    kept = without(pieces, ["sequence_id", "offset"])
    rows = ranked(kept, "length").drop("__row")
    counted = rows.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    table = places(plan({r["length"]: r["n"] for r in counted}, capacity))
    runs: dict[int, list[tuple]] = {}
    for s, *rest in table:
        runs.setdefault(s, []).append(tuple(rest))
    spark = pieces.sparkSession
    lookup = spark.createDataFrame(
        [(s, [r[1] for r in v], [r[0] for r in v], [r[2] for r in v], [r[3] for r in v]) for s, v in runs.items()],
        "length bigint, __ends array<bigint>, __begins array<bigint>, __firsts array<bigint>, __offsets array<bigint>",
    )
    # The number of run ends at or before the rank is the index of its run.
    at = F.size(F.filter("__ends", lambda e: e <= F.col("__rank")))
    placed = rows.join(F.broadcast(lookup), "length").withColumn("__at", at)
    return placed.select(
        *kept.columns,
        (F.get("__firsts", F.col("__at")) + F.col("__rank") - F.get("__begins", F.col("__at"))).alias("sequence_id"),
        F.get("__offsets", F.col("__at")).alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack whole documents."""
    return pack(tokenize(docs, capacity, with_ids), capacity)
