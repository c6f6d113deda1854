"""Benchmark decontamination by greedy string tiling.

Windows of a few words that a document shares with an item are seeds. For items with enough of them,
tiles are marked greedily: the longest match of unmarked words first, found by running Karp-Rabin hashes at
falling lengths and compared word by word; the share of the item's words in tiles is its coverage. Tiles may
lie in any order, so reordered passages count in full. The hash of a window of any length is a difference of two sums, so a length
is tried in one pass over the words that are in seeds, and the next length is found by bisection: repeated words cost no more than others.

Items are sent to the tasks in blocks of bounded size. A task goes over its documents once, tokenizes each once, and holds it
against all blocks, of which it keeps KEPT_BLOCKS unpacked; with more, documents wait until they fill DOCS_BYTES and each block is
unpacked once for all of them. So no document is shuffled, memory does not grow with either side, and blocks do not show in the result.

Words are runs of letters and digits in lower case. Defined cases: null and empty texts and items have no words
and match nothing; items shorter than a seed must occur whole; equal items (id and text) count once, and items
of one id with several texts count by the best of them; repeated documents are tested each; a null item id is
reported as null; result columns are named after those of the two tables.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.llm.common import BoundedCache, slices

#: Words of a seed, and of the shortest tile.
SEED_WORDS = 5
#: Share of an item's words in tiles from which a document is contaminated by it.
COVERAGE = 0.5
#: Bytes of item texts in one block.
BLOCK_BYTES = 8 << 20
#: Blocks that a worker keeps unpacked, and bytes of documents that go over the blocks together where there are more.
KEPT_BLOCKS = 4
DOCS_BYTES = 16 << 20
#: Bits of the filter that most windows of a document fail: 2 to this power.
FILTER_BITS = 23

_WORDS = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_hash = BoundedCache(xxhash.xxh3_64_intdigest, 200_000)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words."""
    words = _WORDS.findall((text or "").lower())
    return np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))


def windows(t: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of `width` words: sums of words times falling powers of an odd number."""
    n = len(t) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = t[:n].copy()
    for i in range(1, width):
        out = out * _ODD + t[i : i + n]
    return out


_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


class _Words:
    """Words some of which are marked, with running hashes of windows of every length."""

    def __init__(self, words: np.ndarray, free: np.ndarray):
        n = len(words)
        powers = np.cumprod(np.append(np.uint64(1), np.full(n, _ODD)))[:n]
        self.words, self.free = words, free
        self.sums = np.append(np.uint64(0), np.cumsum(words * powers))
        self.back = np.cumprod(np.append(np.uint64(1), np.full(n, _INVERSE)))[:n]

    def open_windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where `length` unmarked words stand in a row, and the hashes of these."""
        marked = np.append(0, np.cumsum(~self.free))
        at = np.flatnonzero(marked[length:] == marked[: len(marked) - length]) if length < len(marked) else np.zeros(0, np.int64)
        return at, (self.sums[at + length] - self.sums[at]) * self.back[at]

    def longest_run(self) -> int:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], self.free.astype(np.int8), [0]])))
        return int((edges[1::2] - edges[::2]).max(initial=0))


def _longest_common(item: _Words, doc: _Words, least: int, most: int) -> int:
    """The length of the longest unmarked match, from `least` to `most`; 0 if there is none."""
    best = 0
    while least <= most:
        length = (least + most + 1) // 2
        if np.isin(item.open_windows(length)[1], doc.open_windows(length)[1]).any():
            best, least = length, length + 1
        else:
            most = length - 1
    return best


def _mark(item: _Words, doc: _Words, length: int) -> list[tuple[int, int]]:
    """Mark the matches of this length, by place in the item, then in the document."""
    at, hashes = item.open_windows(length)
    places, own = doc.open_windows(length)
    common = np.isin(own, hashes)
    order = np.lexsort((places[common], own[common]))
    places, own = places[common][order], own[common][order]
    waiting = dict(zip(own[starts := np.flatnonzero(np.diff(own, prepend=~own[:1]))].tolist(), starts.tolist(), strict=True)) if len(own) else {}
    made, end = [], -1
    for i, h in zip(at.tolist(), hashes.tolist(), strict=True):
        k = waiting.get(h)
        if k is None or i < end:  # `end`: the words up to it have been marked just now
            continue
        while k < len(own) and own[k] == h:
            j = int(places[k])
            if doc.free[j : j + length].all() and (item.words[i : i + length] == doc.words[j : j + length]).all():
                item.free[i : i + length] = doc.free[j : j + length] = False
                made.append((i, j))
                end = i + length
                break
            k += 1
        waiting[h] = k
    return made


def tile(doc: np.ndarray, item: np.ndarray, width: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, place in the item, place in the document) of at least `width` words.

    The longest match whose words are all unmarked is marked next; equal lengths go by place in the item, then in the
    document. What is marked never gets longer matches, so lengths fall.
    """
    seeded = np.isin(windows(doc, width), windows(item, width))
    if not seeded.any():
        return []
    cover = np.zeros(len(doc) + 1, np.int64)
    cover[: len(seeded)] += seeded
    cover[width : width + len(seeded)] -= seeded
    # only words in seeds can be in tiles; between runs of them stands a marked place
    places = np.flatnonzero(np.cumsum(cover)[:-1])
    places = np.insert(places, np.flatnonzero(np.diff(places, prepend=places[0]) > 1), -1)
    held = _Words(np.where(places >= 0, doc[places], np.uint64(0)), places >= 0)
    own = _Words(item, np.ones(len(item), bool))
    tiles, most = [], min(own.longest_run(), held.longest_run())
    while length := _longest_common(own, held, width, most):
        tiles += [(length, i, int(places[j])) for i, j in _mark(own, held, length)]
        most = min(length - 1, own.longest_run(), held.longest_run())
    return tiles


class Block:
    """Items of one block: their words, and their seeds in order of hash."""

    def __init__(self, items: list[tuple[object, str]], width: int = SEED_WORDS):
        self.width = width
        self.ids = [i for i, _ in items]
        self.words = [tokens(t) for _, t in items]
        seeds, owners, places = [], [], []
        self.short: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            if 0 < len(w) < width:
                self.short.setdefault(len(w), []).append(k)
            s = windows(w, width)
            seeds.append(s)
            owners.append(np.full(len(s), k))
            places.append(np.arange(len(s)))
        self.seeds = np.concatenate([*seeds, np.zeros(0, np.uint64)])
        order = np.argsort(self.seeds, kind="stable")
        self.seeds = self.seeds[order]
        self.owners = np.concatenate([*owners, np.zeros(0, np.int64)])[order].astype(np.int64)
        self.places = np.concatenate([*places, np.zeros(0, np.int64)])[order].astype(np.int64)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._slot(self.seeds)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * _ODD) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def hits(self, doc: np.ndarray, coverage: float) -> list[tuple[int, float, int, int]]:
        """(item, coverage, tiles, longest tile) of the items whose words the document covers enough."""
        found = []
        for n, owners in self.short.items():
            if len(doc) >= n:
                own = set(windows(doc, n).tolist())
                found += [(k, 1.0, 1, n) for k in owners if int(windows(self.words[k], n)[0]) in own]
        h = windows(doc, self.width)
        if not len(h) or not len(self.seeds):
            return found
        h = np.unique(h[self.filter[self._slot(h)]])
        first, last = np.searchsorted(self.seeds, h, "left"), np.searchsorted(self.seeds, h, "right")
        spans = [np.arange(a, b) for a, b in zip(first, last, strict=True) if b > a]
        if not spans:
            return found
        at = np.concatenate(spans)
        owners, places = self.owners[at], self.places[at]
        for k in np.unique(owners).tolist():
            n = len(self.words[k])
            covered = np.zeros(n + 1, np.int64)
            p = places[owners == k]
            np.add.at(covered, p, 1)
            np.add.at(covered, p + self.width, -1)
            if (np.cumsum(covered)[:n] > 0).sum() < coverage * n:
                continue  # tiles cannot cover more than the seeds
            tiles = tile(doc, self.words[k], self.width)
            share = sum(t[0] for t in tiles) / n
            if share >= coverage:
                found.append((k, share, len(tiles), max(t[0] for t in tiles)))
        return found


class _Held:
    """A broadcast block of items with a name of its own, so that workers can tell blocks apart."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, (id(broadcast), broadcast._jbroadcast.id())

    def items(self) -> list[tuple[object, str]]:
        items = self.broadcast.value
        vars(self.broadcast).pop("_value", None)  # it stays in the worker's file, not in its memory
        return items


def blocks(benchmark: DataFrame, block_bytes: int | None = None) -> list[_Held]:
    """The items in broadcast blocks of about `block_bytes` (BLOCK_BYTES); one block is on the driver at a time."""
    items = benchmark.select("item_id", "text").where(F.length("text") > 0).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // (block_bytes or BLOCK_BYTES)))
    context = benchmark.sparkSession.sparkContext
    out = []
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        if rows:
            out.append(_Held(context.broadcast(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (str(r[0]), r[1])))))
    return out


_kept: dict = {}


def _load(held: _Held, width: int) -> Block:
    """The unpacked block; a worker keeps the last KEPT_BLOCKS."""
    key = (held.id, width)
    if key not in _kept:
        while len(_kept) >= KEPT_BLOCKS:
            del _kept[next(iter(_kept))]
        _kept[key] = Block(held.items(), width)
    return _kept[key]


def _judged(held: list[_Held], width: int, coverage: float, place: int):
    """A generator over Arrow batches: each part with its rows' hits (item id, coverage, tiles, longest tile), the best of each item, by item."""

    def hits(part: pa.RecordBatch) -> list[list[tuple]]:
        words = [tokens(t) for t in part.column(place).to_pylist()]
        best: list[dict] = [{} for _ in words]
        for h in held:
            block = _load(h, width)
            for own, w in zip(best, words, strict=True):
                for k, c, n, most in block.hits(w, coverage):
                    item, score = block.ids[k], (c, -n, most)
                    if item not in own or score > own[item]:
                        own[item] = score
        return [[(item, c, -n, most) for item, (c, n, most) in sorted(own.items(), key=lambda x: str(x[0]))] for own in best]

    def run(batches):
        if len(held) <= KEPT_BLOCKS:
            for part in slices(batches):
                yield part, hits(part)
            return
        waiting, size = [], 0
        for part in slices(batches):
            waiting.append(part)
            size += part.nbytes
            if size >= DOCS_BYTES:
                yield from together(waiting)
                waiting, size = [], 0
        if waiting:
            yield from together(waiting)

    def together(parts):
        for part in pa.Table.from_batches(parts).combine_chunks().to_batches():
            yield part, hits(part)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, width: int = SEED_WORDS) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles and longest_tile of each document and item whose coverage reaches the threshold."""
    source = docs.select("doc_id", "text")
    item_field = T.StructField("item_id", benchmark.schema["item_id"].dataType)
    fields = [T.StructField("coverage", T.DoubleType()), T.StructField("n_tiles", T.IntegerType()), T.StructField("longest_tile", T.IntegerType())]
    schema = T.StructType([source.schema["doc_id"], item_field, *fields])
    kinds = [benchmark.select("item_id").limit(0).toArrow().schema.field(0).type, pa.float64(), pa.int32(), pa.int32()]
    judged = _judged(blocks(benchmark), width, coverage, 1)

    def run(batches):
        for part, hits in judged(batches):
            rows = [i for i, found in enumerate(hits) for _ in found]
            if rows:
                columns = zip(*[h for found in hits for h in found], strict=True)
                made = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), *made], names=schema.names)

    return source.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, width: int = SEED_WORDS) -> DataFrame:
    """The documents that no item contaminates, with their columns as they were. Each row is judged by itself, without a join."""
    judged = _judged(blocks(benchmark), width, coverage, docs.columns.index("text"))

    def run(batches):
        for part, hits in judged(batches):
            yield part.filter(pa.array([not found for found in hits], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
