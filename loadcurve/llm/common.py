"""Shared pieces of the operators: batches of rows through Arrow, bounded labelled samples, word helpers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.session import scratch_path

#: Remainders of crc32(doc_id as text) by this number; remainder 0 is never learned from.
FOLDS = 5
_HASH_SPACE = 1 << 31
#: Rows whose texts a worker unpacks at a time.
SLICE_ROWS = 512


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that is kept for testing. A null id counts as empty text, which is in that fold."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS == 0


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The frame less columns of these names in any case: a result column replaces an input column of its name."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def slices(batches, rows: int = SLICE_ROWS):
    """Arrow batches in parts of a few rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def annotate(df: DataFrame, needs: Sequence[str], fields: Sequence[T.StructField], kernel: Callable, keep: Sequence[str]) -> DataFrame:
    """The columns `keep`, and the new columns that `kernel` makes of the columns `needs`, one Arrow batch at a time.

    `kernel` gets one list of values for each of `needs` and returns one array for each of `fields`.
    """
    names = list(dict.fromkeys([*keep, *needs]))
    source = df.select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType([*[source.schema[c] for c in keep], *fields])
    kept = [names.index(c) for c in keep]
    read = [names.index(c) for c in needs]
    out_names = [*keep, *[f.name for f in fields]]
    kinds = [_ARROW[f.dataType.simpleString()] for f in fields]

    def run(batches):
        for batch in slices(batches):
            made = kernel(*[batch.column(i).to_pylist() for i in read])
            arrays = [pa.array(a, type=k) for a, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *arrays], names=out_names)

    return source.mapInArrow(run, schema)


_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
    "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()), "binary": pa.binary(),
}


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: worked out once, and read again by all that follows and by tasks that run anew."""
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash_share(key: Sequence[str], share: float, seed: int) -> Column:
    """True for about this share of the keys, the same ones in every run."""
    bound = min(_HASH_SPACE, int(share * _HASH_SPACE))
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in key]), F.lit(_HASH_SPACE)) < bound


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, seed: int = 17) -> DataFrame:
    """Rows of `docs` with their label as column `__label`: of about `most` ids at the most, chosen by a hash of the id.
    Callers limit the rows, should ids repeat.

    Only ids outside the held-out fold and labels that are not null count. Labels are one per id (the
    largest, where they repeat), and fewer than `most` in all, so that they are broadcast and no text is shuffled.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("__label"))
    )
    share = most / max(1, known.count())
    chosen = known.where(hash_share(["doc_id"], share, seed)) if share < 1 else known
    return without(docs, ["__label"]).join(F.broadcast(chosen.limit(2 * most)), "doc_id")


def split_words(text: str) -> list[bytes]:
    r"""Words `[^\x20\x09-\x0D]+` as UTF-8; bytes.split() divides at just these six characters."""
    return text.encode().split()


def release_caches() -> None:
    """Empty what the operator before has left in this worker; for operators without a cache."""
    if BoundedCache._filled is not None:
        BoundedCache._filled.clear()
        BoundedCache._filled = None


def dense_ids(words: Sequence) -> np.ndarray:
    """Equal words get equal numbers, from 0 without gaps."""
    number = dict(zip(dict.fromkeys(words), range(len(words)), strict=False))
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


class BoundedCache(dict):
    """Values by key, worked out when first asked for; emptied when it holds too many.

    A worker runs the tasks of one operator after another: when another cache of this kind is filled, the one
    filled before is emptied, so that a worker holds one at a time.
    """

    _filled: BoundedCache | None = None

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self._make, self._most = make, most

    def __missing__(self, key):
        last = BoundedCache._filled
        if last is not self:
            if last is not None:
                last.clear()
            BoundedCache._filled = self
        if len(self) >= self._most:
            self.clear()
        value = self[key] = self._make(key)
        return value


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """A class for each code point: 1 upper-case, 2 other letter, 3 digit, 4 space that ends a word, 5 symbol of
    the base rules, 6 ! or ?, 7 other ASCII mark, 0 all else."""
    table = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            table[i] = 1 if c.isupper() else 2
        elif c.isdigit():
            table[i] = 3
    marks = [i for i in range(33, 127) if not chr(i).isalnum()]
    table[marks] = 7
    table[[9, 10, 11, 12, 13, 32]] = 4
    table[[ord(c) for c in "#*$%&|<>"]] = 5
    table[[ord(c) for c in "!?"]] = 6
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")
