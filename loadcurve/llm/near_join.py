"""N-gram Jaccard join: documents whose sets of word shingles are alike, found by PartEnum signatures.

1. Each document gives the name of its set, a sketch of it, and its signatures (see `partenum`), packed by
   ranges of their values: 16 bytes each, signature and name, at any number of ranges. Equal sets near each other give
   their signatures once. A signature that more than RUN sets of one packet share is known to be common there: its members
   are dealt evenly, and its range gets one mark in their place, so that no range holds all owners of a frequent passage.
2. Each range is sorted. Up to RUN sets that share a signature become candidate pairs. A signature that more sets
   share, or that is marked, is common: its text is a passage that many have. A set that has fewer common signatures than its
   `slack` shares another one with every set it links to, so it needs no common ones. Only sets that are mostly
   made of common text are left; those that share a signature form candidate groups.
3. Sketches (counts of shingles by hash) bound the number of differing shingles from below and drop pairs that cannot link.
4. Candidate groups are joined exactly, on the whole sets. A group too large for one task is cut into blocks, and
   every two blocks meet in a task of their own. A group is left as soon as all its sets are linked.

No link is lost, and no text is compared with more than those of its candidate group; a group of B blocks is copied B
times and meets in B (B + 1) / 2 tasks. Nothing but counts reaches the driver.

Defined cases: null and empty texts have the empty set, which links with nothing; texts with fewer words than a shingle
are one shingle; copies (also repeated rows) are linked; a null doc_id is passed over when the smallest id is
taken, and is the component only where there is no other; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.llm.common import slices, stored, without
from loadcurve.llm.components import components
from loadcurve.llm.partenum import NEAR, class_of, fingerprint, shingles, signatures

#: Sets that share a signature and are paired with each other; beyond, the signature is common.
RUN = 5
#: Signatures in a range, and in a packet before it is sent.
RANGE, PACKET = 1_000_000, 400_000
#: Names of sets that a task remembers, so that copies near each other give their signatures once.
SEEN = 20_000
#: Bytes of text that give a signature, about: only the number of ranges depends on it.
BYTES_A_SIGNATURE = 8
#: Shingles of a block of a candidate group.
BLOCK = 2_000_000
#: Rows up to which a table of names is broadcast (16 bytes each).
BROADCAST_ROWS = 500_000

DOC, PAIR, COMMON = 0, 1, 2


def sketch(h: np.ndarray) -> bytes:
    """Numbers of shingles by leading bits of their hash, up to 15, two in a byte; a quarter to half as many as shingles."""
    bits = max(1, int(len(h) - 1).bit_length() - 2)
    counts = np.minimum(np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 15).astype(np.uint8)
    return (counts[::2] | (counts[1::2] << 4)).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound for the number of shingles that only one of two sets has. The finer sketch is summed to the coarser."""
    pair = []
    for s in (x, y):
        packed = np.frombuffer(s, np.uint8)
        counts = np.empty(2 * len(packed), np.int64)
        counts[::2], counts[1::2] = packed & 15, packed >> 4
        pair.append(counts)
    size = min(len(pair[0]), len(pair[1]))
    a, b = (np.minimum(c.reshape(size, -1).sum(axis=1), 15) for c in pair)
    return int(np.abs(a - b).sum())


def linked(shared: int | np.ndarray, n: int, p: int | np.ndarray):
    return NEAR[1] * shared >= NEAR[0] * (n + p - shared)


def may_link(n: int, p: int) -> bool:
    return NEAR[1] * min(n, p) >= NEAR[0] * max(n, p)


_SENT = "range int, doc_id bigint, key bigint, n bigint, set bigint, sketch binary, slacks array<int>, signatures binary, names binary, common boolean"
_FOUND = "kind int, doc_id bigint, key bigint, n bigint, a bigint, b bigint, sketch binary, slacks array<int>"
#: In place of a set's name: the signature is common in some packet.
MARK = np.iinfo(np.int64).min
#: Instances of a set, by class of their signatures.
CLASSES = 4


def _table(ddl: str, columns: dict, rows: int) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    fields = [part.split() for part in ddl.split(", ")]
    arrays = [pa.array(columns[n], kinds[k]) if n in columns else pa.nulls(rows, kinds[k]) for n, k in fields]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def _send(ranges: int):
    """Rows of documents, and packets of signatures with the names of the sets that own them."""

    def packet(made: list[tuple[np.ndarray, int]]):
        values = np.concatenate([s for s, _ in made])
        names = np.repeat(np.array([m[1] for m in made], np.int64), [len(s) for s, _ in made])
        order = np.argsort(values)
        values, names = values[order], names[order]
        starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        lengths = np.diff(np.append(starts, len(values)))
        many = lengths > RUN  # of one packet: the names are distinct
        common = np.repeat(many, lengths)
        if common.any():
            yield _table(_SENT, {"range": [ranges + int(names[0] % (32 * ranges))], "signatures": [values[common].tobytes()], "names": [names[common].tobytes()], "common": [True]}, 1)
            marks = values[starts[many]]
            values, names = np.append(values[~common], marks), np.append(names[~common], np.full(len(marks), MARK))
            order = np.argsort(values)
            values, names = values[order], names[order]
        place = ((values >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        edges = np.flatnonzero(np.diff(place, prepend=-1))
        parts = list(zip(edges, np.append(edges[1:], len(place)), strict=True))
        columns = {"signatures": [values[lo:hi].tobytes() for lo, hi in parts], "names": [names[lo:hi].tobytes() for lo, hi in parts]}
        yield _table(_SENT, {"range": place[edges], "common": [False] * len(parts), **columns}, len(parts))

    def run(batches):
        made: list[tuple] = []
        waiting = 0
        seen: set[int] = set()
        for batch in slices(batches):
            if len(seen) > SEEN:
                yield from packet(made) if made else ()
                made, waiting = [], 0
                seen.clear()
            names, sizes, sketches, slacks = [], [], [], []
            for text in batch.column(2).to_pylist():
                h = shingles(text)
                name = fingerprint(h)
                names.append(name)
                sizes.append(len(h))
                sketches.append(sketch(h) if len(h) else None)
                found = signatures(h)
                own = [-1] * CLASSES
                for _, instance, slack in found:
                    own[class_of(instance)] = slack
                slacks.append(own)
                if found and name not in seen:
                    seen.add(name)
                    for values, _, _ in found:
                        made.append((values, name))
                        waiting += len(values)
                    if waiting >= PACKET:
                        yield from packet(made)
                        made, waiting = [], 0
            # By row and finely: copies are not dealt together, and few ranges of signatures do not make few tasks.
            place = [ranges + k % (32 * ranges) for k in batch.column(1).to_pylist()]
            yield _table(_SENT, {"range": place, "doc_id": batch.column(0), "key": batch.column(1), "n": sizes, "set": names, "sketch": sketches, "slacks": slacks}, len(names))
        if made:
            yield from packet(made)

    return run


def _meet(batches):
    """Document rows as they are; candidate pairs; and the members of common signatures."""
    values, names = [], []
    for batch in batches:
        cols = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
        is_doc = pa.compute.is_valid(cols["set"])
        docs = batch.filter(is_doc)
        if docs.num_rows:
            own = {f: docs.column(i) for i, f in enumerate(docs.schema.names)}
            kept = {"kind": [DOC] * docs.num_rows, "a": own["set"], **{c: own[c] for c in ("doc_id", "key", "n", "sketch", "slacks")}}
            yield _table(_FOUND, kept, docs.num_rows)
        for row in batch.filter(pa.compute.invert(is_doc)).select(["signatures", "names", "common"]).to_pylist():
            part = np.frombuffer(row["signatures"], np.uint64), np.frombuffer(row["names"], np.int64)
            if row["common"]:
                yield _members(*part)
            else:
                values.append(part[0])
                names.append(part[1])
    if not values:
        return
    values, names = map(np.concatenate, (values, names))
    order = np.lexsort((names, values))
    values, names = values[order], names[order]
    own = np.ones(len(values), bool)
    own[1:] = (values[1:] != values[:-1]) | (names[1:] != names[:-1])  # copies in other batches
    values, names = values[own], names[own]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    lengths = np.diff(np.append(starts, len(values)))
    marked = names[starts] == MARK  # the least name
    pairs = []
    for length in range(2, RUN + 1):
        rows = starts[(lengths == length) & ~marked]
        for i in range(length):
            for j in range(i + 1, length):
                pairs.append(np.stack([names[rows + i], names[rows + j]], axis=1))
    pairs = np.unique(np.concatenate(pairs), axis=0)
    yield _table(_FOUND, {"kind": np.full(len(pairs), PAIR), "a": pairs[:, 0], "b": pairs[:, 1]}, len(pairs))
    common = np.repeat((lengths > RUN) | marked, lengths) & (names != MARK)
    if common.any():
        yield _members(values[common], names[common])


def _members(values: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
    return _table(_FOUND, {"kind": np.full(len(values), COMMON), "a": names, "b": values.astype(np.int64)}, len(values))


def _near_sketches(batches):
    for batch in batches:
        _, _, na, nb, x, y = (batch.column(i).to_pylist() for i in range(6))
        most = (NEAR[1] - NEAR[0], NEAR[1] + NEAR[0])
        keep = [may_link(n, p) and least_difference(s, t) <= (n + p) * most[0] // most[1] for n, p, s, t in zip(na, nb, x, y, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def link_group(sets: list[np.ndarray], group: np.ndarray) -> np.ndarray:
    """The root of each set (the place of the first set of its component); only sets of one `group` are compared.

    Sources are taken one after the other and counted against the sets not reached yet, by lists of the sets
    that hold each shingle; the lists are made anew when half of their sets have been reached.
    """
    root = np.arange(len(sets))
    for g in np.unique(group):
        members = np.flatnonzero(group == g)
        size = np.array([len(sets[m]) for m in members])
        if len(members) == 2:
            x, y = members
            if linked(np.intersect1d(sets[x], sets[y], assume_unique=True).size, *size):
                root[y] = x
            continue
        reached = np.zeros(len(members), bool)
        listed = None
        for first in range(len(members)):
            if reached[first]:
                continue
            reached[first] = True
            queue = [first]
            while queue and not reached.all():
                source = queue.pop()
                if listed is None or 2 * (~reached[listed]).sum() <= len(listed):
                    listed = np.flatnonzero(~reached)
                    elements = np.concatenate([sets[members[i]] for i in listed])
                    holders = np.repeat(listed, size[listed])
                    order = np.argsort(elements, kind="stable")
                    elements, holders = elements[order], holders[order]
                own = sets[members[source]]
                lo, hi = np.searchsorted(elements, own, "left"), np.searchsorted(elements, own, "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                shared = np.bincount(holders[at], minlength=len(members))
                near = np.flatnonzero(linked(shared, size[source], size) & ~reached & (shared > 0))
                reached[near] = True
                root[members[near]] = members[first]
                queue += near.tolist()
    return root


def _link(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.drop_duplicates(["group", "a"]).sort_values(["group", "a"])
    sets = [np.frombuffer(b, np.uint64) for b in pdf["shingles"]]
    root = link_group(sets, pdf["group"].to_numpy())
    names = pdf["a"].to_numpy()
    return pd.DataFrame({"a": names, "b": names[root]})


def _fits(df: DataFrame) -> DataFrame:
    """A stored table of names, broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _sets(batches):
    for batch in slices(batches):
        made = [shingles(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([fingerprint(h) for h in made], pa.int64()), pa.array([h.tobytes() for h in made], pa.binary())], names=["a", "shingles"])


def similar_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, key, n, set), and for the sets that have links (set, root): equal roots are one component."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("key").cast("bigint").alias("key"), "text")
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, int(total) // (BYTES_A_SIGNATURE * RANGE))
    found = stored(source.mapInArrow(_send(ranges), _SENT).repartition(ranges, "range").mapInArrow(_meet, _FOUND))

    members = found.where(F.col("kind") == DOC).select("doc_id", "key", "n", F.col("a").alias("set"), "sketch", "slacks")
    known = members.where("n > 0").select("set", "n", "sketch", "slacks").dropDuplicates(["set"])
    sketches = known.drop("slacks")
    pairs = found.where(F.col("kind") == PAIR).select("a", "b").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(sketches.toDF(side, f"n_{side}", f"sketch_{side}"), side)
    near = pairs.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_near_sketches, "a bigint, b bigint")

    # a copy of a set may stand in several packets, so its members are made distinct
    common = found.where(F.col("kind") == COMMON).select("a", F.col("b").alias("signature"), F.expr("cast(b & 3 as int)").alias("tag")).distinct()
    counts = common.groupBy("a", "tag").agg(F.count("*").alias("n"))
    dependent = counts.join(known.select(F.col("set").alias("a"), "slacks"), "a").where(F.col("n") > F.get("slacks", F.col("tag")))
    held = stored(common.join(dependent.select("a", "tag"), ["a", "tag"], "left_semi").select("a", "signature"))
    stars = held.join(held.groupBy("signature").agg(F.min("a").alias("b")), "signature").select("a", "b")

    groups = stored(components(near.unionAll(stars)).toDF("a", "group"))
    sizes = groups.join(members.where("n > 0").select(F.col("set").alias("a"), "n").dropDuplicates(["a"]), "a")
    blocks = sizes.groupBy("group").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"), F.sum("n").alias("total"))
    placed = stored(groups.join(blocks, "group"))
    whole = placed.agg(F.sum("total")).first()[0]
    if whole is None:
        return members.drop("sketch", "slacks"), spark.createDataFrame([], "set bigint, root bigint")
    shingle_total = blocks.agg(F.sum("total")).first()[0]
    bundles = max(1, int(shingle_total) // BLOCK)

    # One document of each set in a group is read again for the set itself.
    chosen = members.where("n > 0").join(_fits(placed.select(F.col("a").alias("set"))), "set", "left_semi")
    chosen = stored(chosen.groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key")).select("key").distinct())
    texts = source.join(_fits(chosen), "key", "left_semi").select("text")
    sets = texts.mapInArrow(_sets, "a bigint, shingles binary").join(_fits(placed), "a")
    block = F.pmod(F.xxhash64("a"), "blocks")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    meets = F.when(F.col("blocks") == 1, F.concat(F.lit("s"), F.pmod(F.xxhash64("group"), F.lit(bundles)).cast("string"))).otherwise(
        F.concat_ws("-", F.col("group").cast("string"), F.least("block", "other").cast("string"), F.greatest("block", "other").cast("string"))
    )
    dealt = sets.withColumn("block", block).withColumn("other", other).withColumn("meets", meets).select("meets", "group", "a", "shingles")
    edges = stored(dealt.groupBy("meets").applyInPandas(_link, "a bigint, b bigint"))
    return members.drop("sketch", "slacks"), stored(components(edges)).toDF("set", "root")


def near_duplicates(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; with `key`, a bigint column that names rows, also `key` and
    `root`, the name of the component (ids that repeat do not tell components apart)."""
    named = without(docs, ["key"] if key != "key" else [])
    named = named.withColumn("key", F.col(key) if key else F.xxhash64("doc_id", "text"))
    members, roots = similar_sets(named)
    least = members.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("id")).join(roots, "set", "left")
    least = least.withColumn("root", F.coalesce("root", "set"))
    smallest = least.groupBy("root").agg(F.min("id").alias("component_id"))
    of_set = least.join(smallest, "root").select("set", "root", "component_id")
    out = members.join(of_set, "set", "left")
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")]
    return out.select(*columns, *(["key", "root"] if key else []))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents less all but one of each component: the one of the smallest doc_id, of equal ids the smallest row hash.

    Rows without words have no component and all stay. Of rows that are alike in every column one stays.
    """
    columns = docs.columns
    keyed = docs.withColumn("__row", F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    found = near_duplicates(keyed.select("doc_id", "text", "__row"), key="__row").where("n_shingles > 0")
    found = stored(found)
    winner = found.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), F.col("key").alias("k"))).alias("w"))
    judged = found.join(winner, "root").select("key", (F.col("key") == F.col("w.k")).alias("stays"))
    judged = stored(judged.groupBy("key").agg(F.max("stays").alias("stays"), F.count("*").alias("n")))
    dropped = stored(judged.where("not stays").select(F.col("key").alias("__row")))
    repeated = stored(judged.where("stays and n > 1").select(F.col("key").alias("__row")))
    out = keyed.join(_fits(dropped), "__row", "left_anti")
    if repeated.count():
        again = out.join(_fits(repeated), "__row", "left_semi").dropDuplicates(["__row"])
        out = out.join(_fits(repeated), "__row", "left_anti").unionByName(again)
    return out.select(*[F.col(f"`{c}`") for c in columns])
