"""Signatures of the PartEnum scheme for sets of word shingles: the part of the join that sees one document.

Two sets link at a similarity of NEAR or more. With n and p elements they then differ in at most (n + p) / 7.
Sets are dealt to bands of size; an instance of the scheme handles the pairs whose smaller set is in one
band, and so whose larger set is in that band or the next.

In an instance the domain of shingles is partitioned by hash into n1 first-level parts of n2 second-level parts.
For each first-level part every choice of `chosen` of its second-level parts gives a signature, the hash of the
elements in these parts. An element that only one of two sets has spoils at most c = C(n2 - 1, chosen - 1)
signatures, so two sets that differ in d elements share at least Q - c * d of the Q signatures of either that
have an element. `slack` is what is left of this for the largest d that a set can meet in the instance: in that of
its own band it may be the smaller of a pair, with a partner of up to 4/3 of its size.
Where slack is not negative, one shared signature is certain, and `slack` more are; sets without it also give a
signature for each element, in an instance of their own, where the same count holds.

The two lowest bits of a signature are the class of its instance: the parity of the band, and whether it is of elements. Of the
up to four instances that a set takes part in, the class tells which one a signature is of, so it travels as bare 8 bytes.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import xxhash

from loadcurve.llm.common import BoundedCache

WORDS = 5
#: Fixed by the contract: linked when 100 * intersection >= 75 * union.
NEAR = (75, 100)
#: Second-level parts, and how many of them a signature takes.
SECOND, CHOSEN = 2, 1
#: Parts for each element of the largest set of a band, and parts besides.
PARTS_SHARE, PARTS_MORE = 0.37, 3

_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_SHIFT, _HALF = np.uint64(33), np.uint64(32)
_word = BoundedCache(xxhash.xxh3_64_intdigest, 200_000)


def _bands() -> np.ndarray:
    """Largest sizes of the bands: each is 4/3 of the one before, so that a set's partners lie in its band or a neighbour's."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * NEAR[1] // NEAR[0]))
    return np.array(out)


BANDS = _bands()


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _SHIFT)) * _M1
    x = (x ^ (x >> _SHIFT)) * _M2
    return x ^ (x >> _SHIFT)


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct word shingles in rising order: A-Z in lower case, words divided by ASCII white space."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_word.__getitem__, words), np.uint64, n)
    width = min(n, WORDS)
    h = w[: n - width + 1].copy()
    for i in range(1, width):
        h = h * _M3 + w[i : i + n - width + 1]
    return np.unique(mix(h + np.uint64(width)))


def fingerprint(h: np.ndarray) -> int:
    """A signed 64-bit name of the set; equal sets have equal names."""
    with np.errstate(over="ignore"):
        total = mix(h ^ _M3).sum(dtype=np.uint64) + np.uint64(len(h)) * _M1
        return int(mix(np.array([total]))[0].astype(np.int64))


def class_of(instance: int) -> int:
    """0 to 3: differs between the instances of one set, and is the same for all sets of an instance."""
    return (instance & 1) + 2 * (instance >= 1 << 8)


def _classed(values: np.ndarray, instance: int) -> np.ndarray:
    return (values & ~np.uint64(3)) | np.uint64(class_of(instance))


def signatures(h: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
    """(signatures, instance, slack) of each instance that the set takes part in."""
    p = len(h)
    if not p:
        return []
    band = int(np.searchsorted(BANDS, p))
    instances = [(band, (p + p * NEAR[1] // NEAR[0]) // 7)]
    if band and -(-p * NEAR[0] // NEAR[1]) <= BANDS[band - 1]:
        instances.append((band - 1, int(p + BANDS[band - 1]) // 7))
    values = mix(h ^ _M2)
    spoiled = comb(SECOND - 1, CHOSEN - 1)
    out = []
    for instance, most in instances:
        first = int(np.ceil((PARTS_SHARE * int(BANDS[instance]) + PARTS_MORE) / SECOND))
        parts = first * SECOND
        part = ((h >> _HALF) * np.uint64(parts) >> _HALF).astype(np.int64)
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        sums, filled = np.zeros(parts, np.uint64), np.zeros(parts, bool)
        sums[part[starts]] = np.add.reduceat(values, starts)
        filled[part[starts]] = True
        sums, filled = sums.reshape(first, SECOND), filled.reshape(first, SECOND)
        made = []
        for k, choice in enumerate(combinations(range(SECOND), CHOSEN)):
            some = filled[:, choice].any(axis=1)
            place = (np.flatnonzero(some) * comb(SECOND, CHOSEN) + k + (instance << 40)).astype(np.uint64)
            made.append(mix(sums[some][:, choice].sum(axis=1, dtype=np.uint64) + place * _M3))
        made = _classed(np.concatenate(made), instance)
        slack = len(made) - spoiled * most - 1
        out.append((made, instance, slack))
        if slack < 0:
            alone = mix(h + mix(np.array([instance + 1], np.uint64)))
            out.append((_classed(alone, instance + (1 << 8)), instance + (1 << 8), p - most - 1))
    return out
