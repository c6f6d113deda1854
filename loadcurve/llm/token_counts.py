"""Token counts by a longest-match automaton: greedy word-piece lengths without making the pieces.

The vocabulary is a trie. Each node has a failure link to the node of what is left when the longest
pieces at its front are taken off, and the number of pieces taken. Scanning a word follows edges and, where
there is none, adds the node's number and follows its link, so the work is linear in the length of the
word, whatever the vocabulary. A word is its bytes after a start mark; pieces with the mark only begin words.

Defined cases: null and empty texts have no words and no tokens; a word that the pieces cannot make counts
as one unknown token, and as one in `n_unknown`; words of any length are counted whole; result columns
replace input columns of the same name; every row is counted by itself.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loadcurve.llm.common import BoundedCache, annotate, split_words, without

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Stands before each word, and before pieces that begin a word.
MARK = b" "
#: Words whose counts a worker keeps.
CACHED_WORDS = 400_000
OUTPUT = [T.StructField(n, T.LongType()) for n in ("n_words", "n_tokens", "n_unknown")]


class LongestMatch:
    """The automaton over pieces of bytes. Node 0 is the root; an edge is found by node * 256 + byte."""

    def __init__(self, pieces: Iterable[bytes]):
        self.edges: dict[int, int] = {}
        ends = [False]
        children: list[list[tuple[int, int]]] = [[]]
        for piece in pieces:
            node = 0
            for byte in piece:
                to = self.edges.get(node * 256 + byte)
                if to is None:
                    to = self.edges[node * 256 + byte] = len(ends)
                    ends.append(False)
                    children.append([])
                    children[node].append((byte, to))
                node = to
            ends[node] = node != 0
        #: -1: no pieces can make what has been read.
        self.link = [-1] * len(ends)
        self.popped = [0] * len(ends)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in children[parent]:
                queue.append(node)
                if ends[node]:
                    self.link[node], self.popped[node] = 0, 1
                    continue
                taken, at = self.popped[parent], self.link[parent]
                while at >= 0 and at * 256 + byte not in self.edges:
                    taken += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[node], self.popped[node] = self.edges[at * 256 + byte], taken

    def count(self, word: bytes) -> int:
        """Pieces of the word by greedy longest match, or -1 if it has no such pieces."""
        edges, link, popped = self.edges, self.link, self.popped
        node = total = 0
        for byte in word:
            while (to := edges.get(node * 256 + byte)) is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return -1
            node = to
        while node:
            total += popped[node]
            node = link[node]
            if node < 0:
                return -1
        return total


def pieces_of_file(name: str = VOCABULARY) -> list[bytes]:
    """The pieces of a public vocabulary of ranks; those with a space after their first byte cannot occur in a word."""
    import base64

    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as lines:
        pieces = [base64.b64decode(line.split()[0]) for line in lines]
    return [p for p in pieces if MARK not in p[1:]]


@lru_cache(maxsize=2)
def _counter(name: str) -> BoundedCache:
    automaton = LongestMatch(pieces_of_file(name))
    return BoundedCache(lambda word: automaton.count(MARK + word), CACHED_WORDS)


class _Count:
    def __init__(self, vocabulary: str):
        self.vocabulary = vocabulary

    def __call__(self, texts):
        known = _counter(self.vocabulary)
        rows = []
        for text in texts:
            words = split_words(text or "")
            counts = list(map(known.__getitem__, words))
            unknown = counts.count(-1)
            rows.append((len(words), sum(counts) + 2 * unknown, unknown))
        return list(zip(*rows, strict=True))


def token_counts(docs: DataFrame, keep: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Add n_words, n_tokens and n_unknown of the whole text to the columns `keep` (all by default)."""
    keep = without(docs, [f.name for f in OUTPUT]).columns if keep is None else keep
    return annotate(docs, ["text"], OUTPUT, _Count(vocabulary), keep)
