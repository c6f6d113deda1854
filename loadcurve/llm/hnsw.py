"""Hierarchical navigable small-world graph of one shard, as flat neighbour arrays, with whole batches of searches in step.

Nearness is the inner product. For the graph each vector gets one more component that brings all to one length, so the largest inner
product with a query is also the least distance, and nodes are linked by true distances. Layers hold each node with a probability
that falls by the factor LINKS; a layer is an array (nodes, width) of node numbers, -1 where empty. Nodes enter a layer in batches of
at most as many as it has: each batch searches the layer (from the nearest node of the layer above), picks diverse neighbours among
what it finds and its own batch, and is linked back; a full list is cut to diverse neighbours again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Links kept for a node (twice as many in the lowest layer); candidates when linking; places looked at in a step of a search.
LINKS, EF_BUILD, WIDTH = 16, 64, 4
BASE_WIDTH, UPPER_WIDTH = 3 * LINKS, LINKS + LINKS // 2


def batch_rows(dimension: int) -> int:
    """Nodes or queries that go in step: fewer of long vectors, so that what is gathered for them stays below some 50 MB."""
    return max(16, min(512, (1 << 16) // max(1, dimension)))


@dataclass
class Graph:
    """`vectors` with the added component; `layers` from the lowest up. A layer holds the first nodes, as many as it has rows; node 0 is in all."""

    vectors: np.ndarray
    layers: list[np.ndarray]


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Unit-length rows whose inner products with (query, 0) order as those of the vectors do."""
    scale = np.abs(vectors).max() if vectors.size else 1.0
    rows = vectors.astype(np.float64) / (scale or 1.0)
    square = (rows * rows).sum(1)
    most = square.max() if len(square) else 1.0
    rows = np.concatenate([rows, np.sqrt(np.maximum(0.0, most - square))[:, None]], 1)
    return (rows / np.sqrt(most or 1.0)).astype(np.float32)


def search_layer(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The `ef` nearest nodes that each query reaches in a layer, nearest first, and their products; -1 and -inf where fewer.

    All queries go in step: each opens its WIDTH nearest unopened nodes, until none among its nearest is unopened.
    """
    count, rows = len(queries), np.arange(len(queries))
    seen = np.zeros((count, len(vectors)), bool)
    ids = np.full((count, ef), -1, np.int32)
    near = np.full((count, ef), -np.inf, np.float32)
    opened = np.ones((count, ef), bool)
    ids[:, 0], opened[:, 0] = entries, False
    near[:, 0] = np.einsum("ij,ij->i", vectors[entries], queries)
    seen[rows, entries] = True
    active, width = rows, min(WIDTH, ef)
    while len(active):
        open_near = np.where(opened[active], -np.inf, near[active])
        pick = np.argpartition(-open_near, width - 1, axis=1)[:, :width] if width < ef else np.arange(ef)[None, :].repeat(len(active), 0)
        live = np.take_along_axis(open_near, pick, 1) > -np.inf
        going = live.any(1)
        active, pick, live = active[going], pick[going], live[going]
        if not len(active):
            break
        found = []
        for k in range(width):
            at = active[live[:, k]]
            place = pick[live[:, k], k]
            opened[at, place] = True
            next_ids = links[ids[at, place]]
            who = np.repeat(at, next_ids.shape[1])
            next_ids = next_ids.ravel()
            fresh = next_ids >= 0
            who, next_ids = who[fresh], next_ids[fresh]
            fresh = ~seen[who, next_ids]
            who, next_ids = who[fresh], next_ids[fresh]
            seen[who, next_ids] = True
            found.append((who, next_ids))
        who, new = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(who):
            continue
        score = np.einsum("ij,ij->i", vectors[new], queries[who])
        better = score > near[who, -1]
        who, new, score = who[better], new[better], score[better]
        if not len(who):
            continue
        # the new ones of each query beside what it has; the best ef of both stay, in order
        order = np.argsort(who, kind="stable")
        who, new, score = who[order], new[order], score[order]
        of, first, counts = np.unique(who, return_index=True, return_counts=True)
        place = np.arange(len(who)) - np.repeat(first, counts)
        line = np.repeat(np.arange(len(of)), counts)
        wide = int(counts.max())
        all_near = np.concatenate([near[of], np.full((len(of), wide), -np.inf, np.float32)], 1)
        all_ids = np.concatenate([ids[of], np.full((len(of), wide), -1, np.int32)], 1)
        all_open = np.concatenate([opened[of], np.zeros((len(of), wide), bool)], 1)
        all_near[line, ef + place], all_ids[line, ef + place] = score, new
        top = np.argsort(-all_near, axis=1, kind="stable")[:, :ef]
        near[of], ids[of] = np.take_along_axis(all_near, top, 1), np.take_along_axis(all_ids, top, 1)
        opened[of] = np.take_along_axis(all_open, top, 1)
    return ids, near


def diverse(vectors: np.ndarray, candidates: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` of each row's candidates (nearest first, -1 empty): those nearer to the row's node than to any chosen
    before; then, in order, those passed over."""
    rows, wide = candidates.shape
    points = vectors[np.maximum(candidates, 0)]
    between = points @ points.transpose(0, 2, 1)
    chosen = np.zeros((rows, wide), bool)
    blocked = candidates < 0
    for k in range(wide):
        take = ~blocked[:, k] & (chosen.sum(1) < most)
        chosen[:, k] = take
        blocked |= take[:, None] & (between[:, k, :] > near)
        blocked[:, k] |= take
    rank = np.where(chosen, 0, np.where(candidates >= 0, 1, 2)) * wide + np.arange(wide)
    order = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(candidates, order, 1)
    if out.shape[1] < most:
        out = np.concatenate([out, np.full((rows, most - out.shape[1]), -1, out.dtype)], 1)
    return out


def _sorted_candidates(ids: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = np.where(ids >= 0, near, -np.inf)
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


def _link_back(vectors: np.ndarray, links: np.ndarray, sources: np.ndarray, targets: np.ndarray, most: int) -> None:
    """Put each source into its target's list; lists that would overflow are cut to `most` diverse neighbours."""
    near = np.einsum("ij,ij->i", vectors[sources], vectors[targets])
    order = np.lexsort((-near, targets))
    sources, targets = sources[order], targets[order]
    of, first, counts = np.unique(targets, return_index=True, return_counts=True)
    place = np.arange(len(targets)) - np.repeat(first, counts)
    short = place < links.shape[1]  # nearest first: more could not stay in a list anyway
    line, place, sources = np.repeat(np.arange(len(of)), counts)[short], place[short], sources[short]
    held = (links[of] >= 0).sum(1)
    fits = held + counts <= links.shape[1]
    easy = fits[line]
    links[of[line[easy]], held[line[easy]] + place[easy]] = sources[easy]
    full = np.flatnonzero(~fits)
    number = np.full(len(of), -1)
    number[full] = np.arange(len(full))
    extra = np.full((len(full), links.shape[1]), -1, np.int32)
    extra[number[line[~easy]], place[~easy]] = sources[~easy]
    step = batch_rows(vectors.shape[1])
    for at in range(0, len(full), step):
        nodes, part = of[full[at : at + step]], extra[at : at + step]
        ids = np.concatenate([links[nodes], part], 1)
        products = np.einsum("ijk,ik->ij", vectors[np.maximum(ids, 0)], vectors[nodes])
        ids, products = _sorted_candidates(ids, products)
        links[nodes] = -1
        links[nodes, :most] = diverse(vectors, ids, products, most)


def _insert(vectors: np.ndarray, links: np.ndarray, batch: np.ndarray, start: int, entries: np.ndarray, most: int) -> None:
    """Link the nodes batch[0..] (numbers start, start+1, ...) into a layer that holds the numbers below `start`."""
    mine = vectors[batch]
    if start:
        ids, near = search_layer(vectors[:start], links, mine, entries, min(EF_BUILD, start))
    else:
        ids, near = np.full((len(batch), 0), -1, np.int32), np.zeros((len(batch), 0), np.float32)
    within = mine @ mine.T
    np.fill_diagonal(within, -np.inf)
    top = np.argsort(-within, axis=1, kind="stable")[:, : min(most, max(0, len(batch) - 1))]
    ids = np.concatenate([ids, batch[top].astype(np.int32)], 1)
    near = np.concatenate([near, np.take_along_axis(within, top, 1)], 1)
    ids, near = _sorted_candidates(ids, near)
    links[batch, :most] = diverse(vectors, ids, near, most)
    sources = np.repeat(batch, most)
    targets = links[batch, :most].ravel()
    # nodes of one batch that chose each other are linked already
    real = targets >= 0
    sources, targets = sources[real], targets[real]
    mutual = (targets >= start) & (links[targets] == sources[:, None]).any(1)
    _link_back(vectors, links, sources[~mutual], targets[~mutual], most)


def build(vectors: np.ndarray, seed: int = 11) -> tuple[Graph, np.ndarray]:
    """The graph of these vectors, and the order in which it numbers them: its node i is row order[i] of `vectors`."""
    n = len(vectors)
    levels = np.floor(-np.log(1.0 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int)
    order = np.lexsort((np.random.default_rng(seed + 1).random(n), -levels))
    points = lifted(vectors[order])
    members = [int((levels >= k).sum()) for k in range(levels.max() + 1 if n else 0)]
    layers: list[np.ndarray] = []
    for k in range(len(members) - 1, -1, -1):
        most = LINKS * (1 if k else 2)
        links = np.full((members[k], UPPER_WIDTH if k else BASE_WIDTH), -1, np.int32)
        above = [members[j] for j in range(k + 1, len(members))]
        start = 0
        while start < members[k]:
            end = min(members[k], start + min(batch_rows(points.shape[1]), max(start, 2 * LINKS)))
            if above and start < above[0]:
                end = min(end, above[0])
            batch = np.arange(start, end)
            entries = np.zeros(len(batch), np.int64)
            if above and start >= above[0]:  # nodes above are all in this layer: come down from them
                for upper in layers:
                    entries = search_layer(points[: len(upper)], upper, points[batch], entries, 1)[0][:, 0].astype(np.int64)
            _insert(points, links, batch, start, entries, most)
            start = end
        layers.append(links)
    return Graph(points, layers[::-1]), order


def search(graph: Graph, queries: np.ndarray, ef: int) -> np.ndarray:
    """For each query the up to `ef` nearest nodes that the graph finds, nearest first; -1 where fewer."""
    scale = np.abs(queries).max(1, keepdims=True)
    flat = np.concatenate([queries / np.where(scale > 0, scale, 1.0), np.zeros((len(queries), 1))], 1).astype(np.float32)
    out = []
    step = batch_rows(flat.shape[1])
    for at in range(0, len(flat), step):
        part = flat[at : at + step]
        entries = np.zeros(len(part), np.int64)
        for links in graph.layers[:0:-1]:
            entries = search_layer(graph.vectors[: len(links)], links, part, entries, 1)[0][:, 0].astype(np.int64)
        out.append(search_layer(graph.vectors, graph.layers[0], part, entries, min(ef, len(graph.vectors)))[0])
    return np.concatenate(out) if out else np.zeros((0, ef), np.int32)
