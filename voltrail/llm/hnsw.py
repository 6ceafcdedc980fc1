"""A hierarchical navigable small-world graph over one shard's vectors, held in flat neighbour arrays.

Vectors are inserted in order: a node links to diverse near ones among the earlier nodes of its levels, so early nodes
keep long links. A shard is bounded, so the earlier nodes are searched exactly, a block of nodes at a time. Similarity is
the inner product; all vectors have one length (see `vectors.py`), so it orders like the distance.
"""

from __future__ import annotations

import numpy as np

LINKS, CANDIDATES = 16, 64
BLOCK = 256


def _levels(n: int) -> np.ndarray:
    draws = np.random.default_rng(7).random(n)
    levels = (-np.log(draws) / np.log(LINKS)).astype(np.int64)
    levels[0] = max(levels.max(), 1)
    return levels


def _diverse(vectors: np.ndarray, candidates: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1 for none) those nearer to the node than to any chosen one.

    Places left over are filled with the nearest of the others.
    """
    found = vectors[np.maximum(candidates, 0)]
    among = found @ found.transpose(0, 2, 1)
    valid = candidates >= 0
    chosen = np.zeros(candidates.shape, bool)
    for at in range(candidates.shape[1]):
        hidden = (chosen & (among[:, at, :] > sims[:, at, None])).any(1)
        chosen[:, at] = valid[:, at] & ~hidden & (chosen.sum(1) < most)
    rank = np.where(chosen, 0, np.where(valid, 1, 2)) * candidates.shape[1] + np.arange(candidates.shape[1])
    order = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(candidates, order, 1)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out


def _nearest(sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the largest entries of each row, largest first."""
    if sims.shape[1] > most:
        places = np.argpartition(-sims, most - 1, axis=1)[:, :most]
    else:
        places = np.tile(np.arange(sims.shape[1]), (len(sims), 1))
    values = np.take_along_axis(sims, places, 1)
    order = np.argsort(-values, axis=1, kind="stable")
    return np.take_along_axis(places, order, 1), np.take_along_axis(values, order, 1)


def _level_links(vectors: np.ndarray, most: int) -> np.ndarray:
    """Neighbours of each vector within one level: a row of `most` numbers, -1 for none."""
    n = len(vectors)
    own = np.full((n, LINKS), -1, np.int32)
    for start in range(0, n, BLOCK):
        end = min(n, start + BLOCK)
        sims = vectors[start:end] @ vectors[:end].T
        sims[np.arange(end)[None, :] >= np.arange(start, end)[:, None]] = -np.inf
        places, values = _nearest(sims, CANDIDATES)
        places = np.where(np.isfinite(values), places, -1)
        own[start:end] = _diverse(vectors, places, values, LINKS)
    source = np.repeat(np.arange(n, dtype=np.int32), LINKS)
    target = own.ravel()
    held = target >= 0
    ends = np.concatenate([source[held], target[held]]), np.concatenate([target[held], source[held]])
    sims = np.einsum("nd,nd->n", vectors[ends[0]], vectors[ends[1]])
    order = np.lexsort((-sims, ends[0]))
    node, other, sims = ends[0][order], ends[1][order], sims[order]
    rank = np.arange(len(node)) - np.searchsorted(node, node)
    # Of a node's links in both directions the nearest ones are weighed for diversity.
    wide = min(max(int(rank.max(initial=0)) + 1, most), 4 * most)
    full = np.full((n, wide), -1, np.int32)
    near = np.full((n, wide), -np.inf, np.float32)
    kept = rank < wide
    full[node[kept], rank[kept]] = other[kept]
    near[node[kept], rank[kept]] = sims[kept]
    out = np.empty((n, most), np.int32)
    for start in range(0, n, BLOCK):
        out[start:start + BLOCK] = _diverse(vectors, full[start:start + BLOCK], near[start:start + BLOCK], most)
    return out


def build(vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level, from the lowest: the numbers of its nodes, ascending, and their neighbours as places in that list."""
    levels = _levels(len(vectors))
    graph = []
    for level in range(int(levels.max()) + 1):
        nodes = np.flatnonzero(levels >= level).astype(np.int32)
        graph.append((nodes, _level_links(vectors[nodes], 2 * LINKS if level == 0 else LINKS)))
    return graph


def _beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and similarities of each query's `width` best nodes found, all queries a step at a time."""
    rows = np.arange(len(queries))
    seen = np.zeros((len(queries), len(vectors)), bool)
    seen[rows, entry] = True
    pool = np.full((len(queries), width), -1, np.int64)
    sims = np.full((len(queries), width), -np.inf, np.float32)
    done = np.ones((len(queries), width), bool)
    pool[:, 0], done[:, 0] = entry, False
    sims[:, 0] = np.einsum("nd,nd->n", vectors[entry], queries)
    while True:
        open_ = np.where(done, -np.inf, sims)
        best = open_.argmax(1)
        live = np.flatnonzero(np.isfinite(open_[rows, best]))
        if not len(live):
            return pool, sims
        best = best[live]
        done[live, best] = True
        near = links[pool[live, best]]
        new = (near >= 0) & ~seen[live[:, None], near]
        at = np.nonzero(new)
        seen[live[at[0]], near[at]] = True
        found = np.where(new, np.einsum("nkd,nd->nk", vectors[np.maximum(near, 0)], queries[live]), -np.inf).astype(np.float32)
        all_sims = np.concatenate([sims[live], found], 1)
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        sims[live] = np.take_along_axis(all_sims, top, 1)
        pool[live] = np.take_along_axis(np.concatenate([pool[live], near], 1), top, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~new], 1), top, 1)


def search(vectors: np.ndarray, graph: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers and similarities of each query's `width` nearest found (-inf where there are fewer)."""
    entry = np.zeros(len(queries), np.int64)  # node 0 is on every level
    for nodes, links in graph[:0:-1]:
        pool, sims = _beam(vectors[nodes], links, queries, np.searchsorted(nodes, entry), 4)
        entry = nodes[pool[np.arange(len(queries)), sims.argmax(1)]].astype(np.int64)
    return _beam(vectors, graph[0][1], queries, entry, width)
