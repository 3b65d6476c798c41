"""Most similar vectors for every vector (problem 2): a small-world graph per shard, shard results merged.

Vectors are routed to the shards of their nearest centroids (fitted on a bounded sample).  Each shard becomes a
hierarchical navigable small-world graph held in flat neighbour arrays; its members are inserted in batches, each by a
beam search through the layers, and then searched once more in the finished graph.  The candidates of all shards of a
vector are merged to its k best.

Centroids cut a dense topic into many cells, and neighbours in it would mostly meet in none.  So the true neighbours of
some probes are looked up in the whole collection, and cells between which they get lost become one region again.  Its
members are dealt by id into parts that every member searches, by scanning: a narrow beam misses most in such a topic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.llm.near_dup import HOT_ROWS, meet
from foliomill.llm.words import mix
from foliomill.session import lookup_side, materialize, tasks

#: Rows of the sample that the centroids are fitted on (at most so many, drawn by a hash of the id).
SAMPLE_ROWS = 40_000
#: Vectors that a shard should hold before replication; at most MOST_CELLS centroids, and as many again within a crowded cell.
SHARD_ROWS, MOST_CELLS = 1_400, 4_096
#: Sample of a crowded cell, at least and for each of its centroids, and vectors routed within a cell by one task.
CELL_SAMPLE, CENTRE_SAMPLE, ROUTED_ROWS = 40_000, 16, 50_000
#: Shards that a vector goes to, and members beyond which a shard is split (then its vectors are searched in every part).
COPIES, MOST_SHARD = 2, 24_000
#: Vectors whose true neighbours are looked up, and the share of them (and least number) that may get lost between two groups of cells.
PROBES, LOST_SHARE, LOST_LEAST = 2_048, 0.05, 4
#: Graph: neighbours per node in the lowest layer, links that a new node makes, neighbours above, width of the beam when inserting and when searching.
WIDE, LINKS, NARROW, EF_INSERT, EF_SEARCH = 32, 12, 12, 12, 8
#: Pairs of a query and a node whose cosines are computed at once.
AT_ONCE = 1_024


class Graph:
    """Hierarchical navigable small-world graph over unit vectors; neighbours are rows of flat integer arrays (-1: none)."""

    def __init__(self, x: np.ndarray, seed: int = 7, batch: int = 512) -> None:
        n = len(x)
        self.x = x
        rng = np.random.default_rng(seed)
        height = np.minimum((-np.log(np.maximum(rng.random(n), 1e-12)) / np.log(NARROW)).astype(int), 4)
        order = np.argsort(-height, kind="stable")
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # from the top: nodes, their neighbours
        for level in range(int(height.max(initial=0)), 0, -1):
            nodes = np.flatnonzero(height >= level)
            if 1 < len(nodes) < n:
                self.layers.append((nodes, self._exact(nodes, NARROW)))
        self.room = np.empty((2, AT_ONCE, x.shape[1]), dtype=x.dtype)
        self.near = np.full((n, WIDE), -1, dtype=np.int32)
        self.sims = np.full((n, WIDE), -np.inf, dtype=np.float32)
        done = min(n, max(64, len(self.layers[-1][0]) if self.layers else 64))
        first = order[:done]
        self._link(first, *self._exact_with(first, min(WIDE, done - 1)))
        while done < n:
            new = order[done : done + min(batch, done)]
            self._insert(new, done)
            done += len(new)

    def _exact_with(self, nodes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        s = self.x[nodes] @ self.x[nodes].T
        np.fill_diagonal(s, -np.inf)
        if k <= 0:
            return np.zeros((len(nodes), 0), np.int32), np.zeros((len(nodes), 0), np.float32)
        top = np.argpartition(-s, min(k, len(nodes) - 1) - 1, axis=1)[:, :k]
        return nodes[top].astype(np.int32), np.take_along_axis(s, top, 1)

    def _exact(self, nodes: np.ndarray, k: int) -> np.ndarray:
        """Neighbours of an upper layer (it is small: one in NARROW of the layer below)."""
        full = np.full((len(self.x), k), -1, dtype=np.int32)
        for a in range(0, len(nodes), 1024):
            part = nodes[a : a + 1024]
            s = self.x[part] @ self.x[nodes].T
            s[np.arange(len(part)), a + np.arange(len(part))] = -np.inf
            m = min(k, len(nodes) - 1)
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            full[part, :m] = nodes[top]
        return full

    def _cosines(self, q: np.ndarray, own: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Of each query ``own`` and its node, a few thousand at once, in room that is kept: they stay in the processor's cache."""
        out = np.empty(len(nodes), dtype=np.float32)
        for a in range(0, len(nodes), AT_ONCE):
            n = len(part := nodes[a : a + AT_ONCE])
            u, v = self.room[0, :n], self.room[1, :n]
            np.take(self.x, part, axis=0, out=u, mode="clip")
            np.take(q, own[a : a + n], axis=0, out=v, mode="clip")
            np.einsum("ij,ij->i", u, v, out=out[a : a + n])
        return out

    def _beam(self, near: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int, expand: int = 2, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries at once from their start nodes (-1: none): the ``ef`` best nodes found, best first.

        known: cosines of the start nodes, if they are known; no node then stands twice among a query's.
        """
        x, b = self.x, len(q)
        seen = np.zeros((b, len(x)), dtype=bool)
        rows = np.arange(b)[:, None]

        def score(r: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            # repeated and seen nodes drop out before anything is computed of them; the others move to the front
            ids = np.sort(ids, axis=1)
            bad = (ids < 0) | seen[r, ids]
            bad[:, 1:] |= ids[:, 1:] == ids[:, :-1]
            ids[bad] = len(x)
            ids = np.sort(ids, axis=1)[:, : max(1, ids.shape[1] - int(bad.sum(axis=1).min()))]
            at, place = np.nonzero(ids < len(x))
            good, own = ids[at, place], r[at, 0]
            s = np.full(ids.shape, -np.inf, dtype=np.float32)
            s[at, place] = self._cosines(q, own, good)
            seen[own, good] = True
            ids[ids == len(x)] = -1
            return ids, s

        if known is None:
            ids, sims = score(rows, start)
        else:
            ids, sims = start, np.where(start >= 0, known, -np.inf).astype(np.float32)
            at, place = np.nonzero(start >= 0)
            seen[at, start[at, place]] = True
        width = max(ef, ids.shape[1])
        best_ids = np.full((b, width), -1, dtype=np.int32)
        best = np.full((b, width), -np.inf, dtype=np.float32)
        best_ids[:, : ids.shape[1]], best[:, : ids.shape[1]] = ids, sims
        open_ = best > -np.inf
        if width > ef:
            top = np.argpartition(-best, ef - 1, axis=1)[:, :ef]
            best_ids, best, open_ = (np.take_along_axis(v, top, 1) for v in (best_ids, best, open_))
        live = np.arange(b)
        while len(live):
            s = np.where(open_[live], best[live], -np.inf)
            pick = np.argpartition(-s, expand - 1, axis=1)[:, :expand] if ef > expand else np.argsort(-s, axis=1)[:, :expand]
            ok = s[rows[: len(live)], pick] > -np.inf
            on = ok.any(axis=1)
            live, pick, ok = live[on], pick[on], ok[on]
            if not len(live):
                break
            open_[live[:, None], pick] = False
            nodes = np.where(ok, best_ids[live[:, None], pick], -1)
            around = np.where(nodes[:, :, None] >= 0, near[nodes], -1).reshape(len(live), -1)
            new_ids, new = score(live[:, None], around)
            all_ids = np.concatenate([best_ids[live], new_ids], axis=1)
            every = np.concatenate([best[live], new], axis=1)
            opened = np.concatenate([open_[live], new > -np.inf], axis=1)
            top = np.argpartition(-every, ef - 1, axis=1)[:, :ef]
            at = rows[: len(live)]
            best_ids[live], best[live], open_[live] = all_ids[at, top], every[at, top], opened[at, top]
        order = np.argsort(-best, axis=1, kind="stable")
        return np.take_along_axis(best_ids, order, 1), np.take_along_axis(best, order, 1)

    def _descend(self, q: np.ndarray, done: int | None = None) -> np.ndarray:
        """Entry nodes of the lowest layer: greedy search down the upper layers."""
        if not self.layers:
            return np.zeros((len(q), 1), dtype=np.int32) if done is None else np.full((len(q), 1), self.first, dtype=np.int32)
        nodes = self.layers[0][0][:64]
        start = nodes[np.argsort(-(q @ self.x[nodes].T), axis=1)[:, :1]].astype(np.int32)
        for _, near in self.layers:
            start = self._beam(near, q, start, 3, 1)[0][:, :2]
        return start

    def _insert(self, new: np.ndarray, done: int) -> None:
        q = self.x[new]
        ids, sims = self._beam(self.near, q, self._descend(q, done), EF_INSERT)
        inner_ids, inner = self._exact_with(new, min(6, len(new) - 1))  # the batch's members see each other too
        ids, sims = np.concatenate([ids, inner_ids], axis=1), np.concatenate([sims, inner], axis=1)
        k = min(LINKS, ids.shape[1])
        top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        self._link(new, np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1))

    def _link(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Edges both ways; a full node keeps its nearest."""
        self.first = int(nodes[0])
        if not ids.size:
            return
        a, b, s = np.repeat(nodes, ids.shape[1]), ids.ravel(), sims.ravel()
        ok = (b >= 0) & (s > -np.inf)
        a, b, s = a[ok], b[ok], s[ok]
        touched = np.unique(np.concatenate([a, b]))
        old = self.near[touched]
        have = old >= 0
        u = np.concatenate([a, b, np.repeat(touched, WIDE)[have.ravel()]])
        v = np.concatenate([b, a, old[have]])
        w = np.concatenate([s, s, self.sims[touched][have]])
        order = np.lexsort((v, -w, u))
        u, v, w = u[order], v[order], w[order]
        fresh = np.ones(len(u), dtype=bool)
        fresh[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
        u, v, w = u[fresh], v[fresh], w[fresh]
        place = np.arange(len(u)) - np.searchsorted(u, u, side="left")
        keep = place < WIDE
        self.near[touched], self.sims[touched] = -1, -np.inf
        self.near[u[keep], place[keep]], self.sims[u[keep], place[keep]] = v[keep], w[keep]

    def search(self, q: np.ndarray, own: np.ndarray | None, ef: int = EF_SEARCH) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` nearest nodes of each query.  own: the queries' own nodes, from whose neighbourhood the search starts."""
        if own is None:
            return self._beam(self.near, q, self._descend(q), ef)
        start = np.concatenate([own[:, None].astype(np.int32), self.near[own]], axis=1)
        known = np.concatenate([np.ones((len(own), 1), np.float32), self.sims[own]], axis=1)
        return self._beam(self.near, q, start, ef + 1, known=known)


def _unit(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors (64-bit) of the usable rows: ``dim`` finite values, not all zero."""
    ids, col = batch.column(0), batch.column(1)
    ok = np.asarray(ids.is_valid()) & np.asarray(col.is_valid())
    sizes = np.diff(col.offsets.to_numpy()) if len(col) else np.zeros(0, int)
    ok &= sizes == dim
    col, ids = col.filter(pa.array(ok)), ids.filter(pa.array(ok))
    if not len(col):
        return np.zeros(0, np.int64), np.zeros((0, dim))
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    x = x[good]
    x = x / np.abs(x).max(axis=1, keepdims=True)  # very long and very short vectors must not overflow
    return ids[good], x / np.linalg.norm(x, axis=1, keepdims=True)


def _direction(x: np.ndarray) -> np.ndarray:
    """A 64-bit key of the direction; vectors with the same key have a cosine of 1.000000."""
    cells = np.round(x * 1e5).astype(np.int64).view(np.uint64)
    return mix(*[np.ascontiguousarray(cells[:, i]) for i in range(cells.shape[1])]).view(np.int64)


def _fit(sample: np.ndarray, cells: int, rounds: int = 4) -> np.ndarray:
    """Centroids of a sample; a centroid with more than twice its share of the sample is split, so dense regions get more."""
    rng = np.random.default_rng(11)
    centre = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    share = max(2, 2 * len(sample) // max(1, cells))

    def nearest() -> np.ndarray:
        return np.concatenate([(sample[a : a + 4096] @ centre.T).argmax(axis=1) for a in range(0, len(sample), 4096)])

    for r in range(rounds):
        at = nearest()
        order = np.argsort(at, kind="stable")
        parts = np.split(order, np.searchsorted(at[order], np.arange(1, len(centre))))
        new = []
        for c, rows in zip(centre, parts, strict=True):
            m = sample[rows]
            k = 1 if r == rounds - 1 and len(rows) <= share else max(1, round(len(rows) / share))
            if not len(rows):
                new.append(c)
            elif k == 1:
                new.append(m.mean(axis=0))
            else:
                new += list(m[rng.choice(len(m), k, replace=False)])
        centre = np.array(new)
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    return centre.astype(np.float32)


def _best(s: np.ndarray, keep: int) -> np.ndarray:
    """Columns of the ``keep`` greatest values of each row, in any order: they lie in the strided chunks with the greatest maxima."""
    keep, width = min(keep, s.shape[1]), s.shape[1] // 32
    if width <= keep:
        return np.argpartition(-s, keep - 1, axis=1)[:, :keep]
    body = width * 32
    chunks = np.argpartition(-s[:, :body].reshape(len(s), 32, width).max(axis=1), keep - 1, axis=1)[:, :keep]
    columns = (chunks[:, None, :] + width * np.arange(32)[None, :, None]).reshape(len(s), -1)
    columns = np.concatenate([columns, np.broadcast_to(np.arange(body, s.shape[1]), (len(s), s.shape[1] - body))], axis=1)
    return np.take_along_axis(columns, np.argpartition(-np.take_along_axis(s, columns, 1), keep - 1, axis=1)[:, :keep], 1)


def _tree(centre: np.ndarray) -> list[tuple[int, int]]:
    """Average linkage of the centroids by cosine: the two nodes of each merge (leaves first, then merges in their order)."""
    n = len(centre)
    s = centre.astype(np.float32) @ centre.T.astype(np.float32)
    np.fill_diagonal(s, -np.inf)
    size, node, top, merges = np.ones(n), np.arange(n), s.max(axis=1, initial=-np.inf), []
    for m in range(n - 1):
        i = int(top.argmax())
        j = int(s[i].argmax())
        merges.append((int(node[i]), int(node[j])))
        old = np.flatnonzero((s[:, i] == top) | (s[:, j] == top))
        row = (size[i] * s[i] + size[j] * s[j]) / (size[i] + size[j])
        row[[i, j]] = -np.inf
        s[i], s[:, i], s[j], s[:, j] = row, row, -np.inf, -np.inf
        size[i], node[i] = size[i] + size[j], n + m
        top = np.maximum(top, row)
        for r in {i, j, *old.tolist()}:
            top[r] = s[r].max()
    return merges


def _regions(centre: np.ndarray, a: np.ndarray, b: np.ndarray, lost: np.ndarray) -> np.ndarray:
    """The region of each centroid: its own number or, if cells became one dense region, a negative one.

    a, b, lost: of each probe and true neighbour the nearest cells, and whether they meet in no shard.  From the top of
    the centroids' tree, a node stays whole whose halves lose too many neighbours to each other, by more than chance, and
    whose cells do so on the whole: a dozen probes of an outlying cell must not make a region of all that it is merged with.
    """
    n, merges = len(centre), _tree(centre)
    leaves = [[i] for i in range(n)]
    for i, j in merges:
        leaves.append(leaves[i] + leaves[j])
    region, todo = np.arange(n), [n + len(merges) - 1] if merges else []
    pairs = np.bincount(a, minlength=n)
    while todo:
        at = todo.pop()
        if at < n:
            continue
        side = np.zeros(n, np.int8)
        for value, half in zip((1, 2), merges[at - n], strict=True):
            side[leaves[half]] = value
        crossing = int((lost & (side[a] * side[b] == 2)).sum())
        allowed = 2 * LOST_SHARE * min(pairs[side == 1].sum(), pairs[side == 2].sum())
        inside = int((lost & (side[a] > 0) & (side[b] > 0)).sum())
        if crossing >= max(LOST_LEAST, allowed + 2 * np.sqrt(allowed)) and inside >= LOST_SHARE * pairs[side > 0].sum():
            region[leaves[at]] = -1 - min(leaves[at])
        else:
            todo += merges[at - n]
    return region


def _shard(rows: pd.DataFrame, k: int, least: float = -np.inf) -> pd.DataFrame:
    """Every asking vector's best candidates of a cosine of about ``least`` among the members of one part of a shard: id, other, cosine.

    Members form a graph; in a part of a dense region (negative cell) they are scanned.
    """
    rows = rows.sort_values("id").drop_duplicates("id")
    ids, dim = rows["id"].to_numpy(), len(rows["vec"].iloc[0]) // 4
    x = np.frombuffer(b"".join(rows["vec"]), dtype=np.float32).reshape(-1, dim)
    member, asks = rows["member"].to_numpy(dtype=bool), rows["asks"].to_numpy(dtype=bool)
    inside, dense = np.flatnonzero(member), rows["cell"].iloc[0] < 0
    out = [pd.DataFrame({"id": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "cosine": np.zeros(0)})]
    if not len(inside):
        return out[0]
    base = np.ascontiguousarray(x[inside])
    graph = None if dense else Graph(base)
    keep = k + 3
    for which, own in ((np.flatnonzero(asks & member), True), (np.flatnonzero(asks & ~member), False)):
        at_once = 256 if dense else 512
        for a in range(0, len(which), at_once):
            part = which[a : a + at_once]
            if graph is None:
                s = x[part] @ base.T
                found = _best(s, keep + 1)
                sims = np.take_along_axis(s, found, 1)
            else:
                found, sims = graph.search(x[part], np.searchsorted(inside, part) if own else None, max(EF_SEARCH, keep))
                found, sims = found[:, : keep + 1], sims[:, : keep + 1]
            ok = (found >= 0) & (sims > -np.inf)
            node = inside[np.maximum(found, 0)]
            ok &= node != part[:, None]
            exact = np.matmul(x[node].astype(np.float64), x[part].astype(np.float64)[:, :, None])[:, :, 0]
            r, c = np.nonzero(ok & (exact >= least - 1e-6))  # cosines are rounded later
            one, other = ids[part[r]], ids[node[r, c]]
            out.append(pd.DataFrame({"id": one, "other": other, "cosine": exact[r, c]}))
            if not own and graph is not None:  # a visitor is no member here, so the member couldn't find it
                out.append(pd.DataFrame({"id": other, "other": one, "cosine": exact[r, c]}))
    return pd.concat(out, ignore_index=True)


def _losses(searched: DataFrame, centre: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, dim: int, copies: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each probe (ids, x) and each of its ``k`` true neighbours: their nearest cells, and whether they meet in no shard."""
    sent = searched.sparkSession.sparkContext.broadcast((centre, ids, x))
    p = min(copies, len(centre))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, own, q = sent.value
        place = {int(i): n for n, i in enumerate(own)}
        sims, cells = np.full((len(q), k), -np.inf, np.float32), np.full((len(q), k, p), -1, np.int32)
        for b in batches:
            at, y = _unit(b, dim)
            y = y.astype(np.float32)
            for a in range(0, len(y), 4096):
                z = y[a : a + 4096]
                s = q @ z.T
                for n, i in enumerate(at[a : a + 4096].tolist()):
                    if i in place:
                        s[place[i], n] = -np.inf
                top = _best(s, k)
                to, back = np.unique(top, return_inverse=True)
                near = np.argsort(-(z[to] @ c.T), axis=1)[:, :p].astype(np.int32)[back.reshape(top.shape)]
                sims, cells = np.concatenate([sims, np.take_along_axis(s, top, 1)], axis=1), np.concatenate([cells, near], axis=1)
                keep = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                sims, cells = np.take_along_axis(sims, keep, 1), np.take_along_axis(cells, keep[:, :, None], 1)
        r, n = np.nonzero(sims > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(-sims[r, n]), pa.array(list(cells[r, n]), pa.list_(pa.int32()))], names=["probe", "s", "cells"])

    best = searched.mapInArrow(scan, "probe int, s float, cells array<int>").groupBy("probe").agg(F.slice(F.array_sort(F.collect_list(F.struct("s", "cells"))), 1, k).alias("near")).collect()
    pairs = [(r["probe"], y["cells"]) for r in best for y in r["near"]]
    probe, theirs = np.array([r for r, _ in pairs], np.int64), np.array([y for _, y in pairs], np.int64).reshape(-1, p)
    mine = np.argsort(-(x @ centre.T), axis=1)[:, :p][probe]
    return mine[:, 0], theirs[:, 0], ~(mine[:, :, None] == theirs[:, None, :]).any(axis=(1, 2))


def _routes(x: np.ndarray, centre: np.ndarray, region: np.ndarray, copies: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The shards that vectors go to, nearest first, and whether they are members there.  Out of a dense region, a vector only
    visits: thousands of its like would fill the next shard."""
    s, first = x @ centre.T, None
    for _ in range(min(copies, len(np.unique(region)))):
        cell = region[s.argmax(axis=1)]
        first = cell if first is None else first
        yield cell, (cell == first) | (first >= 0)
        s[region[None, :] == cell[:, None]] = -np.inf


def _fit_cell(rows: pd.DataFrame, k: int, copies: int) -> pd.DataFrame:
    """Centroids and regions within a crowded cell, from a sample of it (cell, centres, every, vec).

    The sample holds each ``every``-th row, so about that share of the ``k`` nearest others; as many of the sample's stand for them.
    """
    x = np.frombuffer(b"".join(rows["vec"]), dtype=np.float32).reshape(len(rows), -1)
    centre = _fit(x, int(rows["centres"].iloc[0]))
    k, p = min(max(1, round(k / int(rows["every"].iloc[0]))), len(x) - 1), min(copies, len(centre))
    cells = np.concatenate([np.argsort(-(x[a : a + 4096] @ centre.T), axis=1)[:, :p] for a in range(0, len(x), 4096)])
    probes = np.random.default_rng(13).permutation(len(x))[:PROBES]
    near = [np.zeros((0, k), np.int64)]
    for a in range(0, len(probes), 256):
        at = probes[a : a + 256]
        s = x[at] @ x.T
        s[np.arange(len(at)), at] = -np.inf
        near.append(np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.zeros((len(at), 0), np.int64))
    mine, theirs = np.repeat(cells[probes], k, axis=0), cells[np.concatenate(near).ravel()]
    lost = ~(mine[:, :, None] == theirs[:, None, :]).any(axis=(1, 2))
    region = _regions(centre, mine[:, 0], theirs[:, 0], lost)
    return pd.DataFrame({"cell": [int(rows["cell"].iloc[0])], "centre": [centre.tobytes()], "region": [region.astype(np.int64).tobytes()], "n": [len(np.unique(region))]})


def _route_cell(rows: pd.DataFrame, fitted: pd.DataFrame, copies: int) -> pd.DataFrame:
    """The rows of a crowded cell (cell, id, vec, home) in its inner shards."""
    out = [pd.DataFrame({"cell": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "vec": np.zeros(0, object), "home": np.zeros(0, bool)})]
    if len(rows) and not len(fitted):  # nothing of the cell was drawn: it stays as it is
        return rows[["cell", "id", "vec", "home"]]
    if len(rows):
        x = np.frombuffer(b"".join(rows["vec"]), dtype=np.float32).reshape(len(rows), -1)
        centre, region = np.frombuffer(fitted["centre"].iloc[0], dtype=np.float32).reshape(-1, x.shape[1]), np.frombuffer(fitted["region"].iloc[0], dtype=np.int64)
        outer = (int(rows["cell"].iloc[0]) + 1) << 24  # inner shards are numbered apart from all other cells, dense regions below zero
        for cell, home in _routes(x, centre, region, copies):
            out.append(pd.DataFrame({"cell": np.where(cell < 0, cell - outer, cell + outer), "id": rows["id"].to_numpy(), "vec": rows["vec"].to_numpy(), "home": rows["home"].to_numpy(dtype=bool) & home}))
    return pd.concat(out, ignore_index=True)


def _refined(routed: DataFrame, crowded: list, k: int, copies: int, most_cells: int) -> tuple[DataFrame, int]:
    """Routed rows with crowded cells (cell, c: rows) divided by centroids of their own, and the number of inner shards."""
    spark = routed.sparkSession
    rows = []
    for r in crowded:
        centres = min(most_cells, max(2, round(r["c"] / SHARD_ROWS)))
        rows.append((r["cell"], centres, max(1, r["c"] // max(CELL_SAMPLE, CENTRE_SAMPLE * centres)), -(-r["c"] // ROUTED_ROWS)))
    plan = F.broadcast(spark.createDataFrame(rows, "cell long, centres int, every long, blocks long"))  # at most as many rows as cells
    inside = routed.join(plan, "cell")
    sample = inside.where(F.pmod(F.xxhash64("id", F.lit(3)), "every") == 0).select("cell", "centres", "every", "vec")
    fitted = materialize(sample.groupBy("cell").applyInPandas(lambda r: _fit_cell(r, k, copies), "cell long, centre binary, region binary, n long"), "cells")
    dealt = inside.withColumn("deal", F.pmod(F.xxhash64("id", F.lit(5)), "blocks")).select("cell", "deal", "id", "vec", "home")
    spread = fitted.join(plan, "cell").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("cell", "deal", "centre", "region")
    inner = dealt.groupBy("cell", "deal").cogroup(spread.groupBy("cell", "deal")).applyInPandas(lambda a, b: _route_cell(a, b, copies), "cell long, id long, vec binary, home boolean")
    whole = routed.join(plan.select("cell"), "cell", "left_anti").unionByName(inner)
    return materialize(whole, "routed"), int(fitted.agg(F.sum("n")).first()[0] or 0)


def similar_vectors(vectors: DataFrame, k: int = 5, least: float = -1.0, dim: int = 96, copies: int = COPIES, most_shard: int = MOST_SHARD, most_cells: int = MOST_CELLS) -> DataFrame:
    """``id, rank, other, cosine``: for every usable vector of (id, vector) its ``k`` most similar others.

    Usable: ``dim`` finite values, not all zero; other rows have no neighbours and are none.  An id counts once (of several
    vectors of one id that with the smallest direction key).  Cosines are rounded to 6 decimals, ties go to the smaller
    id; pairs below ``least`` are left out.  Vectors of the same direction are searched once and then expanded, so copies,
    however many, are exact.  One usable vector or an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(vectors.columns[0]).cast("long").alias("id"), F.col(vectors.columns[1]).cast("array<float>").alias("vector"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = _unit(b, dim)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(_direction(x) if len(x) else np.zeros(0, np.int64))], names=["id", "key"])

    members = materialize(base.mapInArrow(keys, "id long, key long").groupBy("id").agg(F.min("key").alias("key")), "members")
    first = members.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("n") <= k + 1)
    heads = materialize(first, "heads")
    reps = heads.where("n = 1")
    total = reps.count()
    cells = int(min(most_cells, max(1, round(total / SHARD_ROWS))))
    several = members.join(reps.select("id"), "id", "left_anti").select("id")  # every id that isn't its direction's first
    searched = base.join(lookup_side(several), "id", "left_anti")

    every = max(1, -(-total // SAMPLE_ROWS))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = _unit(b, dim)
            chosen = mix(ids.view(np.uint64)) % np.uint64(every) == 0 if len(ids) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(ids[chosen]), pa.array([v.tobytes() for v in x[chosen].astype(np.float32)], pa.binary())], names=["id", "vec"])

    if cells > 1:
        rows = searched.mapInArrow(pick, "id long, vec binary").collect()
        sample = np.frombuffer(b"".join(r["vec"] for r in rows), dtype=np.float32).reshape(-1, dim)
        centre = _fit(sample, cells)
        chosen = np.random.default_rng(13).permutation(len(rows))[:PROBES]
        region = _regions(centre, *_losses(searched, centre, np.array([r["id"] for r in rows])[chosen], sample[chosen], k, dim, copies))
    else:
        centre, region = np.zeros((1, dim), np.float32), np.zeros(1, np.int64)
    sent = spark.sparkContext.broadcast((centre, region))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, of = sent.value
        for b in batches:
            ids, x = _unit(b, dim)
            x = x.astype(np.float32)
            blob = pa.array([v.tobytes() for v in x], pa.binary())
            for cell, home in _routes(x, c, of, copies):
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(ids), blob, pa.array(home)], names=["cell", "id", "vec", "home"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sizes of shards, without the vectors: members and all that are routed there."""
        c, of = sent.value
        for b in batches:
            for cell, home in _routes(_unit(b, dim)[1].astype(np.float32), c, of, copies):
                cell, at, n = np.unique(cell, return_inverse=True, return_counts=True)
                m = np.bincount(at, weights=home, minlength=len(cell))
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (cell, m, n)], names=["cell", "m", "c"])

    routed = searched.mapInArrow(route, "cell long, id long, vec binary, home boolean")
    # a crowded cell is divided by centroids of its own; what is dense or still too large is split by id: its vectors are searched
    # in every part, in blocks that one task can hold
    sizes = lambda counted: counted.groupBy("cell").agg(F.sum("m").alias("m"), F.sum("c").alias("c")).where(F.col("c") > most_shard).collect()
    crowded, shards = sizes(searched.mapInArrow(count, "cell long, m long, c long")), len(np.unique(region))
    if any(r["cell"] >= 0 for r in crowded):
        routed, inner = _refined(routed, [r for r in crowded if r["cell"] >= 0], k, copies, most_cells)
        crowded, shards = sizes(routed.select("cell", F.col("home").cast("long").alias("m"), F.lit(1).cast("long").alias("c"))), shards + inner
    # a scan costs members x askers: with as many of the one as of the other in a task, the fewest copies are sent
    dealt = lambda r, name: max(1, -(-r[name] // (most_shard * (2 if r["cell"] < 0 else {"m": 1, "c": 4}[name]))))
    if crowded:
        share = lambda name: F.coalesce(F.create_map(*[F.lit(v) for r in crowded for v in (r["cell"], dealt(r, name))])[F.col("cell")], F.lit(1)).cast("int")
        n, blocks = share("m"), share("c")
        mine = (F.pmod(F.xxhash64("id"), n), F.pmod(F.xxhash64("id", F.lit(1)), blocks))
        routed = (
            routed.withColumn("part", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .withColumn("member", F.col("home") & (F.col("part") == mine[0])).withColumn("asks", F.col("block") == mine[1]).where("member or asks")
        )
    else:
        routed = routed.withColumn("part", F.lit(0)).withColumn("block", F.lit(0)).withColumn("member", F.col("home")).withColumn("asks", F.lit(True))
    # as many partitions as there are shards and parts, so what a task reads doesn't grow with the collection
    shards += sum(dealt(r, "m") * dealt(r, "c") for r in crowded)
    routed = routed.repartition(max(tasks(spark), shards), "cell", "part", "block")
    found = routed.groupBy("cell", "part", "block").applyInPandas(lambda rows: _shard(rows[["cell", "id", "vec", "member", "asks"]], k, least), "id long, other long, cosine double")
    score = F.round("cosine", 6)
    near = (
        found.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct((-score).alias("s"), "other"))), 1, k + 2).alias("near"))
        .select("id", F.explode("near").alias("x")).select(F.col("id").alias("rep"), F.col("x.other").alias("other"), (-F.col("x.s")).alias("cosine"))
    )
    # back to ids: every direction stands for its first k + 1 ids
    keys_of = reps.select("key", F.col("id"))
    ids_of = heads.select("key", F.col("id").alias("neighbour"))
    near = near.join(keys_of.select(F.col("key").alias("own"), F.col("id").alias("rep")), "rep").join(keys_of.select("key", F.col("id").alias("other")), "other")
    lists = (
        near.join(ids_of, "key").select("own", "neighbour", "cosine")
        .unionByName(heads.select(F.col("key").alias("own"), F.col("id").alias("neighbour"), F.lit(1.0).alias("cosine")))
        .where(F.col("cosine") >= least)
        .groupBy("own").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("s"), "neighbour"))), 1, k + 1).alias("best"))
    )
    # ids of a direction with many copies are dealt to tasks
    mine = meet(members, lists.withColumnRenamed("own", "key"), "key", "id", HOT_ROWS).select("id", F.slice(F.filter("best", lambda x: x["neighbour"] != F.col("id")), 1, k).alias("best"))
    return mine.select("id", F.posexplode("best").alias("rank", "x")).select(
        "id", (F.col("rank") + 1).alias("rank"), F.col("x.neighbour").alias("other"), (-F.col("x.s")).alias("cosine")
    )


def similar_pairs(vectors: DataFrame, k: int = 5, least: float = 0.7, dim: int = 96) -> DataFrame:
    """Distinct pairs ``id_a < id_b`` of which one is among the other's ``k`` most similar with a cosine of ``least`` or more."""
    return similar_vectors(vectors, k, least, dim).select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
