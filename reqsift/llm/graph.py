"""Approximate nearest neighbours by inner product: a robust-pruned graph per shard.

The vectors are dealt into shards of bounded size.  In each, points are inserted in
growing batches: a greedy search from the shard's centre proposes neighbours, pruning
keeps near ones in diverse directions (a candidate goes if a kept one is nearer to it
than the point is, with some slack), and edges are mirrored.  Every query then walks
each shard's graph with a beam; the shards' bests are merged and scored exactly.

Inner products become distances by one more coordinate that gives all points of a
shard the same norm.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from reqsift.workspace import materialize

#: Vectors of one shard, queries of one block.
SHARD, BLOCK = 10_000, 20_000
DEGREE, BUILD_BEAM, SEARCH_BEAM, SLACK, WIDTH = 32, 64, 192, 1.2, 4
_BATCH = 1000


class Graph:
    """Points of equal norm and, per point, up to ``DEGREE`` neighbours (-1 where none)."""

    def __init__(self, points: np.ndarray, edges: np.ndarray, start: int):
        self.points, self.edges, self.start = points, edges, start

    def search(self, wanted: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1 where none) and products of the ``beam`` best found per row of ``wanted``."""
        n, count = len(self.points), len(wanted)
        ids = np.full((count, beam), -1, dtype=np.int64)
        products = np.full((count, beam), -np.inf, dtype=np.float32)
        done = np.zeros((count, beam), dtype=bool)
        seen = np.zeros((count, n), dtype=bool)
        ids[:, 0], products[:, 0] = self.start, wanted @ self.points[self.start]
        seen[:, self.start] = True
        active = np.arange(count)
        while len(active):
            # The best WIDTH points of each beam that are not expanded yet.
            free = np.where(done[active] | (ids[active] < 0), np.inf, np.arange(beam))
            order = np.sort(free, axis=1)[:, :WIDTH]
            some = np.isfinite(order[:, 0])
            active, order = active[some], order[some]
            if not len(active):
                break
            slot = np.where(np.isfinite(order), order, order[:, :1]).astype(np.int64)
            done[active[:, None], slot] = True
            near = self.edges[ids[active[:, None], slot]].reshape(len(active), -1)
            row = np.repeat(np.arange(len(active)), near.shape[1])
            flat = near.ravel()
            fresh = (flat >= 0) & ~seen[active[row], flat]
            pair = np.unique(row[fresh] * n + flat[fresh])
            row, flat = pair // n, pair % n
            seen[active[row], flat] = True
            value = np.einsum("ij,ij->i", wanted[active[row]], self.points[flat])
            width = np.bincount(row, minlength=len(active))
            at = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
            room = int(width.max(initial=0))
            more_ids = np.full((len(active), room), -1, dtype=np.int64)
            more = np.full((len(active), room), -np.inf, dtype=np.float32)
            more_ids[row, at], more[row, at] = flat, value
            every = np.concatenate([products[active], more], axis=1)
            best = np.argsort(-every, axis=1, kind="stable")[:, :beam]
            products[active] = np.take_along_axis(every, best, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], more_ids], 1), best, 1)
            old = np.concatenate([done[active], np.zeros_like(more, dtype=bool)], 1)
            done[active] = np.take_along_axis(old, best, 1)
        return ids, products


def _pruned(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, norm: float) -> np.ndarray:
    """Up to ``DEGREE`` diverse neighbours of each point ``own`` from its candidates (-1 where none)."""
    out = np.full((len(own), DEGREE), -1, dtype=np.int64)
    for i in range(0, len(own), 500):
        part, mine = candidates[i : i + 500], own[i : i + 500]
        part = np.where(part == mine[:, None], -1, part)
        vectors = points[part]
        far = 2 * norm - 2 * np.einsum("ncd,nd->nc", vectors, points[mine])
        far[part < 0] = np.inf
        order = np.argsort(far, axis=1, kind="stable")[:, : 3 * DEGREE]
        part, far = np.take_along_axis(part, order, 1), np.take_along_axis(far, order, 1)
        part[:, 1:][part[:, 1:] == part[:, :-1]] = -1
        vectors = np.take_along_axis(vectors, order[:, :, None], 1)
        between = 2 * norm - 2 * vectors @ vectors.transpose(0, 2, 1)
        alive = part >= 0
        rows = np.arange(len(part))
        for k in range(DEGREE):
            first = alive.argmax(1)
            some = alive[rows, first]
            if not some.any():
                break
            out[i + rows[some], k] = part[some, first[some]]
            alive &= SLACK * between[rows, first] > far
            alive[rows, first] = False
    return out


def build(vectors: np.ndarray) -> Graph:
    """Graph over distinct vectors (rows)."""
    norm = float((vectors.astype(np.float64) ** 2).sum(1).max(initial=0))
    extra = np.sqrt(np.maximum(norm - (vectors.astype(np.float64) ** 2).sum(1), 0))
    points = np.concatenate([vectors, extra[:, None]], axis=1).astype(np.float32)
    n = len(points)
    start = int((points @ points.mean(0)).argmax())
    graph = Graph(points, np.full((n, DEGREE), -1, dtype=np.int64), start)
    order = np.random.default_rng(n).permutation(n)
    order = order[order != start]
    done = 0
    while done < len(order):
        batch = order[done : done + min(max(done, 16), _BATCH)]
        done += len(batch)
        found, _ = graph.search(points[batch], BUILD_BEAM)
        # In small graphs the batch itself is part of the neighbourhood.
        if done <= 2 * BUILD_BEAM:
            found = np.concatenate([found, np.tile(batch, (len(batch), 1))], axis=1)
        graph.edges[batch] = _pruned(points, batch, found, norm)
        _mirror(graph, batch, norm)
    return graph


def _mirror(graph: Graph, batch: np.ndarray, norm: float) -> None:
    """Add the edges of the batch in the other direction, pruning where they are too many."""
    source = np.repeat(batch, DEGREE)
    target = graph.edges[batch].ravel()
    source, target = source[target >= 0], target[target >= 0]
    both = np.unique(np.stack([target, source]), axis=1)
    target, source = both
    touched, first, width = np.unique(target, return_index=True, return_counts=True)
    at = np.arange(len(target)) - np.repeat(first, width)
    incoming = np.full((len(touched), int(width.max(initial=0))), -1, dtype=np.int64)
    incoming[np.repeat(np.arange(len(touched)), width), at] = source
    for i in range(0, len(touched), 500):
        own = touched[i : i + 500]
        every = np.concatenate([graph.edges[own], incoming[i : i + 500]], axis=1)
        every = -np.sort(-every, axis=1)
        every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
        every = -np.sort(-every, axis=1)
        over = (every >= 0).sum(1) > DEGREE
        kept = every[:, :DEGREE].copy()
        if over.any():
            kept[over] = _pruned(graph.points, own[over], every[over], norm)
        graph.edges[own] = kept


def _packed(shard: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A shard's graph, its vectors, and the ids of each vector, as bytes."""
    original = np.stack(rows["vector"].to_numpy()).astype(np.float64)
    ids = rows["vec_id"].to_numpy(np.int64)
    order = np.argsort(ids, kind="stable")
    original, ids = np.ascontiguousarray(original[order]), ids[order]
    # Equal vectors are one point; its ids stay in ascending order.
    keys = original.view(np.dtype((np.void, original.dtype.itemsize * original.shape[1]))).ravel()
    _, first, point = np.unique(keys, return_index=True, return_inverse=True)
    graph = build(original[first].astype(np.float32))
    out = io.BytesIO()
    np.savez(
        out, ids=ids[np.argsort(point, kind="stable")], width=np.bincount(point), vectors=original[first],
        points=graph.points, edges=graph.edges.astype(np.int32), start=graph.start,
    )
    return pd.DataFrame({"shard": [shard[0]], "graph": [out.getvalue()]})


def _answers(wanted: pd.DataFrame, graphs: pd.DataFrame, k: int, beam: int) -> pd.DataFrame:
    """The best ``k`` rows of a shard for each query of a block."""
    empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    if not len(wanted) or not len(graphs):
        return empty
    saved = np.load(io.BytesIO(graphs["graph"].iloc[0]))
    graph = Graph(saved["points"], saved["edges"].astype(np.int64), int(saved["start"]))
    ids, width, vectors = saved["ids"], saved["width"], saved["vectors"]
    begin = np.cumsum(width) - width
    # A beam holds distinct vectors; each stands for its k + 1 smallest ids at most.
    parts = []
    beam = max(beam, 2 * k)
    for i in range(0, len(wanted), _BATCH):
        part = wanted.iloc[i : i + _BATCH]
        query = np.stack(part["vector"].to_numpy()).astype(np.float64)
        flat = np.concatenate([query, np.zeros((len(query), 1))], axis=1).astype(np.float32)
        found, _ = graph.search(flat, beam)
        row = np.repeat(np.arange(len(query)), beam)
        point = found.ravel()
        row, point = row[point >= 0], point[point >= 0]
        score = np.einsum("ij,ij->i", query[row], vectors[point])
        times = np.minimum(width[point], k + 1)
        which = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        vec = ids[np.repeat(begin[point], times) + which]
        parts.append(
            pd.DataFrame(
                {
                    "query_id": part["vec_id"].to_numpy(np.int64)[np.repeat(row, times)],
                    "vec_id": vec,
                    "score": np.repeat(score, times),
                }
            )
        )
    out = pd.concat(parts)
    out = out[out["query_id"] != out["vec_id"]]
    out = out.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return out.groupby("query_id", sort=False).head(k)


def usable(rows: DataFrame) -> DataFrame:
    """``(vec_id, vector)``: one row per id, with a vector that can take part.

    Left out are null ids and vectors that are null, empty, zero, hold a null, NaN or
    infinite component, or differ in length from most of the table.  Of several vectors
    with one id the smallest is taken.
    """
    vector = F.col("embedding").cast("array<double>")
    clean = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).filter(
        "vec_id is not null and size(vector) > 0"
        " and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
        " and exists(vector, x -> x != 0)"
    )
    sizes = clean.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"))
    usual = sizes.orderBy(F.desc("n"), "size").limit(1).collect()
    size = usual[0]["size"] if usual else 0
    return clean.filter(F.size("vector") == size).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def index(vectors: DataFrame, shard: int = SHARD) -> tuple[DataFrame, int]:
    """``(shard, graph)`` over ``vectors(vec_id, vector)``, and the number of shards."""
    shards = max(1, math.ceil(vectors.count() / shard))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    graphs = dealt.repartition(shards, "shard").groupBy("shard").applyInPandas(_packed, "shard int, graph binary")
    return materialize(graphs), shards


def nearest(
    rows: DataFrame, queries: DataFrame, k: int = 20, shard: int = SHARD, block: int = BLOCK,
    beam: int = SEARCH_BEAM,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query the ``k`` rows of largest inner product found.

    Both tables hold ``vec_id`` and ``embedding``; see ``usable`` for what takes part.
    A row does not answer itself; ties go to the smaller id; fewer candidates than ``k``
    give fewer rows; empty tables give none.  Other columns are ignored.
    """
    vectors = materialize(usable(rows))
    graphs, shards = index(vectors, shard)
    wanted = usable(queries)
    blocks = max(1, math.ceil(wanted.count() / block))
    asked = wanted.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    best = asked.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInPandas(
        lambda q, g: _answers(q, g, k, beam), "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
