"""Hard negatives by angular triangle filtering.

Every row keeps its norm and its angles to a few reference directions, the means of the
most frequent labels.  By the triangle inequality on the sphere the angle between two
rows lies between the differences and the sums of their angles to each direction, which
gives an interval for the cosine and, times the norms, one for the score.  Only rows whose
interval reaches what is asked for are scored, in whole numbers.

The rows are dealt into blocks, one a task; all anchors pass by each block in small
batches, so a task holds one block and one batch.  The bests of the blocks are merged.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from reqsift.llm.vectors import matrix, products, whole
from reqsift.workspace import materialize

#: Rows of one block, the least worth a block, and anchors of one batch.
BLOCK, LEAST, BATCH = 16_384, 512, 64
#: Most reference directions.
DIRECTIONS = 8
#: What rounding may add to an angle or take from it, in single precision.
SLACK = np.float32(2e-5)


def directions(rows: DataFrame, most: int = DIRECTIONS) -> np.ndarray:
    """Unit means of the most frequent labels of ``rows(label, x)``; one axis if there are none."""
    sums = rows.select("label", F.posexplode("x").alias("at", "value")).groupBy("label", "at").agg(
        F.sum(F.col("value").cast("double")).alias("sum")
    )
    top = rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(most)
    found: dict[int, dict[int, float]] = {}
    for r in sums.join(F.broadcast(top.select("label")), "label").collect():
        found.setdefault(r["label"], {})[r["at"]] = r["sum"]
    means = [np.array([m[k] for k in sorted(m)]) for _, m in sorted(found.items())]
    units = [m / np.linalg.norm(m) for m in means if np.linalg.norm(m) > 0]
    if units:
        return np.stack(units)
    size = len(means[0]) if means else 1
    return np.eye(1, size)


def described(rows: DataFrame, units: np.ndarray) -> DataFrame:
    """``(vec_id, label, x, norm, angles)``, the angles being to each of ``units``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(2)).astype(np.float64)
            norm = np.linalg.norm(x, axis=1)
            cosine = (x / np.where(norm > 0, norm, 1)[:, None]) @ units.T
            angles = np.arccos(np.clip(cosine, -1, 1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(norm), pa.array(list(angles), pa.list_(pa.float32()))],
                names=["vec_id", "label", "x", "norm", "angles"],
            )

    schema = "vec_id long, label long, x array<long>, norm double, angles array<float>"
    return rows.select("vec_id", "label", "x").mapInArrow(work, schema)


class Rows:
    """Some described rows as arrays."""

    def __init__(self, batches: list[pa.RecordBatch]):
        columns = pa.Table.from_batches(batches).combine_chunks()
        get = lambda name: columns[name].chunk(0) if len(columns) else columns[name].combine_chunks()
        self.ids = get("vec_id").to_numpy(zero_copy_only=False)
        self.label = get("label").to_numpy(zero_copy_only=False)
        self.x = matrix(get("x"))
        self.norm = get("norm").to_numpy(zero_copy_only=False)
        self.angles = matrix(get("angles"), np.float32)


def bounds(anchors: Rows, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all anchors with all rows are surely in ``[low, high]``."""
    least = np.zeros((len(anchors.ids), len(rows.ids)), np.float32)
    most = np.full_like(least, np.float32(math.pi))
    for a, b in zip(anchors.angles.T, rows.angles.T):
        np.maximum(least, np.abs(a[:, None] - b), out=least)
        both = a[:, None] + b
        np.minimum(most, np.minimum(both, np.float32(2 * math.pi) - both), out=most)
    size = anchors.norm[:, None] * rows.norm
    wide = 1 + 4 * float(SLACK) * size
    low = np.cos(np.minimum(most + SLACK, np.float32(math.pi))) * size - wide
    high = np.cos(np.maximum(least - SLACK, np.float32(0))) * size + wide
    return low, high


def _first(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each anchor: higher scores first, ties by smaller id."""
    order = np.lexsort((ids, ~score, anchor))
    ranked = anchor[order]
    new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
    return order[rank < k]


def _kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def positives_of(anchors: Rows, rows: Rows, k: int) -> dict[str, np.ndarray]:
    """The ``k`` best rows of the anchors' own labels, among these rows."""
    low, high = bounds(anchors, rows)
    open_ = (anchors.label[:, None] == rows.label) & (anchors.ids[:, None] != rows.ids)
    for i in range(len(open_)):
        mine = np.flatnonzero(open_[i])
        open_[i, mine] = high[i, mine] >= _kth(low[i, mine], k)
    i, j = np.nonzero(open_)
    score = products(anchors.x[i], rows.x[j])
    best = _first(i, score, rows.ids[j], k)
    i, j = i[best], j[best]
    return {"anchor_id": anchors.ids[i], "positive_id": rows.ids[j], "positive_score": score[best]}


def negatives_of(
    anchors: Rows, rows: Rows, wanted: list[list[tuple[int, int]]], k: int, percent: tuple[int, int]
) -> dict[str, np.ndarray]:
    """Per anchor and wanted ``(positive id, score)``: the ``k`` best rows of other labels with
    a score between those hundredths of the positive's."""
    low, high = bounds(anchors, rows)
    parts: list[tuple[np.ndarray, ...]] = []
    for i, pairs in enumerate(wanted):
        other = np.flatnonzero(rows.label != anchors.label[i])
        least, most = low[i, other], high[i, other]
        reach = np.zeros(len(other), dtype=bool)
        windows = []
        for _, score in pairs:
            start, stop = -(-percent[0] * score // 100), percent[1] * score // 100
            windows.append((start, stop))
            if start <= stop:
                overlap = (most >= start) & (least <= stop)
                sure = least[(least >= start) & (most <= stop)]
                reach |= overlap & (most >= _kth(sure, k))
        j = other[reach]
        scores = products(np.broadcast_to(anchors.x[i], (len(j), anchors.x.shape[1])), rows.x[j])
        for (positive, score), (start, stop) in zip(pairs, windows):
            inside = np.flatnonzero((scores >= start) & (scores <= stop))
            best = inside[_first(np.zeros(len(inside), np.int64), scores[inside], rows.ids[j[inside]], k)]
            n = len(best)
            parts.append(
                (np.full(n, anchors.ids[i]), np.full(n, positive), np.full(n, score), rows.ids[j[best]], scores[best])
            )
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5
    return dict(zip(names, columns))


def _passed(anchors: DataFrame, blocks: DataFrame, count: int, answer: Callable, schema: str) -> DataFrame:
    """``answer(anchors, rows)`` of every batch of anchors at every block of rows.

    ``blocks`` has a ``block`` column; both are read as one table in which the rows of a
    block come before the anchors that pass by.
    """
    each = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    both = blocks.withColumn("turn", F.lit(0)).unionByName(each.withColumn("turn", F.lit(1)), allowMissingColumns=True)

    def answers(held: list[pa.RecordBatch], batch: pa.RecordBatch, memory: dict) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        if "rows" not in memory:
            memory["rows"] = Rows(held)
        for i in range(0, batch.num_rows, BATCH):
            found = answer(batch.slice(i, BATCH), memory["rows"])
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in found.values()], names=list(found))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, memory, block = [], {}, None
        for batch in batches:
            place = batch.column("block").to_numpy()
            turn = batch.column("turn").to_numpy()
            cuts = np.flatnonzero((place[1:] != place[:-1]) | (turn[1:] != turn[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                if place[a] != block:
                    held, memory, block = [], {}, place[a]
                if turn[a] == 0:
                    held.append(batch.slice(a, b - a))
                else:
                    yield from answers(held, batch.slice(a, b - a), memory)

    dealt = both.repartitionById(count, F.col("block")).sortWithinPartitions("block", "turn")
    return dealt.mapInArrow(work, schema)


def mined(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3,
    percent: tuple[int, int] = (50, 95), block: int = BLOCK,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Both tables hold ``vec_id``, ``label`` and ``embedding``; ``anchors`` may be part of
    ``rows``.  A score is the inner product of the vectors times 256, rounded down.  An
    anchor's positives are its best rows of the same label; for each, the best rows of
    other labels follow whose score is between those hundredths of the positive's.  Higher
    scores come first, ties by smaller id; fewer rows give fewer results.

    Rows with a null id or label, or a vector that ``vectors.whole`` leaves out, take no
    part.  Of several rows with one id that of the smallest label, then vector, is taken,
    and none is its own positive.  Other columns are ignored; empty tables give no rows.
    """
    keys = [F.col(c).cast("long").alias(c) for c in ("vec_id", "label")]

    def usable(table: DataFrame) -> DataFrame:
        kept = whole(table, *keys).filter("vec_id is not null and label is not null")
        least = kept.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("row"))
        return least.select("vec_id", "row.label", "row.x")

    taken = materialize(usable(rows))
    units = directions(taken)
    all_rows = materialize(described(taken, units))
    asked = materialize(described(usable(anchors), units))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n = all_rows.count()
    count = max(1, math.ceil(n / block), min(cores, n // LEAST))
    blocks = all_rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int"))

    def positive(batch: pa.RecordBatch, held: Rows) -> dict[str, np.ndarray]:
        return positives_of(Rows([batch]), held, positives)

    near = _passed(asked, blocks, count, positive, "anchor_id long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = near.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= positives)
    found = chosen.groupBy("anchor_id").agg(
        F.collect_list(F.struct("positive_id", "positive_score")).alias("wanted")
    )
    asking = materialize(asked.join(found, asked["vec_id"] == found["anchor_id"]).drop("anchor_id"))

    def negative(batch: pa.RecordBatch, held: Rows) -> dict[str, np.ndarray]:
        wanted = [
            [(w["positive_id"], w["positive_score"]) for w in pairs] for pairs in batch.column("wanted").to_pylist()
        ]
        return negatives_of(Rows([batch]), held, wanted, negatives, percent)

    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    hard = _passed(asking, blocks, count, negative, schema)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return hard.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
