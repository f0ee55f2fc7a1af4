"""Near-duplicate documents: a chosen-path similarity join of shingle sets.

Documents with equal sets are one class from the start.  Each class is put into the
leaves of several random trees: a node picks one of the positions of a minwise
signature (now and then two), and its classes go on to the child of their token there.
Classes that share a leaf are compared; everything found is confirmed on the full sets.

A leaf first compares its classes with one hub only, the member that agrees most with
the leaf's majority, and what that links is settled: a large group of near copies costs
one comparison per member instead of all pairs.  Leaves with members of several
components are then compared exhaustively if small.  In a large one, the few members
outside its largest component are compared with all, in blocks; if they are many, all
members are compared, in pairs of blocks.  No leaf is branched on for its size, as each
further level would lose pairs at the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reqsift.llm.common import WORD, Memo, ascii_lower, give_back, whole_text
from reqsift.operators.components import connected_components
from reqsift.workspace import materialize

SIGNATURE = 64
TREES, DEPTH = 8, 3
#: Classes of one leaf that are compared exhaustively in one go.
LEAF = 2048
#: Bins of the sketch by which pairs of a leaf are sorted out, and how many standard
#: deviations below the threshold its estimate must lie for that.
BINS, DEVIATIONS = 512, 4.5

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_ODD = np.random.default_rng(7).integers(0, 2**63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Distinct hashed shingles of whole texts."""

    def __init__(self, size: int):
        import re

        import xxhash

        self.size, self.words = size, re.compile(WORD)
        self.hash = Memo(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")))

    def shingles(self, text: str) -> np.ndarray:
        """Sorted; a text of fewer words than a shingle is one of its own, without words none."""
        words = self.words.findall(ascii_lower(text))
        if not words:
            return np.zeros(0, dtype=np.uint64)
        codes = np.fromiter(map(self.hash.__getitem__, words), dtype=np.uint64, count=len(words))
        width = min(self.size, len(codes))
        joined = np.full(len(codes) - width + 1, width, dtype=np.uint64)
        for k in range(width):
            joined = _mix(joined * _A + codes[k : len(codes) - width + 1 + k] * _B)
        return np.unique(joined)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minwise tokens of a set, one per position."""
    least = np.full(SIGNATURE, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(shingles), 1024):
        part = shingles[i : i + 1024, None] * _ODD
        np.minimum(least, part.min(0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One byte for the least shingle of each bin, 0 for an empty bin.

    Shingles are dealt into bins by a hash, so sets smaller than the sketch are told
    apart nearly exactly.
    """
    mixed = np.sort(_mix(shingles * _C))
    bins = (mixed & np.uint64(BINS - 1)).astype(np.int64)
    out = np.zeros(BINS, dtype=np.uint8)
    # Written from the largest down, so that the least of a bin stays.
    out[bins[::-1]] = (1 + (mixed >> np.uint64(9)) % np.uint64(255)).astype(np.uint8)[::-1]
    return out


def may_be_similar(
    one: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray, threshold: float
) -> np.ndarray:
    """Which of the sketches ``others`` are not surely below the threshold with ``one``.

    The fewer shingles of both sets share their bins, the surer is the estimate.
    """
    equal = ((others == one) & (one != 0)).sum(1)
    filled = np.maximum(((others | one) != 0).sum(1), 1)
    union = (size + sizes) / (1 + threshold)
    unseen = np.clip(1 - filled / union, 0, 1) + 0.05
    slack = DEVIATIONS * np.sqrt(threshold * (1 - threshold) * unseen / filled) + 1 / filled
    return equal >= (threshold - slack) * filled


def _described(docs: DataFrame, size: int) -> DataFrame:
    """``(doc_id, n, cls, sig, bits)`` per row; ``cls`` is a 128-bit hash of the shingle
    set, and ``bits`` has the lowest bit of each minwise token."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            n, cls, sig, bits = [], [], [], []
            for text in batch.column(1):
                shingles = shingler.shingles(text.as_py())
                some = len(shingles) > 0
                n.append(len(shingles))
                cls.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if some else None)
                tokens = signature(shingles) if some else None
                sig.append(tokens.tobytes() if some else None)
                low = np.packbits(tokens & 1).view("<i8")[0] if some else None
                bits.append(int(low) if some else None)
            columns = {"n": n, "cls": cls, "sig": sig, "bits": bits}
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns.values(), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *columns])
        del shingler
        give_back()

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(F.col("text")).alias("text"))
    return chosen.mapInArrow(work, "doc_id long, n long, cls binary, sig binary, bits long")


def _children(node: np.ndarray, row: np.ndarray, sig: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Children of (node, row) pairs: one chosen position each, and a second for a share ``rate``."""
    h = _mix(node ^ _C)
    one = (h % np.uint64(SIGNATURE)).astype(np.int64)
    two = (one + 1 + ((h >> np.uint64(20)) % np.uint64(SIGNATURE - 1)).astype(np.int64)) % SIGNATURE
    both = (h >> np.uint64(40)).astype(np.float64) < rate * 2**24

    def child(n, r, at):
        return _mix(n * _A + sig[r, at].astype(np.uint64) * _B + at.astype(np.uint64))

    nodes = np.concatenate([child(node, row, one), child(node[both], row[both], two[both])])
    return nodes, np.concatenate([row, row[both]])


def _branched(classes: DataFrame, levels: int, threshold: float, trees: int) -> DataFrame:
    """``(node, cid, n, bits)`` ``levels`` below the roots of ``trees``."""
    rate = 1 / threshold - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").reshape(-1, SIGNATURE)
            row = np.tile(np.arange(batch.num_rows), trees)
            node = np.repeat(_mix(np.arange(1, trees + 1, dtype=np.uint64)), batch.num_rows)
            for _ in range(levels):
                node, row = _children(node, row, sig, rate)
            own = [batch.column(k).take(pa.array(row)) for k in (0, 1, 3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(node.view(np.int64)), *own], names=["node", "cid", "n", "bits"]
            )

    return classes.select("cid", "n", "sig", "bits").mapInArrow(work, "node long, cid long, n long, bits long")


def _with_hubs(nodes: DataFrame) -> DataFrame:
    """Members of nodes that hold several, with the node's ``size`` and ``hub``.

    The majority of each signature bit in a node shows what its members have in common;
    the member closest to it is the likeliest to be near the others.
    """
    ones = [F.sum(F.shiftrightunsigned("bits", k).bitwiseAND(F.lit(1))).alias(f"one{k}") for k in range(SIGNATURE)]
    stats = nodes.groupBy("node").agg(F.count("*").alias("size"), *ones).filter("size > 1")
    majority = reduce(
        lambda x, y: x.bitwiseOR(y),
        [
            F.when(F.col(f"one{k}") * 2 > F.col("size"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))
            for k in range(SIGNATURE)
        ],
    )
    placed = nodes.join(stats.select("node", "size", majority.alias("majority")), "node").withColumn(
        "apart", F.bit_count(F.col("bits").bitwiseXOR(F.col("majority")))
    )
    placed = materialize(placed.select("node", "cid", "n", "size", "apart"))
    best = F.min(F.struct("apart", F.xxhash64("cid").alias("turn"), "cid", "n"))
    return placed.drop("apart").join(placed.groupBy("node").agg(best.alias("hub")), "node")


def _sizes_allow(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are as similar as asked."""

    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right):
            out.append(_similar(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8"), percent))
        return pa.array(out, pa.bool_())

    of = {k: sets.select(F.col("cid").alias(k), F.col("shingles").alias("set_" + k)) for k in "ab"}
    joined = pairs.join(of["b"], "b").join(of["a"], "a")
    return materialize(joined.filter(similar("set_a", "set_b")).select("a", "b"))


def _full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``(cid, shingles)`` of the wanted classes ``(cid, cls, want_id)``, from one row of each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            cids, sets = [], []
            for text, cls, cid in zip(*batch.columns):
                raw = shingler.shingles(text.as_py()).tobytes()
                if hashlib.blake2b(raw, digest_size=16).digest() == cls.as_py():
                    cids.append(cid.as_py())
                    sets.append(raw)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cids, pa.int64()), pa.array(sets, pa.binary())], names=["cid", "shingles"]
            )
        del shingler
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("first_id"), whole_text(F.col("text")).alias("text"))
    rows = rows.join(wanted, F.col("first_id").eqNullSafe(F.col("want_id"))).select("text", "cls", "cid")
    sets = rows.mapInArrow(work, "cid long, shingles binary")
    return materialize(sets.groupBy("cid").agg(F.first("shingles").alias("shingles")))


def _labels(links: DataFrame) -> DataFrame:
    """``(cid, label)`` of linked classes."""
    found = connected_components(links.select(F.lit(0).alias("project"), F.col("a").alias("src"), F.col("b").alias("dst")))
    return materialize(found.select(F.col("node").alias("cid"), F.col("component").alias("label")))


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are as similar as asked."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _joining(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between members ``(node, cid, label, shingles)`` of a node, confirmed on their sets.

    Members already joined, by label or by a link before, are not compared, so there are
    fewer links than members.
    """
    if len(rows) < 2:
        return []
    threshold = percent / 100
    sets = [np.frombuffer(r[3], "<u8") for r in rows]
    sketches, n = np.stack([sketch(s) for s in sets]), np.array([len(s) for s in sets])
    group = np.unique([r[2] for r in rows], return_inverse=True)[1]
    out = []
    for i in range(len(rows) - 1):
        later = slice(i + 1, None)
        open_ = group[later] != group[i]
        open_ &= np.minimum(n[later], n[i]) >= (threshold - 1e-9) * np.maximum(n[later], n[i])
        at = np.flatnonzero(open_) + i + 1
        if len(at):
            at = at[may_be_similar(sketches[i], n[i], sketches[at], n[at], threshold)]
        for j in at.tolist():
            if group[j] != group[i] and _similar(sets[i], sets[j], percent):
                group[group == group[j]] = group[i]
                out.append(tuple(sorted((rows[i][1], rows[j][1]))))
    return out


def _exhaustive(percent: int):
    """Within each node of sorted rows: confirmed links that join its components."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        found: list[tuple[int, int]] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    found += _joining(held, percent)
                    held = []
                held.append(row)
            if found:
                yield _pair_batch(found)
                found = []
        if found := _joining(held, percent):
            yield _pair_batch(found)
        held.clear()
        give_back()

    return work


def _pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], names=["a", "b"])


def _few_against_all(rows: DataFrame) -> DataFrame:
    """Large nodes cut into blocks of the largest component's members, each with all others."""
    count = F.ceil(F.col("size") / F.lit(LEAF)).cast("int")
    own = F.array(F.pmod(F.xxhash64("cid"), count).cast("int"))
    block = F.explode(F.when(F.col("label") == F.col("main"), own).otherwise(F.sequence(F.lit(0), count - 1)))
    return rows.withColumn("block", block).withColumn("node", F.xxhash64("node", "block")).drop("block")


def _all_blocks(rows: DataFrame) -> DataFrame:
    """Large nodes cut into blocks; one node per pair of blocks holds the members of both."""
    count = F.ceil(F.col("size") / F.lit(LEAF // 2)).cast("int")
    cut = rows.withColumn("block", F.pmod(F.xxhash64("cid"), count).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), count - 1))
    )
    pair = F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other"))
    return cut.withColumn("node", pair).drop("block", "other")


def components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs(doc_id, text, …)``.

    Documents are linked if their sets of distinct shingles of ``words`` words
    (lower-cased A-Z) have a Jaccard similarity of at least ``percent`` hundredths;
    ``component_id`` is the smallest id of what is linked, directly or not.

    Texts without a word, and null ones, have an empty set and are linked with nothing.
    Shorter texts are one shingle.  Null ids take part, but name no component unless
    it has no other id.  Rows that share an id stand or fall together: ``kept`` only says
    whether the id is its component's.  Other columns are ignored; an empty table gives
    no rows.
    """
    threshold = percent / 100
    rows = materialize(_described(docs, words))
    classes = materialize(
        rows.filter("n > 0").groupBy("cls").agg(
            F.min("doc_id").alias("first_id"),
            *[F.first(c).alias(c) for c in ("n", "sig", "bits")],
        ).withColumn("cid", F.monotonically_increasing_id())
    )
    members = materialize(_with_hubs(_branched(classes, DEPTH, threshold, TREES).distinct()))
    wanted = members.select("cid").distinct().join(classes, "cid")
    sets = _full_sets(docs, wanted.select("cid", "cls", F.col("first_id").alias("want_id")), words)

    links = _confirmed(_to_hubs(members, percent), sets, percent)
    # The components so far only spare comparisons.
    mixed = _mixed(members.filter("size > 2"), _labels(links))
    large = mixed.filter(F.col("size") > LEAF)
    leaves = [
        mixed.filter(F.col("size") <= LEAF),
        _few_against_all(large.filter(F.col("others") <= LEAF)),
        _all_blocks(large.filter(F.col("others") > LEAF)),
    ]
    leaf = reduce(DataFrame.unionByName, [x.select("node", "cid", "label") for x in leaves])
    joined = (
        leaf.join(sets, "cid").select("node", "cid", "label", "shingles")
        .repartition("node").sortWithinPartitions("node", "cid")
        .mapInArrow(_exhaustive(percent), "a long, b long").distinct()
    )
    links = links.unionByName(materialize(joined))

    labels = _labels(links)
    named = classes.select("cid", "cls", "first_id").join(labels, "cid", "left").withColumn(
        "label", F.coalesce("label", "cid")
    )
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_class = named.join(least, "label").select("cls", "component_id")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(by_class, "cls", "left")
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of nodes that hold several components, with their ``label``, the node's largest
    one as ``main`` and how many are in ``others``."""
    labelled = members.drop("hub").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    sizes = labelled.groupBy("node", "label").agg(F.count("*").alias("times"))
    spread = sizes.groupBy("node").agg(
        F.max(F.struct("times", "label")).alias("top"), F.sum("times").alias("all")
    ).filter(F.col("top.times") < F.col("all"))
    tops = spread.select("node", F.col("top.label").alias("main"), (F.col("all") - F.col("top.times")).alias("others"))
    return materialize(labelled.join(tops, "node").select("node", "cid", "label", "main", "others", "size"))


def _to_hubs(members: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (hub, member) of all nodes whose sizes allow the similarity."""
    return (
        members.filter(F.col("cid") != F.col("hub.cid"))
        .filter(_sizes_allow("n", "hub.n", percent))
        .select(F.least("cid", "hub.cid").alias("a"), F.greatest("cid", "hub.cid").alias("b"))
        .distinct()
    )
