"""Removal of repeated passages: overlapping windows of three consecutive lines.

Windows are compared by a 128-bit hash over the whole table.  A window met before,
in the order of document ids and lines, is a repetition; the positions that a
document's repetitions cover are merged into runs and cut out.  One copy of each
line always stays: a removed line has an equal one earlier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reqsift.llm.common import let, whole_text
from reqsift.workspace import materialize

WINDOW = 3
LAST = 2**63 - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows by document: id (null last) and text; equal rows are one document.

    All columns are kept in one struct, so that none can clash with the names used here.
    """
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"),
        whole_text(F.col("text")).alias("_text"),
        F.xxhash64(whole_text(F.col("text"))).alias("_key"),
    )


def _windows(docs: DataFrame, size: int) -> DataFrame:
    """``(_id, _key, pos, hash)`` of every window that holds a word."""

    def hashes(lines):
        at = F.sequence(F.lit(1), F.size(lines) - F.lit(size - 1))
        window = F.transform(at, lambda i: F.array_join(F.slice(lines, i, size), "\n"))
        some = F.transform(
            window, lambda w: F.when(w.rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(w.cast("binary"))))
        )
        return F.when(F.size(lines) >= size, some)

    split = docs.filter(F.instr("_text", "\n") > 0).select(
        "_id", "_key", F.posexplode(let(F.split("_text", "\n", -1), hashes)).alias("pos", "hash")
    )
    return split.filter(F.col("hash").isNotNull())


def repeated_runs(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(_id, _key, runs)``: the lines to remove, as sorted runs ``(first, last)`` from 0."""
    windows = materialize(_windows(docs, size))
    place = F.struct("_id", "_key", "pos")
    first = windows.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    again = (
        windows.join(first.filter(F.col("first") != F.col("last")).select("hash", "first"), "hash")
        .filter(place != F.col("first"))
        .groupBy("_id", "_key", "pos")
        .agg(F.lit(1).alias("one"))
    )
    in_order = Window.partitionBy("_id", "_key").orderBy("pos")
    fresh = F.coalesce(F.col("pos") > F.lag("pos").over(in_order) + size, F.lit(True))
    runs = (
        again.withColumn("fresh", fresh)
        .withColumn("run", F.sum(F.col("fresh").cast("int")).over(in_order))
        .groupBy("_id", "_key", "run")
        .agg(F.min("pos").alias("first"), (F.max("pos") + (size - 1)).alias("last"))
    )
    return runs.groupBy("_id", "_key").agg(
        F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs")
    )


def remove_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs(doc_id, text, …)`` without repeated windows of ``size`` lines.

    ``text`` is the text without the removed lines; ``lines_before`` and
    ``lines_removed`` (run list) are added and replace columns of those names, all other
    columns stay.  A null text stays null and counts one empty line.  Windows of white
    space only are left alone.  Rows with equal id and text are one document, treated
    alike; null ids come last in the order.  Texts of fewer lines than a window stay.
    """
    keyed = _keyed(docs)
    runs = repeated_runs(keyed.select("_id", "_key", "_text"), size)
    joined = keyed.join(runs, ["_id", "_key"], "left")

    def rest(lines):
        n = F.size("runs")
        parts = F.transform(
            F.sequence(F.lit(0), n),
            lambda k: let(
                F.when(k == 0, F.lit(0)).otherwise(F.get(F.col("runs"), k - 1)["last"] + 1),
                lambda begin: F.slice(
                    lines,
                    begin + 1,
                    F.when(k == n, F.size(lines)).otherwise(F.get(F.col("runs"), k)["first"]) - begin,
                ),
            ),
        )
        return F.array_join(F.flatten(parts), "\n")

    lines = F.split("_text", "\n", -1)
    made = {
        "text": F.when(F.col("runs").isNull(), F.col("_row")["text"]).otherwise(let(lines, rest)),
        "lines_before": F.size(lines).cast("long"),
        "lines_removed": F.coalesce(
            F.col("runs"), F.array().cast("array<struct<first:int,last:int>>")
        ),
    }
    own = [made.pop(c) if c in made else F.col("_row")[c] for c in docs.columns]
    return joined.select(
        *[column.alias(c) for c, column in zip(docs.columns, own)],
        *[column.alias(c) for c, column in made.items()],
    )


def removed_count(runs: Column) -> Column:
    """How many lines a list of runs holds."""
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
