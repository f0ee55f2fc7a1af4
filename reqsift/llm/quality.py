"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

A rule rejects a document whose score lies above the rule's cutoff.  Cutoffs come
from a fixed grid, so all labelled documents are a holdout.  Each rule proposes for a
stratum its lowest cutoff at which, by the exact binomial tail, a true rate of rejected
good documents above ``RISK`` is refuted.  Then the rules are taken together, in their
order: a rule acts if the same is refuted of all documents that it or a rule before it
rejects, at ``LEVEL`` divided by the number of all settings that the rules could take in
all strata.  So whichever setting was proposed, the chance that in any stratum more than
``RISK`` of the good documents are rejected, by all rules together, is ``LEVEL`` at most.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from reqsift.llm.common import WORD, let, whole_text, words
from reqsift.workspace import materialize

#: Largest rate of good documents that the rules may reject in a stratum, and the
#: chance of exceeding it in any of them.
RISK, LEVEL = 0.02, 0.05
#: Rows of a table of cutoffs up to which it is sent to all tasks.
SMALL = 10_000


@dataclass(frozen=True)
class Rule:
    """Score as an integer SQL expression over the counts, and the cutoffs it may take."""

    name: str
    score: str
    cutoffs: tuple[int, ...]


RULES = (
    Rule("symbols", "1000 * n_symbols div n_words", (10, 20, 50, 100, 150, 200, 300, 400, 500, 700)),
    Rule("lines", "1000 * n_dup_lines div n_lines", (50, 100, 150, 200, 250, 300, 400, 500, 600, 800)),
    Rule("repeats", "1000 * n_repeat_words div n_words", (20, 50, 100, 150, 200, 250, 300, 400)),
    Rule("long_words", "100 * word_chars div n_words", (700, 800, 900, 1000, 1200, 1500, 2000)),
    Rule("short_words", "greatest(0, 1000 - 100 * word_chars div n_words)", (600, 650, 700, 750, 800)),
)


def repeat_words(in_order: Column) -> Column:
    """Words lying in a 3-word window that the array holds twice or more, in linear memory.

    Windows are compared by a 64-bit hash within one text.
    """

    def covered(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def positions(by_hash: Column) -> Column:
            def twice(x: Column, j: Column) -> Column:
                before = F.get(by_hash, j - 1)["h"]
                after = F.get(by_hash, j + 1)["h"]
                return x["h"].eqNullSafe(before) | x["h"].eqNullSafe(after)

            return F.sort_array(F.transform(F.filter(by_hash, twice), lambda x: x["i"]))

        def total(at: Column) -> Column:
            steps = F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda n, s: n + s)

        def unwrapped(by_hash: Column) -> Column:
            return let(positions(by_hash), total)

        some = let(F.sort_array(placed), unwrapped)
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), some).otherwise(F.lit(0).cast("long"))

    def windows(ws: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(ws) - 3)
        return F.transform(at, lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))

    return let(
        in_order,
        lambda ws: F.when(F.size(ws) >= 3, let(windows(ws), covered)).otherwise(F.lit(0).cast("long")),
    )


def counts(text: Column) -> Column:
    """Struct of the counts that the rules use, over the whole text; a null text is empty."""

    def of_words(ws: Column) -> list[Column]:
        return [F.size(ws).cast("long").alias("n_words"), repeat_words(ws).alias("n_repeat_words")]

    def of_lines(ls: Column) -> list[Column]:
        n = F.size(ls).cast("long")
        return [n.alias("n_lines"), (n - F.size(F.array_distinct(ls))).alias("n_dup_lines")]

    text = whole_text(text)
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    chars = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    return F.struct(
        chars.cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        let(words(text), lambda ws: F.struct(*of_words(ws))).alias("words"),
        let(lines, lambda ls: F.struct(*of_lines(ls))).alias("lines"),
    )


def described(docs: DataFrame, stratum: str) -> DataFrame:
    """``(doc_id, stratum, n_words, …, base_failed, scores)`` for every row; scores are null without a word."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
        counts(F.col("text")).alias("c"),
    ).select("doc_id", "stratum", "c.words.*", "c.word_chars", "c.n_symbols", "c.lines.*")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scores = F.array(*[F.expr(r.score).cast("long") for r in RULES])
    return rows.withColumns({"base_failed": failed, "scores": F.when(F.col("n_words") > 0, scores)})


def tail(n: Column, k: Column, rate: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, rate), exactly summed in logarithms; meant for k below n * rate."""
    odds = math.log(rate / (1 - rate))
    first = n * math.log1p(-rate)
    start = F.struct(first.alias("term"), first.alias("sum"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        high, low = F.greatest(a["sum"], term), F.least(a["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(steps, start, step)["sum"])


def cutoffs(good: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """``(stratum, rule, cutoff)`` for each rule that may act, from good documents ``(stratum, scores)``.

    Only counts by stratum, rule and place in the grid are gathered.
    """
    grid = F.array(*[F.array(*[F.lit(c).cast("long") for c in r.cutoffs]) for r in RULES])
    placed = good.select("stratum", F.posexplode("scores").alias("rule", "score"))
    over = F.size(F.filter(F.get(grid, F.col("rule")), lambda c: c < F.col("score")))
    counted = placed.groupBy("stratum", "rule", over.alias("over")).agg(F.count("*").alias("n"))
    tried = counted.select(
        "stratum", "rule", "over", "n", F.posexplode(F.get(grid, F.col("rule"))).alias("place", "cutoff")
    ).groupBy("stratum", "rule", "cutoff").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("over") > F.col("place"), F.col("n")).otherwise(0)).alias("k")
    )
    tests = good.agg(F.countDistinct("stratum").alias("strata")).select(
        (F.col("strata") * sum(len(r.cutoffs) for r in RULES)).alias("tests")
    )
    valid = (F.col("k") < F.col("n") * risk) & (tail(F.col("n"), F.col("k"), risk) * F.col("tests") <= level)
    # One row with the number of tests goes to every row.
    return tried.join(F.broadcast(tests)).filter(valid).groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def together(good: DataFrame, proposed: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """The ``proposed`` cutoffs of the rules that may act together, from good documents ``(stratum, scores)``.

    Only counts by stratum and first rejecting rule are gathered.
    """
    settings = math.prod(len(r.cutoffs) + 1 for r in RULES)
    above = F.filter("cutoffs", lambda c: F.get(F.col("scores"), c["rule"]) > c["cutoff"])
    firsts = with_cutoffs(good, proposed).select(
        "stratum", F.array_min(F.transform(above, lambda c: c["rule"])).alias("first")
    ).groupBy("stratum", "first").agg(F.count("*").alias("n"))
    of_stratum = firsts.groupBy("stratum").agg(
        F.sum("n").alias("n"), F.collect_list(F.struct("first", F.col("n").alias("m"))).alias("firsts")
    )
    strata = of_stratum.agg(F.count("*").alias("strata"))
    rejected = F.aggregate(
        F.filter("firsts", lambda f: f["first"] <= F.col("rule")), F.lit(0).cast("long"), lambda k, f: k + f["m"]
    )
    tried = proposed.join(of_stratum, "stratum").withColumn("k", rejected)
    tests = F.col("strata") * settings
    valid = (F.col("k") < F.col("n") * risk) & (tail(F.col("n"), F.col("k"), risk) * tests <= level)
    # One row with the number of strata goes to every row.
    return tried.join(F.broadcast(strata)).filter(valid).select("stratum", "rule", "cutoff")


def with_cutoffs(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows with the list of their stratum's cutoffs; ``chosen`` is a written table.

    It goes to every task while it is small, so that a stratum of any size stays spread.
    """
    own = chosen.groupBy("stratum").agg(F.collect_list(F.struct("rule", "cutoff")).alias("cutoffs"))
    return rows.join(F.broadcast(own) if chosen.count() <= SMALL else own, "stratum", "left")


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """Every row of ``docs(doc_id, text, <stratum>, …)`` with its counts, ``base_failed`` and ``kept``.

    ``labels(doc_id, quality, …)`` marks good documents by 1; a document counts as good
    if all its labels do.  Good documents that fail the base take no part in choosing
    cutoffs.  A null stratum is one of its own; in a stratum without labels no rule
    acts.  Null and empty texts fail the base.  Null ids have no label; repeated rows are
    judged, and counted as labelled, each for itself; other columns are ignored.
    """
    rows = materialize(described(docs, stratum))
    quality = labels.filter("doc_id is not null and quality is not null").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")
    ).agg(F.min("quality").alias("quality"))
    good = rows.filter("not base_failed").join(quality.filter("quality = 1"), "doc_id", "left_semi")
    good = materialize(good.select("stratum", "scores"))
    proposed = materialize(cutoffs(good, risk, level))
    joined = with_cutoffs(rows, materialize(together(good, proposed, risk, level)))
    above = F.exists("cutoffs", lambda c: F.get(F.col("scores"), c["rule"]) > c["cutoff"])
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(above, F.lit(False)))
