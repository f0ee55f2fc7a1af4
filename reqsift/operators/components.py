"""Connected components, and cutting a graph into groups of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reqsift.workspace import materialize

#: Rows of members and links that a group of small components is to have.
GROUP_ROWS = 2_000


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the smallest node around it."""
    both = links.unionByName(
        links.select("project", F.col("dst").alias("src"), F.col("src").alias("dst"))
    )
    least = both.groupBy("project", "src").agg(F.min("dst").alias("least"))
    return (
        both.join(least, ["project", "src"])
        .filter(F.col("dst") > F.col("src"))
        .select("project", F.col("dst").alias("src"), F.least("src", "least").alias("dst"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the smallest of them."""
    least = links.groupBy("project", "src").agg(F.min("dst").alias("least"))
    joined = links.join(least, ["project", "src"])
    return (
        joined.select("project", F.col("dst").alias("src"), F.col("least").alias("dst"))
        .filter(F.col("src") != F.col("dst"))
        .unionByName(least.select("project", "src", F.col("least").alias("dst")))
        .distinct()
    )


def connected_components(links: DataFrame) -> DataFrame:
    """``(project, node, component)`` for undirected ``(project, src, dst)`` links.

    Alternating large-star and small-star steps (Kiveris et al. 2014): the
    number of links never grows and rounds are about logarithmic.  A round that leaves
    the number of links and two digests of them as they were has changed nothing.
    """
    def state(links: DataFrame) -> tuple:
        row = ["project", "src", "dst"]
        return tuple(links.agg(
            F.count("*"), F.bit_xor(F.xxhash64(*row)), F.bit_xor(F.xxhash64(F.lit(1), *row))
        ).first())

    current = materialize(
        links.select(
            "project", F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
        )
        .filter(F.col("src") != F.col("dst"))
        .distinct()
    )
    before = state(current)
    while True:
        after = materialize(_small_star(_large_star(current)))
        now = state(after)
        if now == before:
            break
        current, before = after, now
    return (
        after.select("project", F.col("src").alias("node"), F.col("dst").alias("component"))
        .unionByName(
            after.select("project", F.col("dst").alias("node"), F.col("dst").alias("component"))
        )
        .distinct()
    )


def separate_parts(links: DataFrame, limit: int) -> DataFrame:
    """``(project, node, component)`` for links, parting only projects of more than ``limit`` links.

    What one task can hold whole needs no search for its components: all nodes of such a
    project share its least one as their component.
    """
    sizes = links.groupBy("project").agg(
        F.count("*").alias("_links"), F.least(F.min("src"), F.min("dst")).alias("component")
    )
    whole = materialize(sizes).withColumn("_over", F.col("_links") > limit).drop("_links")
    over = whole.filter("_over").select("project")
    nodes = links.select("project", F.col("src").alias("node")).unionByName(
        links.select("project", F.col("dst").alias("node"))
    )
    labels = nodes.distinct().join(whole.filter("not _over").drop("_over"), "project")
    if over.isEmpty():
        return labels
    return labels.unionByName(connected_components(links.join(over, "project", "left_semi")))


def joined_components(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``labels(project, node, component)`` after adding links ``(project, src, dst)``, and
    ``(project, component)`` of the components that the new links touch.

    Only the components that the links join are labelled anew, as nodes of a small graph.
    """
    own = {k: labels.toDF("project", k, f"{k}_label") for k in ("src", "dst")}
    named = materialize(
        links.select("project", "src", "dst").distinct()
        .join(own["src"], ["project", "src"], "left")
        .join(own["dst"], ["project", "dst"], "left")
        .select(
            "project", "src", "dst",
            F.coalesce("src_label", "src").alias("a"), F.coalesce("dst_label", "dst").alias("b"),
        )
    )
    met = connected_components(named.select("project", F.col("a").alias("src"), F.col("b").alias("dst")))
    moved = materialize(met.toDF("project", "component", "_into"))
    into = F.coalesce("_into", "component")
    fresh = named.select("project", F.col("src").alias("node"), F.col("a").alias("component")).unionByName(
        named.select("project", F.col("dst").alias("node"), F.col("b").alias("component"))
    )
    every = labels.unionByName(fresh).distinct().join(moved, ["project", "component"], "left")
    touched = named.select("project", F.col("a").alias("component")).distinct()
    touched = touched.join(moved, ["project", "component"], "left")
    return (
        materialize(every.select("project", "node", into.alias("component"))),
        materialize(touched.select("project", into.alias("component")).distinct()),
    )


def bounded_groups(
    members: DataFrame, links: DataFrame, limit: int, labels: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, bool]:
    """Add ``grp`` to members ``(project, node, …)`` and links ``(project, src, dst, …)``.

    A group holds whole connected components of one project, as many as make up about
    ``GROUP_ROWS`` rows.  ``grp`` is null for components of more than ``limit`` rows; the
    last result tells whether there are any.  ``labels(project, node, component)`` may be
    given where they are known.
    """
    if labels is None:
        labels = materialize(connected_components(links))
    members = members.join(labels, ["project", "node"], "left")
    members = members.withColumn("component", F.coalesce("component", "node"))
    links = links.join(labels.toDF("project", "src", "component"), ["project", "src"])
    sizes = materialize(
        members.select("project", "component").unionByName(links.select("project", "component"))
        .groupBy("project", "component").agg(F.count("*").alias("_rows"))
    )
    over = sizes.filter(F.col("_rows") > limit).select("project", "component", F.lit(True).alias("_over"))
    counts = sizes.groupBy("project").agg(F.ceil(F.sum("_rows") / GROUP_ROWS).cast("int").alias("_groups"))

    def dealt(df: DataFrame) -> DataFrame:
        group = F.pmod(F.xxhash64("component"), F.col("_groups")).cast("long")
        marked = df.join(counts, "project").join(over, ["project", "component"], "left")
        return marked.withColumn("grp", F.when(F.col("_over").isNull(), group)).drop("_over", "_groups", "component")

    return dealt(members), dealt(links), not over.isEmpty()
