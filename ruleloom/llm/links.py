"""Classes of near-equal texts from candidate buckets: candidate pairs, exact verification, components.

Everything stays in tables: no links, components or buckets reach the driver, only counts. A bucket of n
nodes is never expanded into rows for its n^2 pairs. Each of ``ROUNDS`` rounds pairs a node with one other
node of its bucket, the likeliest centre of a group of near copies, unless both are known to be connected
already; verified pairs then merge components. Buckets that still hold several components are then settled
exactly, so that no link between components is lost: groups of at most ``FEW`` nodes pair by pair. Larger
ones are first grouped anew by what a link needs: two sets of similarity t share one of their
``size - ceil(t * size) + 1`` rarest items, so nodes that share none of these with another component go, and
the others fall into smaller groups. What is left meets in blocks of a bounded number of nodes and items,
two blocks in a task, which returns only a spanning forest of their links.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import discard, written

ROUNDS, FEW = 2, 32
BLOCK_ITEMS, BLOCK_NODES = 250_000, 2_000  # of a block; two blocks and their overlaps fit a task


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total > 0, both / total).otherwise(0.0)


def components(edges: DataFrame, name: str = "components", rows: int | None = None) -> DataFrame:
    """``node, component`` for every node of ``edges (a, b)``; the component is its smallest node.

    Alternating large-star and small-star steps, each written to the shared folder, until all are stars; the number
    of steps follows the logarithm of the longest path. No step makes more edges than it gets; ``rows`` is the
    number of edges at most, if it is known.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = written(e, name, rows)
    while True:
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(e.select("b", F.lit(0)))
        loose = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).where("ups > 1 or ups = 1 and low = 0")
        if not loose.take(1):
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        last, e = e, written(small.where("a <> b").distinct(), name, e.count())
        discard(last)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


def link(entries: DataFrame, sets: DataFrame, threshold: float, name: str) -> DataFrame:
    """``node, component`` for nodes with at least one verified link.

    ``entries (bucket, node, size)`` holds buckets of two or more nodes, ``sets (node, items)`` the
    distinct items of each node. Two nodes are linked if the Jaccard similarity of their items is at
    least ``threshold``.
    """
    close = F.least("size", "other_size") >= threshold * F.greatest("size", "other_size") - 1e-9
    edges = tested = comp = None
    n_entries, n_edges = entries.count(), 0
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n"))
    shared = entries.join(sizes, "bucket").groupBy("node").agg(F.sum("n").alias("shared"))
    ranked = written(entries.join(shared, "node"), f"{name}-ranked", n_entries)

    def verified(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(sets.withColumnRenamed("items", "a_items"), pairs["a"] == sets["node"]).drop("node")
        with_b = with_a.join(sets.withColumnRenamed("items", "b_items"), with_a["b"] == sets["node"]).drop("node")
        return with_b.select("a", "b", (jaccard(F.col("a_items"), F.col("b_items")) >= threshold - 1e-9).alias("linked"))

    def labelled() -> DataFrame:
        """Entries of the buckets that still hold several components, with each node's component."""
        own = ranked.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = own.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        return written(own.join(several.select("bucket"), "bucket", "left_semi"), f"{name}-open", n_entries)

    def add(pairs: DataFrame) -> DataFrame:
        """The links among pairs that weren't tested yet."""
        nonlocal tested
        pairs = pairs.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        result = written(verified(pairs), f"{name}-pairs")
        tested = result.select("a", "b") if tested is None else tested.union(result.select("a", "b"))
        return result.where("linked").select("a", "b")

    def merge(linked: DataFrame) -> None:
        nonlocal edges, n_edges, comp
        n = linked.count()
        if comp is None or n:
            edges, n_edges = linked if edges is None else edges.union(linked), n_edges + n
            comp = written(components(edges, f"{name}-stars", n_edges), f"{name}-components", 2 * n_edges)

    for round_ in range(ROUNDS):
        now = labelled() if round_ else ranked.withColumn("component", F.col("node"))
        # The node that shares most buckets with others is the likeliest centre of a group of near copies.
        able = now.where(F.pmod(F.xxhash64("node"), F.lit(3)) == round_ % 3) if round_ else now
        first = able.groupBy("bucket").agg(F.max_by(F.struct("node", "size", "component", "shared"), F.struct("shared", "node")).alias("r"))
        pairs = now.join(first, "bucket").where("component <> r.component").withColumn("other_size", F.col("r.size")).where(close)
        if round_ == 0:  # most buckets of a node have the same centre
            pairs = pairs.groupBy("node").agg(F.max_by("r.node", F.struct("r.shared", "r.node")).alias("other"))
        merge(add(pairs.select("node", F.col("other") if round_ == 0 else F.col("r.node").alias("other"))))

    now = labelled()
    lowest = now.groupBy("bucket").agg(F.min("node").alias("b"))
    near = now.join(lowest, "bucket").select(F.col("node").alias("a"), "b")
    groups = written(components(near, f"{name}-groups", n_entries), f"{name}-groups", n_entries)
    member = now.select("node", "size", "component").distinct().join(groups.withColumnRenamed("component", "group"), "node")
    counts = member.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("items"))
    member = written(member.join(counts, "group"), f"{name}-members", n_entries)
    few = now.join(member.where(F.col("n") <= FEW).select("node"), "node", "left_semi")
    other = few.select("bucket", F.col("node").alias("other"), F.col("size").alias("other_size"), F.col("component").alias("other_component"))
    found = add(few.join(other, "bucket").where("component < other_component").where(close).select("node", "other"))
    many = member.where(F.col("n") > FEW)
    if many.take(1):  # no group of these has a node of the others, so both are merged at once
        smaller = written(_regrouped(many, sets, threshold, name), f"{name}-groups", n_entries)
        found = found.union(written(_blocked(smaller, sets, threshold), f"{name}-blocked"))
    merge(found)
    return comp


def _regrouped(members: DataFrame, sets: DataFrame, threshold: float, name: str) -> DataFrame:
    """``node, size, component, group, n, items``: members that share a rare item with another component, in new groups.

    The order of rarity puts items of a single component first, which no link needs, and items of over a third of about
    ``FEW`` of a group's nodes last. Any one order for a whole group finds all links, so these nodes decide on rows
    only: their frequent items, at most three times as many as such a node has on average, stay in an array, and only
    what else any node holds is made into rows, once, and counted.
    """
    own = members.select("node", "group", "component", "n").join(sets, "node")
    some = own.where(F.pmod(F.xxhash64("node", F.lit(4)), F.ceil(F.col("n") / FEW)) == 0)
    held = some.select("group", F.explode("items").alias("item")).groupBy("group", "item").agg(F.count("*").alias("often"))
    held = held.join(some.groupBy("group").agg(F.count("*").alias("of")), "group").where("often * 3 > of")
    held = written(held.select("group", "item", F.lit(True).alias("common")), f"{name}-held")
    common = held.groupBy("group").agg(F.collect_list("item").alias("__common"))
    none = F.array().cast("array<bigint>")
    own = own.join(common, "group", "left").withColumn("__common", F.coalesce("__common", none))
    rest = written(own.select("node", "group", "component", F.explode(F.array_except("items", "__common")).alias("item")), f"{name}-rest")
    counts = rest.groupBy("group", "item").agg(F.count("*").alias("often"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    shared = counts.where("lo < hi").select("group", "item", "often", F.lit(False).alias("common"))
    shared = written(shared.unionByName(held, allowMissingColumns=True), f"{name}-shared")
    seldom = rest.join(shared.where("not common"), ["group", "item"]).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("often", "item"))).alias("__seldom"))
    of = F.size("items")
    ordered = own.withColumn("__last", F.array_sort(F.array_intersect("items", "__common"))).join(seldom, "node", "left")
    ordered = ordered.withColumn("__order", F.concat(F.coalesce(F.col("__seldom")["item"], none), "__last"))
    alone = of - F.size("__order")  # items that come before these
    rarest = of - F.ceil(F.lit(threshold) * of - 1e-9) + 1
    prefix = ordered.select("node", "group", "component", F.explode(F.slice("__order", F.lit(1), F.greatest(rarest - alone, F.lit(0)).cast("int"))).alias("item"))
    prefix = written(prefix, f"{name}-prefix")
    met = prefix.groupBy("group", "item").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("node").alias("b")).where("lo < hi").select("group", "item", "b")
    groups = components(prefix.join(met, ["group", "item"]).select(F.col("node").alias("a"), "b"), f"{name}-regrouped", prefix.count())
    found = members.select("node", "size", "component").join(groups.withColumnRenamed("component", "group"), "node")
    return found.join(found.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("items")), "group")


def _blocked(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links ``a, b`` between components of large groups; blocks of a group's nodes meet in pairs.

    Each task holds two blocks of about ``BLOCK_ITEMS`` items and ``BLOCK_NODES`` nodes at most and returns a
    spanning forest of the links that it finds, so pairs are compared but never made into rows.
    """
    blocks = F.ceil(F.greatest(F.col("items") / F.lit(BLOCK_ITEMS), F.col("n") / F.lit(BLOCK_NODES))).cast("int")
    own = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")).drop("items", "n", "size")
    dealt = own.join(sets, "node").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("group", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "component", "items")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = pdf["i"].iloc[0], pdf["j"].iloc[0]
        a, b = pdf[pdf["block"] == one], pdf[pdf["block"] == two]
        parent = {c: c for c in pdf["component"]}

        def root(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        found = []
        for x, y in zip(*similar(a["items"].tolist(), b["items"].tolist(), threshold), strict=True):
            p, q = root(a["component"].iloc[x]), root(b["component"].iloc[y])
            if p != q:
                parent[p] = q
                found.append((a["node"].iloc[x], b["node"].iloc[y]))
        return pd.DataFrame({"a": np.array([f[0] for f in found], np.int64), "b": np.array([f[1] for f in found], np.int64)})

    return dealt.groupBy("group", "i", "j").applyInPandas(compare, "a long, b long")


def similar(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of ``a`` and ``b`` whose Jaccard similarity reaches the threshold."""
    size_a, size_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    of_a, of_b = np.repeat(np.arange(len(a)), size_a), np.repeat(np.arange(len(b)), size_b)
    common = np.intersect1d(flat_a, flat_b)
    at_a, at_b = np.searchsorted(common, flat_a), np.searchsorted(common, flat_b)
    both = np.zeros((len(a), len(b)), np.float32)
    for first in range(0, len(common), 2048):
        width = min(2048, len(common) - first)
        side = []
        for at, flat, of, n in ((at_a, flat_a, of_a, len(a)), (at_b, flat_b, of_b, len(b))):
            here = np.flatnonzero((at >= first) & (at < first + width))
            here = here[common[at[here]] == flat[here]]
            m = np.zeros((n, width), np.float32)
            m[of[here], at[here] - first] = 1
            side.append(m)
        both += side[0] @ side[1].T
    total = size_a[:, None] + size_b[None, :] - both
    return np.nonzero((both >= (threshold - 1e-9) * total) & (total > 0))
