"""Dependency graphs: edges on cycles, ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordspine.sources.tables import written


def peeled(edges: DataFrame) -> DataFrame:
    """Edges (a, b) left when nodes without incoming or outgoing edges are taken off again and again."""
    left, n = edges, edges.count()
    while n:
        ends = left.join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        left = written(ends.join(ends.select(F.col("b").alias("a")).distinct(), "a", "left_semi"), "edges")
        m = left.count()
        if m == n:
            break
        n = m
    return left


def furthest(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, top): the largest node that reaches each node along source -> target, itself included.

    Each round takes the largest of the neighbours' and then the top's own top, so that long chains need few rounds.
    """
    nodes = edges.select(F.explode(F.array(source, target)).alias("node")).distinct()
    tops = written(nodes.withColumn("top", F.col("node")), "tops")
    while True:
        near = edges.join(tops.withColumnRenamed("node", source), source).groupBy(F.col(target).alias("node")).agg(F.max("top").alias("near"))
        one = tops.join(near, "node", "left").select("node", F.col("top").alias("was"), F.greatest("top", "near").alias("one"))
        jump = tops.select(F.col("node").alias("one"), F.col("top").alias("two"))
        both = written(one.join(jump, "one").select("node", "was", F.greatest("one", "two").alias("top")), "tops")
        tops = both.select("node", "top")
        if both.where("top <> was").isEmpty():
            return tops


def cyclic_edges(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """Edges that lie on a cycle: those whose ends reach each other, not those between cycles. Self-edges are cycles.

    What peeling leaves is cut by the largest node that reaches a node: a strong component lies within one cut, and that of
    the cut's largest node is all that reaches it again. The rest goes another round. Rounds are written out.
    """
    left = written(edges.select(F.col(child).alias("a"), F.col(parent).alias("b")).distinct(), "edges")
    out = left.where("a = b")
    left = peeled(left.where("a <> b"))
    while not left.isEmpty():
        tops = furthest(left, "a", "b")
        inside = left.join(tops.select(F.col("node").alias("a"), F.col("top").alias("of_a")), "a").join(tops.select(F.col("node").alias("b"), F.col("top").alias("of_b")), "b").where("of_a = of_b")
        inside = written(inside.select("a", "b", F.col("of_a").alias("cut")), "edges")
        back = furthest(inside.select("a", "b"), "b", "a").withColumnRenamed("top", "reached")
        marked = inside.join(back.select(F.col("node").alias("a"), F.col("reached").alias("from_a")), "a").join(back.select(F.col("node").alias("b"), F.col("reached").alias("from_b")), "b")
        marked = written(marked.select("a", "b", (F.col("from_a") == F.col("cut")).alias("done_a"), (F.col("from_b") == F.col("cut")).alias("done_b")), "edges")
        out = out.unionByName(marked.where("done_a AND done_b").select("a", "b"))
        left = peeled(written(marked.where("NOT done_a AND NOT done_b").select("a", "b"), "edges"))
    return out.select(F.col("a").alias(child), F.col("b").alias(parent))


def ancestors(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, ancestor, distance) for all ancestors along parent links, whatever the depth: distances double each round.

    Parent links that form a cycle have no end and raise an error.
    """
    known = written(nodes.where(F.col(parent).isNotNull()).select(F.col(key).alias("k"), F.col(parent).alias("ancestor"), F.lit(1).alias("distance")), "ancestors")
    most, step = known.count(), 1
    while True:
        far = known.where(F.col("distance") == step).select("k", F.col("ancestor").alias("via"))
        beyond = far.join(known.select(F.col("k").alias("via"), "ancestor", F.col("distance").alias("more")), "via").select("k", "ancestor", (F.col("more") + step).alias("distance"))
        beyond = written(beyond, "ancestors")
        if beyond.isEmpty():
            return known.withColumnRenamed("k", key)
        if step >= most:
            raise ValueError("parent links form a cycle")
        step *= 2
        known = written(known.unionByName(beyond), "ancestors")


def subtree_sums(nodes: DataFrame, key: str, parent: str, measures: list[str]) -> DataFrame:
    """(key, own_<m>, total_<m>): each node's measures and their sums over its whole subtree, leaves at any depth.

    Sums reach twice as far each round: a node adds what the nodes exactly 2^k below it hold, which are sums of their next
    2^k - 1 levels. One row for each node throughout (no closure), so a chain of a million nodes takes 20 rounds. Sums of a parent
    with very many children are partly made before the shuffle.

    Null measures count as 0. A null or unknown parent makes a root. Repeated rows of a key raise, as do links that form a cycle; nodes with a null key are left out.
    """
    own = [F.coalesce(F.col(m), F.lit(0)).alias(f"own_{m}") for m in measures]
    rows = nodes.where(F.col(key).isNotNull()).select(F.col(key).alias("node"), F.col(parent).alias("up"), *own)
    once = rows.groupBy("node").agg(F.when(F.count(F.lit(1)) == 1, F.any_value("up")).otherwise(F.raise_error(F.concat(F.lit("repeated node "), F.col("node").cast("string")))).alias("up"), *(F.any_value(f"own_{m}").alias(f"own_{m}") for m in measures))
    once = written(once, "tree")
    totals = [f"total_{m}" for m in measures]
    known = once.select(F.col("node").alias("up")).distinct()
    linked = once.join(known.withColumn("_known", F.lit(True)), "up", "left").select("node", F.when(F.col("_known"), F.col("up")).alias("up"), *(F.col(f"own_{m}").alias(f"total_{m}") for m in measures))
    state = written(linked, "tree")
    left = state.count()
    while not state.where(F.col("up").isNotNull()).isEmpty():
        if left == 0:
            raise ValueError("parent links form a cycle")
        left //= 2
        below = state.where(F.col("up").isNotNull())
        added = below.groupBy(F.col("up").alias("node")).agg(*(F.sum(c).alias(f"_{c}") for c in totals))
        further = below.select("node", "up").join(below.select(F.col("node").alias("up"), F.col("up").alias("_up")), "up").select("node", "_up")
        both = state.drop("up").join(added, "node", "left").join(further, "node", "left")
        state = written(both.select("node", F.col("_up").alias("up"), *(F.coalesce(F.col(c) + F.col(f"_{c}"), F.col(c)).alias(c) for c in totals)), "tree")
    return once.drop("up").join(state.select("node", *totals), "node").select(F.col("node").alias(key), *(c for m in measures for c in (f"own_{m}", f"total_{m}")))


def rollup_tree(nodes: DataFrame, key: str, parent: str, facts: DataFrame, measures: dict) -> DataFrame:
    """(key, own_<m>, total_<m>): facts (with the column key) aggregated for each node and summed up the tree.

    measures: name -> additive aggregate (sums and counts). Facts are aggregated once, before they meet the tree. Those of a null or
    unknown node come back in one row with a null key, so that nothing is lost; it is there only if there are any.
    """
    names = list(measures)
    of_node = facts.groupBy(key).agg(*(c.alias(m) for m, c in measures.items()))
    tree = nodes.select(F.col(key), F.col(parent)).where(F.col(key).isNotNull())
    sums = subtree_sums(tree.join(of_node, key, "left"), key, parent, names)
    lost = of_node.join(tree, key, "left_anti").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(m).alias(m) for m in names)).where("_n > 0")
    return sums.unionByName(lost.select(F.lit(None).cast(nodes.schema[key].dataType).alias(key), *(F.coalesce(F.col(m), F.lit(0)).alias(f"{kind}_{m}") for m in names for kind in ("own", "total"))))
