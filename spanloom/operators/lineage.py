"""Lineage graphs: closures, paths, components and checks over ``parent, child`` edges.

Every round joins a frontier with the edges and is written down, so plans stay short and a lost
executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def closure(edges: DataFrame, starts: DataFrame, down: bool = True, most: int | None = None) -> DataFrame:
    """``start, node, depth``: all that can be reached from each start (within ``most`` steps, if given), at its least depth.

    A frontier leaves out what was seen, so cycles end and rounds go on until nothing new is reached.
    """
    a, b = ("parent", "child") if down else ("child", "parent")
    step = written(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct(), "edges")
    first = starts.select(F.col(starts.columns[0]).alias("start")).distinct()
    seen = front = written(first.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")), "front")
    depth = 0
    while most is None or depth < most:
        depth += 1
        reached = front.join(step, "node").select("start", F.col("next").alias("node")).distinct()
        front = written(reached.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "front")
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen.filter("depth > 0")


def roots(edges: DataFrame) -> DataFrame:
    """Nodes without a parent."""
    return edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")


def missing_parents(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Edges whose parent isn't a node."""
    return edges.join(nodes.select(F.col(key).alias("parent")), "parent", "left_anti")


def longest_paths(edges: DataFrame) -> DataFrame:
    """``node, depth``: the longest path from a root to each node; an error where a cycle has no longest path."""
    step = written(edges.select(F.col("parent").alias("node"), F.col("child").alias("next")).distinct(), "edges")
    if not unpeeled(edges).isEmpty():
        raise ValueError("the graph has a cycle")
    depth = front = written(roots(edges).withColumn("depth", F.lit(0)), "front")
    k = 0
    while not front.isEmpty():
        k += 1
        front = written(front.join(step, "node").select(F.col("next").alias("node")).distinct().withColumn("depth", F.lit(k)), "front")
        depth = depth.union(front)
    return depth.groupBy("node").agg(F.max("depth").alias("depth"))


def unpeeled(edges: DataFrame, both_ends: bool = False) -> DataFrame:
    """The edges that stay when nodes without parents are taken away again and again: cycles and what follows.

    With ``both_ends`` nodes without children go as well, which leaves cycles and what is between them.
    """
    left = written(edges.select("parent", "child").distinct(), "edges")
    n = left.count()
    while n:
        inner = left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("parent", "child")
        if both_ends:
            inner = inner.join(left.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("parent", "child")
        left = written(inner, "edges")
        now = left.count()
        if now == n:
            break
        n = now
    return left


def cyclic(edges: DataFrame) -> DataFrame:
    """The edges that are on a cycle: those whose child reaches their parent."""
    left = unpeeled(edges, both_ends=True)
    back = closure(left, left.select("child")).select(F.col("start").alias("child"), F.col("node").alias("parent"))
    loops = left.filter("parent = child").select("child", "parent")
    return left.join(back.union(loops).distinct(), ["parent", "child"], "left_semi")


def path(edges: DataFrame, begin, end) -> list:
    """A shortest path between two nodes along edges in either direction, of equal ones the one of the smallest nodes; empty if there is none.

    Rounds keep, of each node that they reach, the smallest node it was reached from; the path is read back
    from those, one row a step.
    """
    step = written(edges.select("parent", "child").union(edges.select("child", "parent")).distinct().toDF("node", "next"), "edges")
    seen = front = written(step.sparkSession.createDataFrame([(begin, None, 0)], f"node {step.schema['node'].dataType.simpleString()}, before {step.schema['node'].dataType.simpleString()}, depth int"), "front")
    depth = 0
    while front.filter(F.col("node") == F.lit(end)).isEmpty():
        depth += 1
        reached = front.join(step, "node").groupBy(F.col("next").alias("node")).agg(F.min("node").alias("before"))
        front = written(reached.join(seen, "node", "left_anti").select("node", "before", F.lit(depth).alias("depth")), "front")
        if front.isEmpty():
            return []
        seen = seen.union(front)
    found = [end]
    while found[-1] != begin:
        found.append(seen.filter(F.col("node") == F.lit(found[-1])).select("before").first()[0])
    return found[::-1]


def subgraph(nodes: DataFrame, edges: DataFrame, key: str, run: str, value) -> tuple[DataFrame, DataFrame]:
    """The nodes of a run with all above and below them, and the edges between those."""
    own = nodes.filter(F.col(run) == F.lit(value)).select(F.col(key).alias("node"))
    near = own.union(closure(edges, own).select("node")).union(closure(edges, own, down=False).select("node")).distinct()
    within = edges.join(near.toDF("parent"), "parent", "left_semi").join(near.toDF("child"), "child", "left_semi")
    return near, within.select("parent", "child")


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that is linked with each, in either direction.

    Labels go to neighbours and then to the label's own label, so that rounds are few; they end when no
    label changes.
    """
    both = written(edges.select("parent", "child").union(edges.select("child", "parent")).distinct().toDF("node", "next"), "edges")
    label = written(both.select("node").distinct().withColumn("component", F.col("node")), "labels")
    while True:
        heard = both.join(label.toDF("next", "other"), "next").groupBy("node").agg(F.min("other").alias("other"))
        low = label.join(heard, "node").select("node", "component", F.least("component", "other").alias("low"))
        jump = label.toDF("low", "lower")
        now = written(low.join(jump, "low").select("node", F.col("lower").alias("component"), (F.col("lower") != F.col("component")).alias("moved")), "labels")
        label = now.select("node", "component")
        if now.filter("moved").isEmpty():
            return label


def insertable(nodes: DataFrame, edges: DataFrame, key: str, at: str) -> DataFrame:
    """The edges whose parent was there before the child was added."""
    n = nodes.select(F.col(key).alias("__k"), F.col(at).alias("__at"))
    with_parent = edges.join(n.toDF("parent", "p_at"), "parent").join(n.toDF("child", "c_at"), "child")
    return with_parent.filter("p_at < c_at").select("parent", "child")


def problems(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``kind, node`` of what is wrong: ``missing`` parents, nodes on a ``cycle``, ``orphan`` nodes without any edge."""
    missing = missing_parents(nodes, edges, key).select(F.lit("missing").alias("kind"), F.col("child").alias("node"))
    on_cycle = cyclic(edges).select(F.lit("cycle").alias("kind"), F.col("child").alias("node"))
    linked = edges.select(F.col("parent").alias(key)).union(edges.select("child"))
    orphan = nodes.select(key).join(linked, key, "left_anti").select(F.lit("orphan").alias("kind"), F.col(key).alias("node"))
    return missing.union(on_cycle).union(orphan).distinct()


def exported(edges: DataFrame, kind: str = "dot") -> DataFrame:
    """``line``: the lines of a graph in the DOT or Mermaid language, without its head and end, in no order."""
    arrow = {"dot": F.format_string('  "%s" -> "%s";', F.col("parent").cast("string"), F.col("child").cast("string")), "mermaid": F.format_string("    %s --> %s", F.col("parent").cast("string"), F.col("child").cast("string"))}[kind]
    return edges.select(arrow.alias("line"))


def tree(edges: DataFrame, start) -> DataFrame:
    """``node, depth, path, circular`` of everything above a node, along every way; a node that is on its own way ends it."""
    step = written(edges.select(F.col("child").alias("node"), F.col("parent").alias("next")).distinct(), "edges")
    kind = step.schema["node"].dataType.simpleString()
    front = found = written(step.sparkSession.createDataFrame([(start, 0, [start], False)], f"node {kind}, depth int, path array<{kind}>, circular boolean"), "tree")
    while True:
        more = front.filter("NOT circular").join(step, "node").select(F.col("next").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("next")).alias("path"), F.array_contains("path", F.col("next")).alias("circular"))
        front = written(more, "tree")
        if front.isEmpty():
            return found
        found = found.union(front)
