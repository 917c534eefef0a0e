"""Transitive dependency closure with exact depths, in few rounds.

A node with one parent lies one level below it, whatever else it leads to.  So
all such nodes are taken out of the search first: pointer jumping gives each the nearest
ancestor of another kind (its anchor) and the distance, in a logarithmic number
of rounds for a chain or tree of any depth.  What is left are anchors (roots
and nodes of several parents) and weighted edges between them.  Two-hop
shortcuts are added to those as long as they stay within a given multiple of
them, each time halving the rounds.  Then the search relaxes weighted edges
from the nodes whose depth has just fallen; every node taken out gets its
anchor's depth plus its distance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strata.session import scratch_path


PARTS = 8  # tables of known depths


def _counted(df: DataFrame, name: str, what: Column | None = None) -> tuple[DataFrame, int]:
    """``df`` written to the shared scratch folder and read back, and its number
    of rows (those where ``what`` holds), which the write observes."""
    seen = Observation()
    path = scratch_path(df.sparkSession, name)
    df.observe(seen, F.count(F.lit(1) if what is None else F.when(what, 1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _forest(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``node, anchor, off, done`` of every node that has one parent and is no
    root.  ``done`` is false only for nodes that hang on a cycle of such nodes, which
    no root can reach."""
    one = (edges.groupBy("to").agg(F.min("node").alias("anchor"), F.max("node").alias("last")).where("anchor = last")
           .select(F.col("to").alias("node"), "anchor").join(start, "node", "left_anti"))
    one, total = _counted(one, "closure-single")
    parents = one.select(F.col("node").alias("anchor"), F.lit(False).alias("_"))
    flagged = one.join(parents, "anchor", "left").select("node", "anchor", F.lit(1).alias("off"), F.coalesce("_", F.lit(True)).alias("done"))
    jumped, left = _counted(flagged, "closure-jumped", ~F.col("done"))
    done = [jumped.where("done")]
    far = 1
    while left and far <= total:
        known = _union([*done, jumped.where("NOT done")]).select(F.col("node").alias("anchor"), F.col("anchor").alias("_a"), F.col("off").alias("_o"), F.col("done").alias("_d"))
        jumped, left = _counted(jumped.where("NOT done").join(known, "anchor").select(
            "node", F.col("_a").alias("anchor"), (F.col("off") + F.col("_o")).alias("off"), F.col("_d").alias("done")), "closure-jumped", ~F.col("done"))
        done.append(jumped.where("done"))
        far *= 2
    return _union([*done, jumped.where("NOT done")])


def _least(edges: DataFrame) -> DataFrame:
    return edges.where("node <> to").groupBy("node", "to").agg(F.min("w").alias("w"))


def _contracted(edges: DataFrame, forest: DataFrame) -> DataFrame:
    """Edges ``node, to, w`` between anchors."""
    rest = edges.join(forest.select(F.col("node").alias("to")), "to", "left_anti").join(forest, "node", "left")
    return _least(rest.select(F.coalesce("anchor", "node").alias("node"), "to", (F.coalesce("off", F.lit(0)) + 1).alias("w")))


def _shortcut(edges: DataFrame, n: int, growth: int) -> tuple[DataFrame, int]:
    """Add the two-hop paths, again and again, while edges and paths together are
    at most ``growth`` times the first edges (the paths are counted beforehand).
    Returns the edges and the greatest number of them at one node."""
    most, before, degree = growth * n, 0, 0
    while n != before:
        out, into = edges.groupBy("node").agg(F.count(F.lit(1)).alias("o")), edges.groupBy(F.col("to").alias("node")).agg(F.count(F.lit(1)).alias("i"))
        size = out.join(into, "node", "left").agg(F.sum(F.col("o") * F.col("i")).alias("paths"), F.max("o").alias("most")).first()
        degree = size["most"] or 0
        if not size["paths"] or n + size["paths"] > most:
            break
        two = edges.select("node", F.col("to").alias("_via"), F.col("w").alias("_w")).join(
            edges.select(F.col("node").alias("_via"), "to", "w"), "_via").select("node", "to", (F.col("_w") + F.col("w")).alias("w"))
        before = n
        edges, n = _counted(_least(edges.unionByName(two)), "closure-edges")
    return edges, degree


def _search(start: DataFrame, n: int, edges: DataFrame, degree: int, hot_degree: int) -> DataFrame:
    """Depths of the anchors that the ``n`` rows of ``start`` reach (``node, depth``)."""
    on, salts = ["node"], None
    if degree > hot_degree:
        on = ["node", "_salt"]
        salts, _ = _counted(edges.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / hot_degree).cast("int").alias("_salts")).where("_salts > 1"), "closure-salts")
        edges, _ = _counted(edges.join(salts, "node", "left").withColumn(
            "_salt", F.pmod(F.xxhash64("to"), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts"), "closure-edges")
    frontier, known = start, [(n, start)]
    while n:
        if salts is not None:
            frontier = (frontier.join(salts, "node", "left")
                        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts"))
        found = frontier.join(edges, on).select(F.col("to").alias("node"), (F.col("depth") + F.col("w")).alias("depth")).groupBy("node").agg(F.min("depth").alias("depth"))
        found = found.alias("f").join(_union([part for _, part in known]).alias("k"), F.expr("f.node = k.node AND k.depth <= f.depth"), "left_anti")
        frontier, n = _counted(found, "closure-round")
        known.append((n, frontier))
        if len(known) > PARTS:  # merge the last ones, back to one of more than their rows
            m, new = known.pop()
            while known and (known[-1][0] <= 2 * m or len(known) >= PARTS):
                size, part = known.pop()
                m, new = m + size, part.unionByName(new)
            new, m = _counted(new.groupBy("node").agg(F.min("depth").alias("depth")), "closure-known")
            known.append((m, new))
    return _union([part for _, part in known]).groupBy("node").agg(F.min("depth").alias("depth"))


def dependency_closure(roots: DataFrame, edges: DataFrame, node: str = "node", parent: str = "parent",
                       child: str = "child", stop: Column | None = None, growth: int = 32,
                       hot_degree: int = 100_000) -> DataFrame:
    """All nodes reachable from ``roots`` (roots included) with their BFS ``depth``.

    ``stop``: a predicate on column ``node``; matching nodes are neither
    included nor expanded (nothing is pruned without one). Null parents,
    children and roots are no nodes.

    The search (see module doc) is exact. A node is expanded again only if a
    shorter way to it was found; known depths lie in a few tables, the last of
    which are merged as they grow, and each round is anti-joined against them. Every
    step is written once to the shared scratch folder and read back, and its
    size comes from the write itself. ``growth`` bounds the shortcut edges as a
    multiple of the edges between anchors.

    A parent of more than ``hot_degree`` children has its edges dealt over
    ``ceil(degree / hot_degree)`` salts by child; its salt count is a row of a
    small table, joined to the frontier, which is written once per salt.
    """
    keep = ~F.coalesce(stop, F.lit(False)) if stop is not None else F.lit(True)
    e = (edges.select(F.col(parent).alias("_from"), F.col(child).alias("node")).where("_from <> node").where(keep)
         .select(F.col("_from").alias("node"), F.col("node").alias("to")))
    e, _ = _counted(e, "closure-given")
    start, n_roots = _counted(roots.select(F.col(node).alias("node")).where("node IS NOT NULL").distinct().where(keep)
                              .withColumn("depth", F.lit(0)), "closure-roots")
    forest = _forest(e, start.select("node"))
    between, n = _counted(_contracted(e, forest), "closure-edges")
    depths = _search(start, n_roots, *_shortcut(between, n, growth), hot_degree)
    hung = (forest.where("done").select("node", F.col("anchor").alias("_a"), "off").join(depths.select(F.col("node").alias("_a"), "depth"), "_a")
            .select("node", (F.col("depth") + F.col("off")).alias("depth")))
    return depths.unionByName(hung)
