"""Small directed graphs as edge tables ``(graph, src, dst)``.

Graphs have a handful of nodes, so closures and condition lists are tiny tables;
they are kept as DataFrames because permutation tests hold hundreds of graphs at
once and the results join with facts computed from the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, scratch


def edge_table(spark: SparkSession, graphs: Mapping[str, Sequence[tuple[str, str]]]) -> DataFrame:
    return spark.createDataFrame(
        [(g, s, d) for g, edges in graphs.items() for s, d in edges], "graph string, src string, dst string"
    )


def validate(graphs: Mapping[str, Sequence[tuple[str, str]]], columns: Sequence[str]) -> None:
    """Reject graphs with a node that has no data column, or with a cycle."""
    for name, edges in graphs.items():
        nodes = {n for e in edges for n in e}
        unknown = sorted(nodes - set(columns))
        if unknown:
            raise ValueError(f"graph {name}: nodes without a data column: {unknown}")
        waiting = set(edges)
        while waiting:
            blocked = {d for _, d in waiting}
            free = {e for e in waiting if e[0] not in blocked}
            if not free:
                raise ValueError(f"graph {name}: contains a cycle")
            waiting -= free


def node_table(edges: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """(graph, node) of every node; `isolated` names those without an edge."""
    ends = edges.select("graph", F.explode(F.array("src", "dst")).alias("node"))
    return (ends if isolated is None else ends.unionByName(isolated.select("graph", "node"))).distinct()


def isolated_nodes(spark: SparkSession, isolated: Mapping[str, Sequence[str]]) -> DataFrame:
    return spark.createDataFrame([(g, n) for g, own in isolated.items() for n in own], "graph string, node string")


def ancestors(edges: DataFrame) -> DataFrame:
    """(graph, node, ancestor): transitive closure over pairs.

    Each round joins the pairs with themselves and keeps every pair once, so paths double in length
    and the rows never exceed the pairs of nodes, however many paths there are.
    """
    reach = materialise(edges.select("graph", F.col("dst").alias("node"), F.col("src").alias("ancestor")).distinct(), "closure")
    known, before = reach.count(), 0
    while known != before:
        further = reach.alias("a").join(
            reach.alias("b"), (F.col("a.graph") == F.col("b.graph")) & (F.col("a.ancestor") == F.col("b.node"))
        )
        reach = materialise(reach.unionByName(further.select("a.graph", "a.node", "b.ancestor")).distinct(), "closure")
        known, before = reach.count(), known
    return reach


def parent_sets(edges: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """(graph, node, parents) for every node; an empty list for roots."""
    listed = edges.groupBy("graph", F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("parents"))
    return node_table(edges, isolated).join(listed, ["graph", "node"], "left").withColumn(
        "parents", F.coalesce("parents", F.array().cast("array<string>"))
    )


def adjustment_sets(edges: DataFrame, treatments: DataFrame) -> DataFrame:
    """Backdoor set per (graph, treatment): the parents of the treatment, valid in any fully observed DAG."""
    return treatments.join(parent_sets(edges).withColumnRenamed("node", "treatment"), ["graph", "treatment"]).withColumnRenamed(
        "parents", "adjustment"
    )


def implied_independencies(edges: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """(graph, x, y, given): each node is independent of its other non-descendants given its parents."""
    nodes = node_table(edges, isolated)
    pairs = nodes.withColumnRenamed("node", "x").join(nodes.withColumnRenamed("node", "y"), "graph").where("x <> y")
    descendants = ancestors(edges).select("graph", F.col("ancestor").alias("x"), F.col("node").alias("y"))
    direct = edges.select("graph", F.col("dst").alias("x"), F.col("src").alias("y"))
    parents = parent_sets(edges, isolated).select("graph", F.col("node").alias("x"), F.col("parents").alias("given"))
    return (
        pairs.join(descendants, ["graph", "x", "y"], "left_anti")
        .join(direct, ["graph", "x", "y"], "left_anti")
        .join(parents, ["graph", "x"])
        .select("graph", "x", "y", "given")
    )


def d_separated(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """`queries` (graph, x, y, given) with `separated`: whether no path from x to y is open given the set.

    All queries walk together over states (node, came from a child or a parent): a node outside the set
    passes a walk on to its children, and to its parents if the walk came from a child; a node with the
    set among itself and its descendants passes a walk from a parent back to its parents. A round joins
    the states found last with the edges; there are at most two states a node and query.
    """
    spark = edges.sparkSession
    keys = ["graph", "x", "y", "given"]
    with scratch(spark):
        asked = materialise(queries.select(*keys).distinct(), "separation-queries")
        own = asked.select(*keys, F.explode("given").alias("node"))
        above = own.join(ancestors(edges), ["graph", "node"]).select(*keys, F.col("ancestor").alias("node"))
        # Per query the nodes of the set and their ancestors: where a collider is open.
        opened = materialise(own.unionByName(above).distinct().withColumn("opened", F.lit(True)), "separation-opened")
        state = [*keys, "node", "up"]
        found = last = materialise(asked.select(*keys, F.col("x").alias("node"), F.lit(True).alias("up")), "separation-states")
        while not last.isEmpty():
            walk = last.join(opened, [*keys, "node"], "left").withColumn("inside", F.array_contains("given", F.col("node")))
            on = walk.where("not inside")
            back = walk.where("(up and not inside) or (not up and opened)")
            down = on.join(edges, (on["graph"] == edges["graph"]) & (on["node"] == edges["src"])).select(*[on[k] for k in keys], edges["dst"].alias("node"), F.lit(False).alias("up"))
            up = back.join(edges, (back["graph"] == edges["graph"]) & (back["node"] == edges["dst"])).select(*[back[k] for k in keys], edges["src"].alias("node"), F.lit(True).alias("up"))
            last = materialise(down.unionByName(up).distinct().join(found, state, "left_anti"), "separation-states")
            found = found.unionByName(last)
        reached = found.where("node = y").select(*keys).distinct().withColumn("reached", F.lit(True))
        return materialise(asked.join(reached, keys, "left").select(*keys, F.col("reached").isNull().alias("separated")), "separated", keep=True)


def minimal_adjustment_sets(edges: DataFrame, treatments: DataFrame, outcome: str, isolated: DataFrame | None = None) -> DataFrame:
    """(graph, treatment, adjustment): a smallest backdoor set, the first in order of its names among those.

    Candidates are all sets of non-descendants of the treatment, so graphs should be small: a set closes
    the backdoor if it separates treatment and outcome where the treatment's own edges are cut. Every
    treatment has its own cut graph, and all sets of all graphs are decided in one walk.
    """
    spark = edges.sparkSession
    with scratch(spark):
        pairs = treatments.select("graph", "treatment").distinct()
        cut_name = F.concat_ws("|", "graph", "treatment")
        cut = pairs.join(edges, "graph").where("src <> treatment").select(cut_name.alias("graph"), "src", "dst")
        below = ancestors(edges).select("graph", F.col("ancestor").alias("treatment"), "node")
        free = pairs.join(node_table(edges, isolated), "graph").where((F.col("node") != F.col("treatment")) & (F.col("node") != outcome))
        free = free.join(below, ["graph", "treatment", "node"], "left_anti")
        listed = pairs.join(free.groupBy("graph", "treatment").agg(F.array_sort(F.collect_list("node")).alias("free")), ["graph", "treatment"], "left")
        listed = listed.withColumn("free", F.coalesce("free", F.array().cast("array<string>")))
        number = F.expr("explode(sequence(0L, shiftleft(1L, size(free)) - 1))")
        sets = listed.select("graph", "treatment", "free", number.alias("number")).select(
            "graph", "treatment", F.expr("filter(free, (n, i) -> (shiftright(number, i) & 1) = 1)").alias("given")
        )
        sets = materialise(sets, "adjustment-sets")
        asked = sets.select(cut_name.alias("graph"), F.col("treatment").alias("x"), F.lit(outcome).alias("y"), "given")
        closed = d_separated(cut, asked).where("separated").withColumnsRenamed({"graph": "cut", "x": "treatment"})
        told = sets.withColumn("cut", cut_name).join(closed.select("cut", "treatment", "given"), ["cut", "treatment", "given"])
        best = told.groupBy("graph", "treatment").agg(F.min(F.struct(F.size("given").alias("n"), "given")).alias("b"))
        return materialise(best.select("graph", "treatment", F.col("b.given").alias("adjustment")), "adjustments", keep=True)


def pair_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, complete) for ordered column pairs: rows where both are present, in one pass."""
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("complete"))
        for a in columns
        for b in columns
        if a != b
    ]
    return df.agg(F.array(*cells).alias("rows")).select(F.inline("rows"))
