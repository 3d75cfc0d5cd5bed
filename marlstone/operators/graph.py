"""Operators on a directed graph of nodes (id) and edges (src, dst, kind).

Iterations cut their lineage with a written table every few rounds; nothing is collected but
single sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators.cycles import strong_components
from marlstone.session import durable


def resolved_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (src, dst, kind) of links whose target is a known node other than the source."""
    cleaned = links.select("src", T.clean_id(F.col("target")).alias("dst"), "kind").where("src != dst")
    return cleaned.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "kind").distinct()


def unresolved(links: DataFrame, known: DataFrame) -> DataFrame:
    """Links whose cleaned target is none of the known ids, paths or titles (column ``name``)."""
    return links.withColumn("name", T.clean_id(F.col("target"))).join(known.select("name").distinct(), "name", "left_anti").drop("name")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of every node."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    per = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return nodes.select("id").join(per, "id", "left").select("id", F.coalesce("out_degree", F.lit(0)).cast("long").alias("out_degree"), F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"))


def graph_metrics(nodes: DataFrame, edges: DataFrame, reviewed: Column | None = None) -> DataFrame:
    """One row: nodes, edges, density (directed, 3 places), average degree, isolated nodes, reviewed share."""
    d = degrees(nodes, edges)
    if reviewed is not None:
        d = d.join(nodes.select("id", reviewed.alias("reviewed")), "id")
    n, e = F.count("*"), F.sum("out_degree")
    share = T.half_up(100 * F.count_if("reviewed") / n) if reviewed is not None else F.lit(0)
    return d.agg(
        n.alias("n_nodes"), e.alias("n_edges"), T.half_up(e / F.when(n > 1, n * (n - 1)).otherwise(1), 3).alias("density"),
        T.half_up(2 * e / n, 1).alias("average_degree"), F.count_if((F.col("out_degree") == 0) & (F.col("in_degree") == 0)).alias("isolated"), share.cast("long").alias("reviewed_share"),
    )


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 15, damping: float = 0.85) -> DataFrame:
    """(id, rank) after ``rounds`` rounds; nodes without out-edges spread their rank over all nodes.

    Parallel edges count each. Edges must end in ``nodes``.
    """
    out = edges.groupBy("src").agg(F.count("*").alias("fan"))
    n = nodes.count()
    links = durable(edges.groupBy("src", "dst").agg(F.count("*").alias("k")).join(out, "src").select("src", "dst", (F.col("k") / F.col("fan")).alias("share")))
    ids = durable(nodes.select("id").join(out.withColumnRenamed("src", "id"), "id", "left").select("id", F.col("fan").isNull().alias("dangling")))
    ranks = ids.withColumn("rank", F.lit(1.0) / n)
    for r in range(rounds):
        loose = ranks.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        sent = ranks.join(links, ranks["id"] == links["src"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        # One row joins all: a scalar, not a cross product of tables.
        ranks = ids.join(sent.withColumnRenamed("dst", "id"), "id", "left").join(F.broadcast(loose)).select("id", "dangling", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank"))
        if r % 3 == 2:
            ranks = durable(ranks)
    return ranks.select("id", "rank")


def expand(seeds: DataFrame, edges: DataFrame, hops: int = 1, direction: str = "both") -> DataFrame:
    """Breadth-first expansion of seeds (id, score, ord): (id, hop, score, path, via).

    A node is found once, by the first of the frontier in order, downstream before upstream;
    its score is the finder's times 0.75 downstream or 0.85 upstream, to two places.
    """
    found = seeds.select("id", F.lit(0).alias("hop"), T.half_up(F.col("score"), 2).alias("score"), F.array("id").alias("path"), F.lit(None).cast("string").alias("via"), F.array("ord").alias("order"))
    frontier, all_ = found, found
    ways = []
    if direction in ("both", "down"):
        ways.append(edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), "kind", F.lit(0).alias("way")))
    if direction in ("both", "up"):
        ways.append(edges.select(F.col("dst").alias("from"), F.col("src").alias("to"), "kind", F.lit(1).alias("way")))
    steps = ways[0] if len(ways) == 1 else ways[0].unionAll(ways[1])
    for hop in range(1, hops + 1):
        reached = frontier.join(steps, frontier["id"] == steps["from"]).join(all_.select(F.col("id").alias("to")), "to", "left_anti")
        order = F.concat("order", F.array(F.col("way").cast("long")))
        first = Window.partitionBy("to").orderBy(order, "to", "kind")
        once = reached.withColumn("n", F.row_number().over(first)).where("n = 1")
        rank = F.row_number().over(Window.partitionBy("way", "id").orderBy("to")).cast("long")
        down = F.col("way") == 0
        frontier = durable(
            once.withColumn("rank", rank).select(
                F.col("to").alias("id"), F.lit(hop).alias("hop"), T.half_up(F.col("score") * F.when(down, 0.75).otherwise(0.85), 2).alias("score"),
                F.when(down, F.concat("path", F.array("to"))).otherwise(F.concat(F.array("to"), "path")).alias("path"), F.col("kind").alias("via"), F.concat(order, F.array("rank")).alias("order"),
            )
        )
        all_ = all_.unionAll(frontier)
    return all_.drop("order")


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that lie on a cycle."""
    return strong_components(edges).select("id")


def back_edge_cycles(edges: list[tuple[str, str]], order: list[str]) -> list[list[str]]:
    """The cycles that a depth-first search in the given order closes; for the few edges of ``cyclic_nodes``."""
    after: dict[str, list[str]] = {v: [] for v in order}
    for a, b in edges:
        if a in after and b in after:
            after[a].append(b)
    state: dict[str, int] = {}
    cycles = []
    for root in order:
        if state.get(root):
            continue
        path, stack = [root], [iter(after[root])]
        state[root] = 1
        while stack:
            nxt = next(stack[-1], None)
            if nxt is None:
                state[path.pop()] = 2
                stack.pop()
            elif state.get(nxt) == 1:
                cycles.append([*path[path.index(nxt) :], nxt])
            elif not state.get(nxt):
                state[nxt] = 1
                path.append(nxt)
                stack.append(iter(after[nxt]))
    return cycles


def backlinks(edges: DataFrame) -> DataFrame:
    """(id, n_sources, sources): the distinct sources of each target, in order."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("sources")).select("id", F.size("sources").cast("long").alias("n_sources"), "sources")


def top_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge ends in."""
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def with_prerequisites(seeds: DataFrame, prerequisites: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that are seeds or a prerequisite (id, needs) of one."""
    wanted = seeds.select("id").unionAll(prerequisites.join(seeds.select("id"), "id", "left_semi").select(F.col("needs").alias("id"))).distinct()
    return nodes.join(wanted, "id", "left_semi")


def dead_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which an end is no node."""
    ids = nodes.select("id").distinct()
    alive = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return edges.exceptAll(alive.select(*edges.columns))
