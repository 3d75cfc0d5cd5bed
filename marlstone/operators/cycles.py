"""Strong components of an edge table, and the cycles that a depth-first search closes in them.

Edges are reduced round by round. Rake: nodes without in- or out-edges go. Compress: chains of nodes
with one in- and one out-edge become one edge between their ends, found by pointers that double their
reach; a chain is on cycles exactly if its ends are in one component, and a closed chain is a component.
Both together take trees and chains away in rounds that grow with the logarithm of their size. Where a
round takes away less than a tenth, what is left is a core in which every node branches: each node
takes the largest id that reaches it, and the nodes of one label that reach the node of that id are a
component. From ``local_edges`` edges down, which are counted, one task finishes the rest.

Self-loops are components of their own; repeated edges count once; edges with a null end are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import bound_batches, durable


def _local_components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The component of each of ``n`` numbered nodes, by one depth-first search with low links."""
    order = np.argsort(src, kind="stable")
    after = dst[order].tolist()
    first = np.searchsorted(src[order], np.arange(n + 1)).tolist()
    seen, low, component = [-1] * n, [0] * n, np.full(n, -1, np.int64)
    open_: list[int] = []
    count = found = 0
    for root in range(n):
        if seen[root] >= 0:
            continue
        stack, at = [root], [first[root]]
        seen[root] = low[root] = count
        count += 1
        open_.append(root)
        while stack:
            v = stack[-1]
            if at[-1] < first[v + 1]:
                w = after[at[-1]]
                at[-1] += 1
                if seen[w] < 0:
                    seen[w] = low[w] = count
                    count += 1
                    open_.append(w)
                    stack.append(w)
                    at.append(first[w])
                elif component[w] < 0:
                    low[v] = min(low[v], seen[w])
                continue
            stack.pop()
            at.pop()
            if stack:
                low[stack[-1]] = min(low[stack[-1]], low[v])
            if low[v] == seen[v]:
                while True:
                    w = open_.pop()
                    component[w] = found
                    if w == v:
                        break
                found += 1
    return component


def _finished(edges: DataFrame) -> DataFrame:
    """(id, component) of the components of two nodes and more, in one task; the edges were counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches))
        if not got.num_rows:
            return
        src, dst = (got.column(i).combine_chunks() for i in (0, 1))
        both = pa.concat_arrays([src, dst]).dictionary_encode()
        names, codes = both.dictionary, both.indices.to_numpy()
        of = _local_components(len(names), codes[: len(src)].astype(np.int64), codes[len(src) :].astype(np.int64))
        sizes = np.bincount(of)
        rows = np.flatnonzero(sizes[of] > 1)
        ids = names.take(pa.array(rows))
        largest = pa.table({"component": of[rows], "id": ids}).group_by("component").aggregate([("id", "max")])
        label = dict(zip(largest["component"].to_pylist(), largest["id_max"].to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([ids, pa.array([label[c] for c in of[rows].tolist()], ids.type)], ["id", "component"])

    kind = edges.schema["src"].dataType.simpleString()
    return edges.select("src", "dst").repartition(1).mapInArrow(run, f"id {kind}, component {kind}")


def _raked(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have edges both ways."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionAll(edges.select("dst", F.lit(0), F.lit(1)))
    inner = ends.groupBy("id").agg(F.max("out").alias("out"), F.max("in").alias("in")).where("out = 1 AND in = 1").select("id")
    return edges.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def _compressed(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(edges without chains, chain members (id, first, last), members of closed chains (id, component), tables written)."""
    out = edges.groupBy("src").agg(F.count("*").alias("n"), F.max("dst").alias("next"))
    in_ = edges.groupBy("dst").agg(F.count("*").alias("m"), F.max("src").alias("prev"))
    links = durable(out.join(in_, F.col("src") == F.col("dst")).where("n = 1 AND m = 1").select(F.col("src").alias("id"), "prev", "next"))
    n_links = links.count()
    inside = links.select(F.col("id").alias("next"), F.lit(True).alias("inside"))
    # tail: the last chain node so far; ahead: where it leads; largest: of the nodes passed.
    now = links.join(inside, "next", "left").select("id", F.col("id").alias("tail"), F.col("next").alias("ahead"), F.col("id").alias("largest"), F.col("inside").isNull().alias("done"))
    written, reach = 1, 1
    now = durable(now)
    while reach <= n_links and now.where("NOT done").limit(1).count():
        other = now.select(F.col("id").alias("a_id"), F.col("tail").alias("a_tail"), F.col("ahead").alias("a_ahead"), F.col("largest").alias("a_largest"), F.col("done").alias("a_done"))
        walked = now.where("NOT done").join(other, F.col("ahead") == F.col("a_id")).select("id", F.col("a_tail").alias("tail"), F.col("a_ahead").alias("ahead"), F.greatest("largest", "a_largest").alias("largest"), F.col("a_done").alias("done"))
        now = durable(now.where("done").unionAll(walked))
        written, reach = written + 1, 2 * reach
    closed = now.where("NOT done").select("id", F.col("largest").alias("component"))
    open_ = now.where("done")
    before = links.join(links.select(F.col("id").alias("prev"), F.lit(True).alias("inside")), "prev", "left").where("inside IS NULL").select("id", "prev")
    ends = open_.join(before, "id").select("tail", F.col("prev").alias("first"), F.col("ahead").alias("last"))
    members = durable(open_.join(ends, "tail").select("id", "first", "last"))
    taken = links.select("id")
    rest = edges.join(taken.withColumnRenamed("id", "src"), "src", "left_anti").join(taken.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
    return durable(rest.unionAll(members.select("first", "last")).distinct()), members, closed, written + 2


def _spread(labels: DataFrame, steps: DataFrame) -> DataFrame:
    """Labels (id, label) that travel along steps (from, to) until each node has the largest that reaches it."""
    total = lambda df: df.agg(F.sum(F.xxhash64("id", "label").cast("decimal(38,0)"))).first()[0]
    now, before = labels, total(labels)
    while True:
        for _ in range(2):  # two steps for each table written
            sent = now.join(steps, now["id"] == steps["from"]).select(F.col("to").alias("id"), "label")
            now = now.unionAll(sent).groupBy("id").agg(F.max("label").alias("label"))
        now = durable(now)
        after = total(now)
        if after == before:
            return now
        before = after


def _core(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Some components (id, component) of a core, at least one where there is any, and the edges between other nodes."""
    nodes = left.select(F.col("src").alias("id")).union(left.select("dst")).distinct()
    reached = _spread(durable(nodes.select("id", F.col("id").alias("label"))), left.select(F.col("src").alias("from"), F.col("dst").alias("to")))
    x, y = reached.toDF("src", "x"), reached.toDF("dst", "y")
    inner = durable(left.join(x, "src").join(y, "dst").where("x = y").select("src", "dst"))
    # Back from the node that gave the label, along edges of one label: nodes it reaches and that reach it.
    back = _spread(durable(reached.where("id = label")), inner.select(F.col("dst").alias("from"), F.col("src").alias("to")))
    found = durable(back.select("id", F.col("label").alias("component")))
    gone = found.select("id")
    rest = left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
    return found, durable(rest)


def strong_components(edges: DataFrame, local_edges: int = 500_000, rounds: list[int] | None = None) -> DataFrame:
    """(id, component) of the nodes on cycles; a component is known by its largest id.

    rounds: a list that takes the number of tables written by each round.
    """
    bound_batches(edges.sparkSession)
    given = durable(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    left = given.where("src <> dst")
    looped = given.where("src = dst").select(F.col("src").alias("id"), F.col("src").alias("component"))
    # weak: known to lie on a cycle through itself only; another component of the node goes before.
    parts, chains = [looped.withColumn("weak", F.lit(1))], []
    n = left.count()
    while n > local_edges:
        raked = durable(_raked(left))
        left, members, closed, written = _compressed(raked)
        parts += [closed.withColumn("weak", F.lit(0)), left.where("src = dst").select(F.col("src").alias("id"), F.col("src").alias("component"), F.lit(1).alias("weak"))]
        chains.append(members)
        left = left.where("src <> dst")
        m = left.count()
        if m > 0.9 * n and m > local_edges:
            found, left = _core(left)
            parts.append(found.withColumn("weak", F.lit(0)))
            m = left.count()
        if rounds is not None:
            rounds.append(written + 1)
        n = m
    if n:
        parts.append(_finished(left).withColumn("weak", F.lit(0)))
    best = lambda df: df.groupBy("id").agg(F.min_by("component", "weak").alias("component"), F.min("weak").alias("weak"))
    found = best(reduce(DataFrame.unionAll, parts))
    if not chains:
        return found.select("id", "component")
    found = durable(found)
    for members in reversed(chains):  # the ends of a chain may be members of chains found later
        a, b = (found.select(F.col("id").alias(end), F.col("component").alias(name)) for end, name in (("first", "x"), ("last", "y")))
        met = members.join(a, "first", "left").join(b, "last", "left").where("first = last OR x = y").select("id", "x", F.lit(0).alias("weak"))
        found = durable(best(found.unionAll(met)))
    # A chain may hold the largest id of its component; what only a chain's end closed is a component with the chain.
    largest = found.groupBy("component").agg(F.max("id").alias("largest"), F.count("*").alias("size"))
    named = found.join(largest, "component").select("id", F.col("largest").alias("component"), (F.col("size") == 1).alias("lone"))
    return named.where("NOT lone").select("id", "component").unionAll(named.where("lone").join(looped.select("id"), "id", "left_semi").select("id", "component"))


_NAMES = 200_000  # names of nodes in a batch of cycles


def _closed(nodes: list, after: dict) -> Iterator[list]:
    """The cycles that a depth-first search of one component closes, entered at its first node, one at a time."""
    place: dict = {}
    done = set()
    for root in nodes:
        if root in done:
            continue
        path, stack = [root], [iter(after.get(root, ()))]
        place[root] = 0
        while stack:
            nxt = next(stack[-1], None)
            if nxt is None:
                node = path.pop()
                del place[node]
                done.add(node)
                stack.pop()
            elif nxt in place:
                yield [*path[place[nxt] :], nxt]
            elif nxt not in done:
                place[nxt] = len(path)
                path.append(nxt)
                stack.append(iter(after.get(nxt, ())))


def cycle_report(edges: DataFrame, nodes: DataFrame, local_edges: int = 500_000) -> DataFrame:
    """(component, number, cycle, message): the cycles that a depth-first search closes, in its order.

    edges: src, dst and ord, the place of a link among those of its node. nodes: id and ord, the order of
    the search. Links to unknown nodes are ignored; a link that is given twice closes its cycle twice, as
    the search meets it twice. A back edge never leaves a component, so every component is searched by
    itself, entered at its first node: a search of the whole graph may come in at another node from outside
    and then names the same component's cycles from there. One task holds one component's links
    and some cycles: these are written as they are found, as the cycles of a component may take the square of its size.
    """
    bound_batches(edges.sparkSession)
    known = edges.join(nodes.select(F.col("id").alias("src"), F.col("ord").alias("src_ord")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("ord").alias("dst_ord")), "dst").select("src", "dst", "ord", "src_ord", "dst_ord")
    known = durable(known)
    of = durable(strong_components(known, local_edges))
    inner = known.join(of.toDF("src", "component"), "src").join(of.toDF("dst", "other"), "dst").where("component = other").select("component", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("ord").cast("long"), F.col("src_ord").cast("long"))
    kind = of.schema["component"].dataType.simpleString()

    # Components lie together in a task, their links in the order of the search.
    dealt = inner.repartition("component").sortWithinPartitions("component", F.asc_nulls_last("src_ord"), F.asc_nulls_last("ord")).select("component", "src", "dst")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(component: object, after: dict[str, list[str]]) -> Iterator[pa.RecordBatch]:
            held, size, number = [], 0, 0
            for c in _closed(list(after), after):
                held.append(c)
                size += len(c)
                if size >= _NAMES:
                    yield batch(component, number, held)
                    held, size, number = [], 0, number + len(held)
            if held:
                yield batch(component, number, held)

        def batch(component: object, number: int, held: list[list[str]]) -> pa.RecordBatch:
            n = len(held)
            return pa.RecordBatch.from_arrays([pa.array([component] * n, type_of[0]), pa.array(range(number + 1, number + n + 1), pa.int64()), pa.array(held, pa.list_(pa.string()))], ["component", "number", "cycle"])

        type_of: list = [None]
        now, after = None, {}
        for b in batches:
            type_of[0] = b.schema.field("component").type
            for component, src, dst in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if component != now:
                    yield from closed(now, after)
                    now, after = component, {}
                after.setdefault(src, []).append(dst)
        yield from closed(now, after)

    found = dealt.mapInArrow(search, f"component {kind}, number long, cycle array<string>")
    return found.withColumn("message", F.concat(F.lit("Cyclic dependency detected: "), F.array_join("cycle", " -> ")))
