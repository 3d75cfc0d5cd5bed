"""Strong components by rounds and by one task, against closures; cycles against a plain search."""

import random

import pytest

from marlstone.operators import cycles


def plain_components(pairs):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    reach = {}
    for root in {x for p in pairs for x in p}:
        seen, todo = set(), [root]
        while todo:
            for w in after.get(todo.pop(), ()):
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        reach[root] = seen
    return {(v, max(w for w in reach[v] if v in reach[w])) for v in reach if v in reach[v]}


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


@pytest.mark.parametrize("local_edges", [500_000, 0])
def test_components_of_every_shape(spark, local_edges):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(1, 30)]  # a chain
    pairs += [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(200, 100), (104, 201)]  # a cycle with a way in and out
    pairs += [(300, 301), (301, 302), (302, 300), (300, 303), (303, 304), (304, 300), (302, 310), (310, 311), (311, 304)]  # cycles over chains
    pairs += [(400, 400), (401, 401), (401, 402), (402, 401)]  # loops
    pairs += [(500 + i, 500 + (i * 7 + j) % 40) for i in range(40) for j in (1, 2)] + [(600 + i, 500) for i in range(5)]  # branching everywhere
    pairs += [(700 + rng.randrange(60), 700 + rng.randrange(60)) for _ in range(75)]
    pairs += [(800, 801), (801, 800), (800, 802), (802, 803), (803, 800), (801, 804), (804, 805), (805, 801)]  # two ears on a pair
    got = {tuple(r) for r in cycles.strong_components(frame(spark, [*pairs, pairs[0], (None, 1), (2, None)]), local_edges).collect()}
    assert got == plain_components(pairs)
    assert cycles.strong_components(frame(spark, pairs).limit(0), local_edges).collect() == []


def test_long_chains_take_few_tables(spark):
    """A chain of 100,000 nodes, and one that is closed: tables grow with the logarithm."""
    n, rounds = 100_000, []
    open_ = spark.range(n).selectExpr("id AS src", "id + 1 AS dst")
    ring = spark.range(n).selectExpr(f"id + {2 * n} AS src", f"(id + 1) % {n} + {2 * n} AS dst")
    found = cycles.strong_components(open_.unionAll(ring), 0, rounds)
    assert found.selectExpr("count(*) AS n", "min(id) AS a", "min(component) AS b", "max(component) AS c").first() == (n, 2 * n, 3 * n - 1, 3 * n - 1)
    assert sum(rounds) < 40


def plain_search(order, after):
    """The reference search over the whole graph."""
    state, path, out = {}, [], []

    def visit(v):
        state[v] = 1
        path.append(v)
        for w in after.get(v, []):
            if w not in order:
                continue
            if state.get(w) == 1:
                out.append([*path[path.index(w) :], w])
            elif not state.get(w):
                visit(w)
        path.pop()
        state[v] = 2

    for v in order:
        if not state.get(v):
            visit(v)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_report_equals_search(spark, seed):
    """Where components are entered at their first nodes, as in one order from the sources on, the whole search agrees."""
    rng = random.Random(seed)
    blocks = [[f"b{k}n{i}" for i in range(rng.randrange(1, 7))] for k in range(12)]
    order = [v for b in blocks for v in b]
    after = {v: [] for v in order}
    for b in blocks:
        for i, v in enumerate(b):  # a ring, so that a block of two and more is one component, and links across it
            after[v] += [rng.choice(b) for _ in range(2)] + ["unknown"] + [b[(i + 1) % len(b)]] * (len(b) > 1)
            rng.shuffle(after[v])
    for k in range(11):  # from a block to the first node of an earlier one, which the search has left
        after[blocks[k + 1][0]].append(blocks[k][0])
    links = [(v, w, i) for v in order for i, w in enumerate(after[v])]
    got = cycles.cycle_report(spark.createDataFrame(links, "src string, dst string, ord int"), spark.createDataFrame([(v, i) for i, v in enumerate(order)], "id string, ord int")).collect()
    want = plain_search(order, after)
    assert len(want) > 12 and sorted(r["cycle"] for r in got) == sorted(want)
    assert all(r["message"] == "Cyclic dependency detected: " + " -> ".join(r["cycle"]) and r["cycle"][0] == r["cycle"][-1] for r in got)


def test_report_is_the_reference_search_of_one_component(spark):
    after = {"a": ["b", "c", "x"], "b": ["c", "a"], "c": ["d", "b", "b"], "d": ["a", "d"]}
    links = [(v, w, i) for v, ws in after.items() for i, w in enumerate(ws)]
    nodes = [(v, i) for i, v in enumerate("abcd")]
    got = cycles.cycle_report(spark.createDataFrame(links, "src string, dst string, ord int"), spark.createDataFrame(nodes, "id string, ord int")).orderBy("number").collect()
    assert [r["cycle"] for r in got] == plain_search(list("abcd"), after) == [["a", "b", "c", "d", "a"], ["d", "d"], ["b", "c", "b"], ["b", "c", "b"], ["a", "b", "a"]]
