import random
import re

from pyspark.sql import functions as F

from marlstone.llm import jaccard_join as jj


def shingles(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, (i, a) in enumerate(sets):
        for j, b in sets[:p]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(a), find(i) if i is not None else None) for i, a in sets), key=str)


def made_rows(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, n = [(0, None), (1, ""), (2, " \n\t"), (3, "One two"), (4, "one TWO"), (5, "one two three")], 10
    for size in (4, 5, 7, 9, 10, 12, 16, 17, 20, 27, 40, 80, 200, 700):
        for _ in range(6):
            base = [rnd.choice(vocabulary) for _ in range(size)]
            for _ in range(rnd.randint(1, 7)):
                copy = list(base)
                for _ in range(rnd.randint(0, max(1, size // 25))):
                    kind, at = rnd.random(), rnd.randrange(len(copy))
                    if kind < 0.4:
                        copy[at] = rnd.choice(vocabulary)
                    elif kind < 0.6 and len(copy) > 2:
                        del copy[at]
                    elif kind < 0.8:
                        copy.append(rnd.choice(vocabulary))
                    else:
                        copy = [rnd.choice(vocabulary), *copy]
                rows.append((n, " ".join(copy)))
                n += 1
    passage = " ".join(f"p{i}" for i in range(60))
    for _ in range(40):
        rows.append((n, passage + " " + " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 40)))))
        n += 1
    return rows


def run(spark, rows, **extra):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("clash")).withColumn("root", F.lit(1))
    return sorted((tuple(r) for r in jj.jaccard_components(df, **extra).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_equals_brute_force(spark):
    rows = made_rows(1)
    assert run(spark, rows) == brute(rows)


def test_large_cluster_equals_brute_force(spark, monkeypatch):
    """Clusters of several blocks: near copies that only partly link with one another."""
    for name, few in (("_BLOCK_SETS", 8), ("_SKETCH_SETS", 16), ("_TILE_BLOCKS", 2)):
        monkeypatch.setattr(jj, name, few)
    rnd = random.Random(3)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for n in range(70):
        copy = list(base)
        for _ in range(rnd.randint(0, 3)):
            copy[rnd.randrange(len(copy))] = f"x{n}{rnd.randrange(99)}"
        rows.append((n, " ".join(copy)))
    assert run(spark, rows) == brute(rows)


def test_edge_rows(spark):
    assert run(spark, []) == []
    rows = [(7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (3, "A b c d e"), (9, None)]
    assert run(spark, rows) == brute(rows)


def test_signature_guarantee():
    """Linked sets of every size meet in a list, on either side of any boundary."""
    import numpy as np

    rnd = np.random.default_rng(5)
    for boundary in (0, 6, 13):
        plan = jj.Plan(85, boundary)
        for n in [*range(1, 60), 150, 900]:
            for _ in range(4):
                a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
                drop = rnd.integers(0, n * 15 // 100 + 1)
                grow = rnd.integers(0, n * 15 // 100 + 1)
                b = np.unique(np.concatenate([rnd.permutation(a)[drop:], rnd.integers(0, 2**63, grow).astype(np.uint64)]))
                o = len(np.intersect1d(a, b))
                if 100 * o >= 85 * (len(a) + len(b) - o):
                    assert np.intersect1d(jj.signatures(a, plan), jj.signatures(b, plan)).size


def test_sketches_bound_the_difference():
    """No linked pair is parted, whatever the lengths of the two sketches."""
    import numpy as np

    rnd = np.random.default_rng(9)
    sets = []
    for n in (1, 3, 60, 130, 255, 300, 513, 2000):
        for _ in range(4):
            a = rnd.integers(0, 2**63, n).astype(np.uint64)
            sets += [np.unique(a), np.unique(a[n // 12 :]), np.unique(np.concatenate([a, rnd.integers(0, 2**63, n // 9).astype(np.uint64)]))]
    sets.sort(key=len)
    keys, sizes = np.arange(len(sets)), np.array([len(x) for x in sets])
    block = (keys.tobytes(), np.zeros(len(sets), np.int64).tobytes(), sizes.tobytes(), b"".join(jj.sketch(x) for x in sets))
    node, root = jj._alike(block, block, 85)
    near = dict(zip(node.tolist(), root.tolist(), strict=True))
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * (o := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - o)]
    assert linked and all(near.get(i, i) == near.get(j, j) for i, j in linked)
    # Sets of other contents stay apart.
    assert len({near.get(i, i) for i in range(len(sets))}) >= 20
