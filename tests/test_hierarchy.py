"""The density hierarchy against a textbook version over all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmap.operators import cells, density, hierarchy


def exact_clusters(xy, k):
    """HDBSCAN* over all pairs: components at every merge distance, ties at once, excess of mass."""
    n = len(xy)
    gaps = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    core = np.sort(gaps, axis=1)[:, k]
    reach = np.maximum(gaps, np.maximum(core[:, None], core[None]))
    a, b = np.triu_indices(n, 1)
    weight = reach[a, b]
    floor = weight[weight > 0].min()
    owner = list(range(n))
    parts = {i: {i} for i in range(n)}
    cluster, acc, value, kids, members = {}, {}, {}, {}, {}
    made = 0

    def merge(old, new, weight):
        nonlocal made
        gain = 1.0 / max(weight, floor)
        large = [p for p in old if len(parts[p]) >= k]
        total = sum(len(parts[p]) for p in old)
        whole = set().union(*(parts[p] for p in old))
        if len(large) == 1:
            name = cluster[large[0]]
            acc[name] += (total - len(parts[large[0]])) * gain
        elif total >= k:
            made += 1
            name = made
            acc[name], kids[name] = total * gain, [cluster[p] for p in large]
            for p in large:
                c = cluster[p]
                members[c] = set(parts[p])
                acc[c] -= len(parts[p]) * gain
        else:
            name = None
        for p in old:
            parts.pop(p)
            cluster.pop(p, None)
        parts[new] = whole
        if name:
            cluster[new] = name
        for i in whole:
            owner[i] = new

    order = np.argsort(weight, kind="stable")
    cuts = np.flatnonzero(np.diff(weight[order])) + 1
    for edges in np.split(order, cuts):
        w, linked = weight[edges[0]], {}
        for i, j in zip(a[edges], b[edges], strict=True):
            p, q = owner[i], owner[j]
            if p != q:
                linked.setdefault(p, set()).add(q)
                linked.setdefault(q, set()).add(p)
        seen = set()
        for p in list(linked):
            if p not in seen:
                group, stack = set(), [p]
                while stack:
                    q = stack.pop()
                    if q not in group:
                        group.add(q)
                        stack += linked[q]
                seen |= group
                merge(sorted(group), min(group), w)

    def best(name):
        below = [best(c) for c in kids.get(name, [])]
        total = sum(v for v, _ in below)
        if name in members and acc[name] >= total:
            return acc[name], [name]
        return total, [c for _, cs in below for c in cs]

    roots = set(cluster.values())
    return {frozenset(members[c]) for r in roots for c in best(r)[1]}


def cored_points(spark, xy, k):
    gaps = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    core = np.sort(gaps, axis=1)[:, k]
    rows = [(i, float(x), float(y), float(c)) for i, ((x, y), c) in enumerate(zip(xy, core, strict=True))]
    return spark.createDataFrame(rows, "id long, x double, y double, core double")


def found_clusters(df, found):
    out = {}
    for r in df.join(found, ["x", "y"]).collect():
        out.setdefault(r["chosen"], set()).add(r["id"])
    return {frozenset(c) for c in out.values()}


def scattered(seed, n=500):
    """Blobs of several sizes and densities, a bridge, lattice points with many ties, copies, and noise."""
    rng = np.random.default_rng(seed)
    parts = [
        rng.normal(size=(n // 4, 2)) * 0.4,
        rng.normal(size=(n // 5, 2)) * 0.1 + [2, 0],
        rng.normal(size=(n // 5, 2)) * 1.5 + [9, 9],
        np.stack(np.meshgrid(np.arange(8.0), np.arange(6.0)), -1).reshape(-1, 2) * 0.25 + [-6, 4],
        np.linspace([0, 0], [2, 0], n // 25),
        np.repeat([[20.0, 20.0]], 12, axis=0),
        np.repeat([[5.0, -5.0]], 3, axis=0),
    ]
    left = n - sum(map(len, parts))
    return np.vstack([*parts, rng.uniform(-10, 22, size=(left, 2))])


@pytest.mark.parametrize(("seed", "k", "cell_rows", "group_edges"), [(1, 10, 40, 10**6), (2, 5, 25, 300), (4, 4, 500, 10**6)])
def test_hierarchy_equals_the_textbook(spark, seed, k, cell_rows, group_edges):
    xy = scattered(seed)
    df = cored_points(spark, xy, k).cache()
    want = exact_clusters(xy, k)
    assert len(want) > 2
    assert found_clusters(df, hierarchy.hierarchy_clusters(df, k, cell_rows, group_edges)) == want


def test_density_clusters_equal_the_textbook(spark):
    xy = scattered(7)
    got = {}
    df = cored_points(spark, xy, 9).drop("core")
    for r in density.density_clusters(df, 9).collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    assert sum(map(len, got.values())) == len(xy)
    assert sorted(got) == [-1, *range(len(got) - 1)]
    assert {frozenset(c) for n, c in got.items() if n >= 0} == exact_clusters(xy, 9)


def test_edges_are_few_and_hold_the_tree(spark):
    """Witnesses leave out most pairs of cells, and the edges connect all points as lightly as all pairs do."""
    rng = np.random.default_rng(5)
    xy = rng.uniform(size=(3000, 2))
    df = cored_points(spark, xy, 6)
    tree = cells.fit_cells(df, 50)
    assert tree.cells > 40
    nodes = hierarchy._nodes(df, tree).cache()
    pairs = hierarchy._cell_pairs(nodes, tree).count()
    assert pairs < 18 * tree.cells
    edges = hierarchy.reachability_edges(nodes, tree).toPandas()
    assert len(edges) < 2 * len(xy)
    at = {n: i for i, n in enumerate(nodes.orderBy("node").toPandas()["node"])}
    table = nodes.orderBy("node").toPandas()
    whole = hierarchy.spanning_tree(*(table[c].to_numpy() for c in ("x", "y", "core")))[2].sum()
    up, total = list(range(len(at))), 0.0

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for w, u, v in sorted(zip(edges["weight"], edges["u"], edges["v"], strict=True)):
        a, b = find(at[u]), find(at[v])
        if a != b:
            up[a], total = b, total + w
    assert total == pytest.approx(whole, rel=1e-12)


def test_hierarchy_of_hard_rows(spark):
    few = spark.createDataFrame([(i, float(i), 0.0) for i in range(5)], "id long, x double, y double")
    assert {r["cluster"] for r in density.density_clusters(few, 5).collect()} == {-1}
    assert density.density_clusters(few.where("false"), 5).count() == 0
    rows = [(f"p{i}", 1.0, 2.0) for i in range(40)] + [("n", None, 1.0)]
    copies = spark.createDataFrame(rows, "id string, x double, y double")
    assert {r["cluster"] for r in density.density_clusters(copies.dropna(), 5).collect()} == {-1}
    two = rows[:40] + [(f"q{i}", 9.0, 9.0) for i in range(30)]
    got = density.density_clusters(spark.createDataFrame(two, "id string, x double, y double"), 5).collect()
    assert len({r["cluster"] for r in got if r["id"][0] == "p"}) == 1 and len({r["cluster"] for r in got}) == 2


@pytest.mark.parametrize(("k", "cell_rows"), [(1, 20), (6, 30), (11, 64), (30, None), (499, 40), (500, 40)])
def test_core_distances_against_all_pairs(spark, k, cell_rows):
    xy = scattered(9)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(-1, None, 3.0)], "id long, x double, y double")
    got = {r["id"]: r["core"] for r in density.core_distance(df, k, cell_rows).collect()}
    gaps = np.sort(np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1]), axis=1)
    assert got == ({i: gaps[i, k] for i in range(len(xy))} if k < len(xy) else {})


def test_partners_of_cells_are_sought_by_many_tasks(spark):
    xy = np.random.default_rng(5).uniform(size=(3000, 2))
    df = cored_points(spark, xy, 6)
    tree = cells.fit_cells(df, 50)
    pairs = hierarchy._cell_pairs(hierarchy._nodes(df, tree), tree)
    assert pairs.select(F.spark_partition_id().alias("task")).distinct().count() > 1
    assert pairs.groupBy("a", "slice").count().agg(F.max("count")).first()[0] <= hierarchy.PARTNERS


@pytest.mark.parametrize("gap", [0.0, 0.4, 1.5, 30.0])
@pytest.mark.parametrize("lattice", [False, True])
@pytest.mark.parametrize("n", [1, 2, 40])
def test_crossing_edges_complete_the_tree_of_two_cells(n, lattice, gap):
    rng = np.random.default_rng(n)
    xy = rng.integers(0, 6, size=(n + 30, 2)) / 6 if lattice else rng.uniform(size=(n + 30, 2))
    xy = xy + gap * (np.arange(n + 30) >= n)[:, None]
    core = rng.choice([0.1, 0.3, 0.5], n + 30)

    def place(rows):
        x, y, c = xy[rows, 0], xy[rows, 1], core[rows]
        up, weight = np.full(len(x), -1), np.zeros(len(x))
        u, v, w = hierarchy.spanning_tree(x, y, c)
        up[v], weight[v] = u, w
        return hierarchy._Place(pa.table({"node": np.arange(len(x)), "x": x, "y": y, "core": c, "up": up, "weight": weight}))

    a, b = place(slice(0, n)), place(slice(n, n + 30))
    u, v, w = hierarchy.crossing_edges(a, b)
    assert np.array_equal(w, np.maximum(np.hypot(a.x[u] - b.x[v], a.y[u] - b.y[v]), np.maximum(a.core[u], b.core[v])))
    edges = sorted([*zip(w, u, n + v), *((p.weight[i], at + p.up[i], at + i) for p, at in ((a, 0), (b, n)) for i in np.flatnonzero(p.up >= 0))])
    root, weights = list(range(n + 30)), []
    for weight, i, j in edges:
        if root[i] != root[j]:
            weights.append(weight)
            root = [root[i] if r == root[j] else r for r in root]
    assert weights == sorted(hierarchy.spanning_tree(xy[:, 0], xy[:, 1], core)[2])
