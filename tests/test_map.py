import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmap.operators import components, density, indexing, kmeans, layout, neighbours, tiles, topics, views
from corpusmap.plans import steps


def points(spark, xy, extra=None):
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, "id bigint, x double, y double")


def blobs(n=200, noise=30):
    rng = np.random.default_rng(11)
    centres = np.array([[0, 0], [10, 0], [0, 10]])
    xy = np.vstack([c + rng.normal(size=(n, 2)) * 0.7 for c in centres])
    return np.vstack([xy, rng.uniform(-6, 16, size=(noise, 2))])


def adjusted_rand(a, b):
    pairs = lambda n: n * (n - 1) / 2
    table = {}
    for i, j in zip(a, b):
        table[i, j] = table.get((i, j), 0) + 1
    both = sum(pairs(n) for n in table.values())
    left = sum(pairs(sum(1 for v in a if v == u)) for u in set(a))
    right = sum(pairs(sum(1 for v in b if v == u)) for u in set(b))
    expected = left * right / pairs(len(a))
    return (both - expected) / ((left + right) / 2 - expected)


# Components


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


def test_components_of_a_chain_a_hub_and_random_edges(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1001 + i) for i in range(50)]
    edges += [tuple(map(int, rng.integers(2000, 2100, 2))) for _ in range(60)]
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    assert got == union_find({n for e in edges for n in e}, edges)


def test_components_without_edges(spark):
    assert components.connected_components(
        spark.createDataFrame([], "src bigint, dst bigint")
    ).isEmpty()


@pytest.mark.parametrize("parts", [1, 9])
def test_dense_index(spark, parts):
    df = spark.range(500).repartition(parts)
    got = {r["id"]: r["node"] for r in indexing.dense_index(df).collect()}
    assert sorted(got.values()) == list(range(500))
    import hashlib

    order = sorted(range(500), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
    assert [got[i] for i in order] == list(range(500))


# Density


def brute_components(xy, core, eps, min_size):
    dense = [i for i in range(len(xy)) if core[i] <= eps]
    edges = [
        (a, b)
        for a, b in itertools.combinations(dense, 2)
        if math.dist(xy[a], xy[b]) <= eps
    ]
    named = union_find(dense, edges)
    sizes = {}
    for c in named.values():
        sizes[c] = sizes.get(c, 0) + 1
    return {i: c for i, c in named.items() if sizes[c] >= min_size}


def test_dbscan_levels_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    xy = np.round(np.vstack([rng.uniform(0, 3, size=(150, 2)), np.tile([1.5, 1.5], (60, 1))]), 3)
    gaps = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    core = np.sort(gaps, axis=1)[:, 4]
    rows = [(i, float(x), float(y), float(c)) for i, ((x, y), c) in enumerate(zip(xy, core))]
    df = spark.createDataFrame(rows, "id bigint, x double, y double, core double")
    eps = [0.6, 0.3, 0.15]
    got = {(r["level"], r["id"]): r["component"] for r in density.dbscan_levels(df, eps, 3).collect()}
    wanted = {
        (level + 1, i): c
        for level, e in enumerate(eps)
        for i, c in brute_components(xy, core, e, 3).items()
    }
    assert got == wanted


def exact_hdbscan(xy, k, min_size):
    """Small textbook version: levels at every merge distance, excess of mass."""
    n = len(xy)
    gaps = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    core = np.sort(gaps, axis=1)[:, k]
    reach = np.maximum(gaps, np.maximum(core[:, None], core[None]))
    levels = sorted({reach[a, b] for a, b in itertools.combinations(range(n), 2)}, reverse=True)
    return core, levels


def test_density_clusters_with_every_merge_distance(spark):
    """The selection is that of levels at all merge distances."""
    rng = np.random.default_rng(8)
    xy = np.vstack([rng.normal(size=(14, 2)) * 0.3 + c for c in ([0, 0], [3, 0], [1.5, 2.5])])
    xy = np.vstack([xy, [[1.5, 0.0], [8.0, 8.0]]])
    k = 4
    core, reach = exact_hdbscan(xy, k, k)
    # Merge distances: those at which the components change.
    merges, last = [], None
    for e in sorted(reach):
        named = brute_components(xy, core, e, 1)
        state = frozenset(named.items())
        if state != last:
            merges.append(e)
            last = state
    eps = sorted(merges, reverse=True)
    # The tree, with plain dictionaries.
    level_sets = []
    for e in eps:
        groups = {}
        for i, c in brute_components(xy, core, e, k).items():
            groups.setdefault(c, set()).add(i)
        level_sets.append([frozenset(g) for g in groups.values()])
    mass, kids, members = {}, {}, {}
    owner = {frozenset(range(len(xy))): "root"}
    previous, gain = [frozenset(range(len(xy)))], 0.0
    for e, groups in zip(eps, level_sets):
        now = 1.0 / e
        current = {}
        for p in previous:
            inside = [g for g in groups if g <= p]
            for g in inside:
                name = owner[p] if len(inside) == 1 else (e, min(g))
                if len(inside) > 1:
                    kids.setdefault(owner[p], []).append(name)
                    members[name] = g
                current[g] = name
                mass[name] = mass.get(name, 0.0) + len(g) * (now - gain)
        owner, previous, gain = current, list(current), now

    def best(name):
        below = [best(c) for c in kids.get(name, [])]
        value = sum(v for v, _ in below)
        if name != "root" and mass[name] >= value:
            return mass[name], [name]
        return value, [c for _, cs in below for c in cs]

    chosen = best("root")[1]
    wanted = {frozenset(members[c]) for c in chosen}
    got = {}
    for r in density.density_clusters(points(spark, xy), k).collect():
        if r["cluster"] >= 0:
            got.setdefault(r["cluster"], set()).add(r["id"])
    assert {frozenset(g) for g in got.values()} == wanted
    assert len(wanted) == 3


def test_density_clusters_find_blobs(spark):
    xy = blobs()
    got = {r["id"]: r["cluster"] for r in density.density_clusters(points(spark, xy), 30).collect()}
    labels = [got[i] for i in range(600)]
    assert len(set(labels) - {-1}) == 3
    kept = [i for i in range(600) if labels[i] >= 0]
    assert len(kept) > 480
    assert adjusted_rand([i // 200 for i in kept], [labels[i] for i in kept]) > 0.95


def test_one_blob_gives_no_split(spark):
    rng = np.random.default_rng(0)
    got = density.density_clusters(points(spark, rng.normal(size=(10, 2))), 30).collect()
    assert {r["cluster"] for r in got} == {-1}


# k-means


def test_grouped_kmeans_separates_each_group(spark):
    rng = np.random.default_rng(9)
    rows, truth = [], {}
    for g in (1, 2):
        for b, c in enumerate([(0, 0), (20, 0), (0, 20)]):
            for _ in range(30):
                i = len(rows)
                x, y = rng.normal(size=2) + c
                rows.append((i, g, float(x) * g, float(y) * g))
                truth[i] = (g, b)
    rows += [(1000, 3, 1.0, 1.0), (1001, 3, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id bigint, cluster int, x double, y double")
    assigned, centres = kmeans.grouped_kmeans(df)
    subs = {r["id"]: (r["cluster"], r["sub"]) for r in assigned.collect()}
    groups = {}
    for i, t in truth.items():
        groups.setdefault(t, set()).add(subs[i])
    assert all(len(s) == 1 for s in groups.values()) and len(set(map(tuple, groups.values()))) == 6
    assert {r["cluster"]: len(r["centres"]) for r in centres.collect()} == {1: 3, 2: 3, 3: 1}


# Layout


@pytest.mark.parametrize("sent", [0, 50_000])
def test_grouped_kmeans_writes_the_centres_of_many_groups_only(spark, monkeypatch, sent):
    xy = np.random.default_rng(4).uniform(size=(300, 2))
    rows = points(spark, xy).withColumn("cluster", (F.col("id") % 2).cast("int"))
    looks, plain = [], kmeans.materialize_observed
    monkeypatch.setattr(kmeans, "SENT_GROUPS", sent)
    monkeypatch.setattr(kmeans, "materialize_observed", lambda *a, **m: looks.append(1) or plain(*a, **m))
    assigned, centres = kmeans.grouped_kmeans(rows, iters=7)
    assert len(looks) == (0 if sent else 7)  # before: one for each round
    wanted = kmeans.start_centres(rows, "cluster", 3)
    for _ in range(7):
        wanted = kmeans.materialize(kmeans.update_centres(kmeans.assign_centres(rows, wanted, "cluster"), "cluster"), "centres")
    flat = lambda df: [(r["cluster"], [(c["x"], c["y"]) for c in r["centres"]]) for r in df.orderBy("cluster").collect()]
    for (a, got), (b, want) in zip(flat(centres), flat(wanted), strict=True):
        assert a == b and np.allclose(got, want)
    rest, _ = kmeans.grouped_kmeans(rows)
    again = kmeans.update_centres(rest, "cluster")
    settled = kmeans.assign_centres(rows, again, "cluster")
    assert sorted(map(tuple, settled.select("id", "sub").collect())) == sorted(map(tuple, rest.select("id", "sub").collect()))


def test_curve_parameters():
    a, b = layout.curve_parameters(0.1)
    assert a == pytest.approx(1.577, abs=0.02) and b == pytest.approx(0.895, abs=0.01)


def layout_graph(spark):
    rng = np.random.default_rng(6)
    pairs = {tuple(sorted(rng.choice(40, 2, replace=False).tolist())) for _ in range(120)}
    edges = [(u, v, float(w)) for (a, b), w in zip(sorted(pairs), rng.uniform(0.1, 1, len(pairs))) for u, v in ((a, b), (b, a))]
    start = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(42, 2)) * 4)]  # two nodes without edges
    return (
        spark.createDataFrame(edges, "src long, dst long, weight double"),
        spark.createDataFrame(start, "id long, x double, y double"),
        edges,
        np.array([r[1:] for r in start]),
    )


def test_layout_follows_the_rule(spark):
    """Against a plain loop over edges and draws."""
    graph, start, edges, xy = layout_graph(spark)
    epochs = 12
    placed = layout.layout_2d(graph, start, epochs, 0.1, negatives=3, seed=9)
    got = {r["id"]: (r["x"], r["y"]) for r in placed.collect()}
    a, b = layout.curve_parameters(0.1)
    number = {r["id"]: r["node"] for r in indexing.dense_index(start.select("id"), "node", 9).collect()}
    place = {n: i for i, n in number.items()}
    nodes = spark.createDataFrame([(n,) for n in place], "node long")
    clip = lambda v: np.clip(v, -layout.MAX_FORCE, layout.MAX_FORCE)
    for epoch in range(epochs):
        pulled, mass, pushed = np.zeros_like(xy), np.zeros(len(xy)), np.zeros_like(xy)
        for u, v, w in edges:
            gap = xy[u] - xy[v]
            d2 = gap @ gap
            pulled[u] += w * clip(-2 * a * b * d2 ** (b - 1) / (1 + a * d2**b) * gap)
            mass[u] += w
        for r in layout.drawn_nodes(nodes, len(xy), epoch, 3, 9).collect():
            gap = xy[place[r["node"]]] - xy[place[r["other"]]]
            d2 = gap @ gap
            pushed[place[r["node"]]] += clip(2 * b / ((0.001 + d2) * (1 + a * d2**b)) * gap)
        xy = xy + (1 - epoch / epochs) * (pulled / np.maximum(mass, 1e-9)[:, None] + pushed)
    assert np.allclose([got[i] for i in range(len(xy))], xy, atol=1e-6)


def test_an_epoch_leaves_the_edges_where_they_are(spark):
    from corpusmap.sources.scratch import bucketed, materialize

    graph, start, _, _ = layout_graph(spark)
    edges = graph.select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight")
    places = materialize(start.select(F.col("id").alias("node"), "x", "y"), "layout")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with bucketed(edges, "plan_edges", "other") as held:
            moved = layout.epoch_moved(held, places, 42, (1.5, 0.9), 1.0, 0, 5, 42)
            plan = moved._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    at = next(i for i, line in enumerate(plan) if "plan_edges" in line)
    over = [line for line in plan[:at] if "Join" in line or "Exchange" in line]
    # Upwards from the scan of the edges: their join comes first, then the one exchange of messages.
    assert "Join" in over[-1] and "[other" in over[-1]
    assert sum("Exchange" in line for line in over) == 1


def test_draws_of_a_block_are_those_of_the_table(spark):
    nodes = spark.range(23).select(F.col("id").alias("node"))
    for epoch, negatives, seed in ((0, 5, 42), (7, 2, 2**40), (3, 0, -1)):
        draws = layout._Draws(23, 10, 50, negatives, seed)
        got = [(int(v), int(o)) for b in range(3) for v, o in zip(np.repeat(draws.nodes(b), len(draws.numbers)), draws.drawn(b, epoch))]
        rows = layout.drawn_nodes(nodes, 23, epoch, negatives, seed).collect()
        assert sorted(got) == sorted((r["node"], r["other"]) for r in rows)


@pytest.mark.parametrize("blocks", [1, 3])
def test_blocks_move_as_epoch_after_epoch_of_the_rule(spark, monkeypatch, blocks):
    """Among repeated ids, a null id, edges without a weight and nodes without edges; with few tables written."""
    from corpusmap.sources.scratch import materialize

    graph, start, _, _ = layout_graph(spark)
    graph = graph.union(spark.createDataFrame([(3, 4, None), (4, 3, float("nan")), (5, 5, 0.5)], graph.schema))
    start = start.union(spark.createDataFrame([(7, 0.5, -0.5), (None, 1.0, 1.0), (8, float("nan"), 2.0)], start.schema))
    epochs, curve = 13, layout.curve_parameters(0.05)
    nodes = materialize(indexing.dense_index(start.select("id"), "node", 5), "nodes")
    n = nodes.count()
    edges = materialize(
        graph.join(nodes.withColumnRenamed("id", "src"), "src")
        .join(nodes.select(F.col("id").alias("dst"), F.col("node").alias("other")), "dst")
        .select("node", "other", "weight"),
        "edges",
    )
    places = materialize(start.join(nodes, "id").select("node", "x", "y"), "places")
    for epoch in range(epochs):
        places = materialize(layout.epoch_moved(edges, places, n, curve, 1.0 - epoch / epochs, epoch, 5, 5), "places")
    rows = lambda df: sorted((r["id"], r["x"], r["y"]) for r in df.collect())
    wanted = rows(places.join(nodes, "node").select("id", "x", "y"))

    written = []
    monkeypatch.setattr(layout, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    monkeypatch.setattr(layout, "BLOCKS", blocks)
    got = rows(layout.layout_2d(graph, start, epochs, seed=5))
    assert [r[0] for r in got] == [r[0] for r in wanted]
    assert np.allclose(np.array(got), np.array(wanted), atol=1e-6, equal_nan=True)
    assert len(written) < epochs  # a table for many epochs, not for each


def test_layout_keeps_blobs_apart(spark):
    rng = np.random.default_rng(6)
    # Centres far apart in five dimensions.
    matrix = np.vstack([rng.normal(size=(40, 5)) * 0.3 + 5 * np.eye(5)[c] for c in range(3)])
    df = spark.createDataFrame(
        [(i, [float(v) for v in row]) for i, row in enumerate(matrix)], "id bigint, embedding array<double>"
    )
    knn = neighbours.knn_graph(df, 9, "euclidean").cache()
    placed = layout.layout_2d(neighbours.fuzzy_graph(knn, 10), layout.pca_start(df), epochs=8)
    xy = {r["id"]: (r["x"], r["y"]) for r in placed.collect()}
    assert len(xy) == 120
    same = 0
    for i in xy:
        near = sorted((math.dist(xy[i], xy[j]), j) for j in xy if j != i)[:5]
        same += sum(j // 40 == i // 40 for _, j in near)
    assert same / (5 * 120) > 0.95
    knn.unpersist()


# Tiles


@pytest.mark.parametrize("parts", [1, 8])
def test_tiles_are_complete_and_within_capacity(spark, parts):
    rng = np.random.default_rng(1)
    xy = np.vstack([rng.uniform(0, 1, size=(200, 2)), np.tile([0.3, 0.7], (120, 1)), [[1.0, 1.0]]])
    df = points(spark, xy).repartition(parts)
    tiled = tiles.quadtree_tiles(df, capacity=20, max_depth=5).cache()
    rows = tiled.collect()
    assert sorted(r["id"] for r in rows) == list(range(len(xy)))
    manifest = {r["key"]: r for r in tiles.tile_children(tiles.tile_manifest(tiled)).collect()}
    for key, m in manifest.items():
        z, x, y = map(int, key.split("/"))
        assert m["n_points"] <= 20 or z == 5
        if z:
            parent = manifest[f"{z - 1}/{x // 2}/{y // 2}"]
            assert key in parent["children"] and parent["n_points"] == 20
        offered = [f"{z + 1}/{2 * x + i % 2}/{2 * y + i // 2}" for i in range(4)]
        assert m["children"] == [k for k in offered if k in manifest]
    assert max(r["tile_x"] for r in rows if r["z"] == 1) <= 1
    tiled.unpersist()


@pytest.mark.parametrize("room", [1, 19, 20, 21, 60, 500])
def test_view_takes_coarse_tiles_first(spark, room):
    rng = np.random.default_rng(5)
    tiled = tiles.quadtree_tiles(points(spark, rng.uniform(0, 1, size=(300, 2))), 20, 5).cache()
    rows = sorted((r["z"], r["priority"], r["id"]) for r in tiled.collect() if r["x"] <= 0.6)
    got = {r["id"] for r in tiles.points_in_view(tiled, (0.0, 0.0, 0.6, 1.0), 5, room).collect()}
    assert got == {i for _, _, i in rows[:room]}
    tiled.unpersist()


def test_tiles_of_nothing(spark):
    assert tiles.quadtree_tiles(points(spark, [])).count() == 0


# Labels


def test_sublabels_share_their_top_word(spark):
    rows = [(7, s, 0.0, float(s), ["Cell", "Gene", "Wave"]) for s in range(3)]
    subs = spark.createDataFrame(rows, "cluster int, sub int, x double, y double, keywords array<string>")
    top = spark.createDataFrame([(7, "Cell")], "cluster int, label string")
    got = {r["sub"]: r["text"] for r in topics.sublabel_pick(subs, top).collect()}
    assert got == {0: "Gene", 1: "Wave"}


def test_topics_of_edge_clusters(spark):
    docs = [
        (1, 0, "only one document here", None),
        (2, 1, "this with from", "study"),
        (3, 1, None, None),
        (4, 2, "zebra alpha", None),
        (5, 2, "alpha zebra", None),
        (6, 2, "other words", None),
    ]
    df = spark.createDataFrame(docs, "id int, cluster int, title string, abstract string")
    df = df.withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})
    clusters, labels = steps.build_labels(df)
    got = {r["cluster"]: (r["label"], r["keywords"]) for r in clusters.collect()}
    assert got[0] == ("Unknown", ["Unknown"]) and got[1] == ("Unknown", ["Unknown"])
    # Equal scores fall back to the alphabet.
    assert got[2][1][:2] == ["Alpha", "Zebra"]
    assert {r["level"] for r in labels.collect()} == {1}


def test_max_df_keeps_terms_in_exactly_four_fifths(spark):
    docs = [(i, 0, "often " + ("always " if i else "") + "never", None) for i in range(5)]
    df = spark.createDataFrame(docs, "id int, cluster int, title string, abstract string")
    kept = topics.vocabulary(topics.term_stats(topics.document_terms(df)))
    assert {r["term"] for r in kept.collect()} == {"always"}


@pytest.mark.parametrize("n, levels", [(50, {1}), (51, {1, 2})])
def test_subtopics_need_more_than_fifty_rows(spark, n, levels):
    words = ["river", "mountain", "ocean"]
    docs = [
        (i, 0, f"{words[i % 3]} item{'abcdefgh'[i % 8] * 3}", None, float(i % 3) * 10, float(i % 7))
        for i in range(n)
    ]
    df = spark.createDataFrame(docs, "id int, cluster int, title string, abstract string, x double, y double")
    _, labels = steps.build_labels(df, kmeans_iters=2)
    assert {r["level"] for r in labels.collect()} == levels


def test_declutter_matches_the_one_by_one_rule(spark):
    rng = np.random.default_rng(12)
    xy = np.round(np.vstack([rng.uniform(0, 500, size=(80, 2)), rng.uniform(100, 130, size=(60, 2))]), 2)
    rows = [(i % 9, f"t{i}", float(x), float(y), i % 2 + 1, int(i * 7 % 31)) for i, (x, y) in enumerate(xy)]
    df = spark.createDataFrame(rows, "cluster int, text string, x double, y double, level int, count bigint")
    kept = []
    for r in sorted(rows, key=lambda r: (r[4], -r[5], r[0], r[1])):
        if not any(abs(r[2] - k[2]) < 60 and abs(r[3] - k[3]) < 36 for k in kept):
            kept.append(r)
    got = {r["text"] for r in views.declutter_labels(df, 1.0).collect()}
    assert got == {r[1] for r in kept}


@pytest.mark.parametrize("zoom, level", [(1.0, 0), (1.5, 1), (3.9, 1), (4.0, 2)])
def test_visible_level(zoom, level):
    assert views.visible_level(zoom) == level


def test_require_aligned(spark):
    a, b = spark.range(3), spark.range(1, 3)
    views.require_aligned(a, a)
    with pytest.raises(ValueError):
        views.require_aligned(a, b)


def test_whole_map_on_documents(spark, tmp_path):
    """All six steps on texts of three topics."""
    from corpusmap.sources import tables

    rng = np.random.default_rng(3)
    words = [
        "river ocean water flood delta stream lake tide coast rain".split(),
        "planet orbit stellar galaxy comet lunar solar moon asteroid nova".split(),
        "protein enzyme genome cellular virus tissue gene neuron blood organ".split(),
    ]
    rows = [
        (f"W{i}", " ".join(rng.choice(words[i % 3], 2)), 2000 + i % 9, "", " ".join(rng.choice(words[i % 3], 4)), "openalex", "")
        for i in range(240)
    ]
    records = spark.createDataFrame(
        rows, "id string, title string, year bigint, faculty string, abstract string, source string, url string"
    )
    path = str(tmp_path / "embeddings")
    tables.write_embeddings(steps.build_embeddings(records), path)
    embeddings = tables.read_embeddings(spark, path)
    mapped = steps.build_map(embeddings, records, 15, 0.05, 20, epochs=6)
    tables.write_map_points(
        mapped.withColumns({"inst_id": F.lit("R1"), "mode": F.lit("full")}), str(tmp_path / "map")
    )
    points = tables.read_map_points(spark, str(tmp_path / "map"), "R1", "full").drop("inst_id", "mode")
    found = {r["id"]: r["cluster"] for r in points.collect()}
    kept = [i for i in range(240) if found[f"W{i}"] >= 0]
    assert len(found) == 240 and len(kept) > 120
    assert adjusted_rand([i % 3 for i in kept], [found[f"W{i}"] for i in kept]) > 0.5

    clusters, labels = steps.build_labels(points, kmeans_iters=2)
    tables.write_labels(clusters, labels, str(tmp_path / "labels"))
    vocabulary = {w.capitalize() for group in words for w in group}
    assert {r["label"] for r in spark.read.json(str(tmp_path / "labels/clusters")).collect()} <= vocabulary

    tiled, manifest = steps.build_tiles(points, capacity=40, max_depth=6)
    tables.write_tiles(tiled, manifest, str(tmp_path / "tiles"))
    stored = spark.read.parquet(str(tmp_path / "tiles/tiles"))
    assert stored.count() == 240
    assert tiles.points_in_view(stored, (-1e9, -1e9, 1e9, 1e9), 0).count() == 40

    made = steps.build_som(embeddings, points, 4, 3, epochs=3)
    tables.write_som(
        made.assignment, made.umatrix, made.density, made.points, str(tmp_path / "som")
    )
    shown = {r["id"]: r["cluster"] for r in made.points.collect()}
    assert shown == found
    assert spark.read.json(str(tmp_path / "som/cells")).count() == 12


def test_attach_layout_joins_documents_with_vectors_and_keeps_the_others(spark, tmp_path):
    from workload.oracle import ORACLE_SQL
    from workload.queries import QUERIES

    docs = [(i, f"Title {i}\nbody", "en", "s", 100 + i) for i in range(1, 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(2, [0.25, 0.5], 7), (9, [1.0, 1.0], 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["id"]: (r["title"], r["x"], r["y"], r["cluster"]) for r in QUERIES["attach_layout"](spark, str(tmp_path)).collect()}
    assert got[2] == ("Title 2", 0.25, 0.5, 7)
    assert set(got) == {1, 2, 3, 4} and got[1] == ("Title 1", 10.1, 91.9, 1)
    assert "points" in ORACLE_SQL["attach_layout"] and "JOIN" in ORACLE_SQL["attach_layout"]
