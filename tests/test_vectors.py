import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmap.operators import neighbours, som, vectors


def frame(spark, matrix):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, "id bigint, embedding array<double>")


def brute_knn(matrix, k, metric):
    if metric == "cosine":
        norm = np.linalg.norm(matrix, axis=1, keepdims=True)
        zero = norm[:, 0] < 1e-12
        unit = matrix / np.where(norm < 1e-12, 1.0, norm)
        d = 1.0 - unit @ unit.T
        d[np.ix_(zero, zero)] = 0.0
    else:
        d = np.sqrt(((matrix[:, None, :] - matrix[None, :, :]) ** 2).sum(-1))
    d = np.maximum(np.round(d, 9), 0.0)
    found = {}
    for i in range(len(matrix)):
        order = sorted((d[i, j], j) for j in range(len(matrix)) if j != i)[:k]
        found[i] = order
    return found


def by_source(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r["src"], r["rank"])):
        found.setdefault(r["src"], []).append((round(r["distance"], 9), r["dst"]))
    return found


@pytest.mark.parametrize("metric, dims", [("euclidean", 2), ("euclidean", 6), ("cosine", 5)])
def test_exact_neighbours_with_many_cells_and_blocks(spark, metric, dims):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(5, dims)) * 5
    matrix = np.vstack([c + rng.normal(size=(60, dims)) * 0.3 for c in centres])
    # A third of all rows are copies of one row, and one row is zero.
    matrix = np.round(np.vstack([matrix, np.tile(matrix[3], (150, 1)), np.zeros((1, dims))]), 3)
    got = by_source(
        neighbours.knn_graph(
            frame(spark, matrix), 4, metric, "exact", cell_rows=20, query_rows=64, source_rows=16
        ).collect()
    )
    wanted = brute_knn(matrix, 4, metric)
    assert set(got) == set(wanted)
    for src, near in wanted.items():
        assert [d for d, _ in got[src]] == pytest.approx([d for d, _ in near], abs=1e-7)
    # Ties among copies go to the lowest ids.
    assert [j for _, j in got[3]] == [300, 301, 302, 303]
    assert [j for _, j in got[449]] == [3, 300, 301, 302]


def test_exact_neighbours_beyond_the_own_cell_need_no_exchange(spark, monkeypatch):
    """However many cells a query needs, rows are exchanged to pack them and no more."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    plans, made = [], neighbours._block_pairs

    def block_pairs(*args):
        found = made(*args)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(neighbours, "_block_pairs", block_pairs)
    matrix = np.random.default_rng(8).normal(size=(400, 16))
    matrix[300:] = matrix[:100]  # copies
    rows = spark.createDataFrame([(f"r{i:03}", [float(x) for x in v]) for i, v in enumerate(matrix)], "id string, embedding array<double>")
    found = neighbours.knn_graph(rows, 4, "euclidean", "exact", cell_rows=20).collect()
    assert plans and all("hashpartitioning" not in p and "CoGroup" not in p for p in plans)
    got = by_source(found)
    for i, near in brute_knn(matrix, 4, "euclidean").items():
        assert [d for d, _ in got[f"r{i:03}"]] == pytest.approx([d for d, _ in near], abs=1e-6)


def test_fewer_rows_than_neighbours(spark):
    matrix = np.array([[0.0, 1.0], [1.0, 0.0], [1.0, 1.0]])
    got = by_source(neighbours.knn_graph(frame(spark, matrix), 5, "euclidean", "exact").collect())
    assert {src: len(n) for src, n in got.items()} == {0: 2, 1: 2, 2: 2}


def test_ivf_recall_on_blobs(spark):
    rng = np.random.default_rng(3)
    matrix = np.vstack([rng.normal(size=(100, 8)) + 4 * rng.normal(size=8) for _ in range(6)])
    got = by_source(
        neighbours.knn_graph(
            frame(spark, matrix), 5, "euclidean", "ivf", cell_rows=50, probes=6
        ).collect()
    )
    wanted = brute_knn(matrix, 5, "euclidean")
    hits = sum(len({j for _, j in got[i]} & {j for _, j in wanted[i]}) for i in wanted)
    assert hits / (5 * len(wanted)) > 0.9


def recall_of(found, matrix, k, metric, queries):
    """Share of the k nearest distances that were found, by brute force over all rows."""
    hits = 0
    for i in queries:
        if metric == "cosine":
            length = np.maximum(np.linalg.norm(matrix, axis=1), 1e-12)
            d = 1.0 - (matrix @ matrix[i]) / (length * length[i])
        else:
            d = np.linalg.norm(matrix - matrix[i], axis=1)
        d[i] = np.inf
        kth = np.partition(d, k - 1)[k - 1]
        near = found.get(i, [])
        assert len(near) == k and len({j for _, j in near}) == k and i not in {j for _, j in near}
        assert all(abs(gap - d[j]) < 1e-6 for gap, j in near)
        hits += sum(gap <= kth + 1e-9 for gap, _ in near)
    return hits / (k * len(queries))


@pytest.mark.parametrize(("metric", "dims", "k"), [("cosine", 24, 5), ("euclidean", 3, 30)])
def test_tree_recall_with_many_cells(spark, metric, dims, k):
    """Uniform rows, the hardest kind, and a third of all rows copies of one row."""
    rng = np.random.default_rng(4)
    matrix = np.vstack([rng.normal(size=(1600, dims)), np.tile(rng.normal(size=dims), (800, 1))])
    found = by_source(neighbours.knn_graph(frame(spark, matrix), k, metric, cell_rows=32, query_rows=256).collect())
    assert set(found) == set(range(len(matrix)))
    assert recall_of(found, matrix, k, metric, range(0, 2400, 20)) >= 0.95


def test_tree_of_the_table_finds_its_neighbours(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    table = rows.toPandas().sort_values("id")
    assert list(table["id"]) == list(range(len(table)))
    matrix = np.vstack(table["embedding"]).astype(float)
    found = by_source(neighbours.knn_graph(rows, 5, cell_rows=16).collect())
    assert recall_of(found, matrix, 5, "cosine", range(0, len(matrix), 20)) >= 0.95


def test_tree_of_hard_rows(spark):
    few = np.array([[0.0, 1.0], [1.0, 0.0], [1.0, 1.0]])
    got = by_source(neighbours.knn_graph(frame(spark, few), 5, "euclidean").collect())
    assert {src: len(n) for src, n in got.items()} == {0: 2, 1: 2, 2: 2}
    assert neighbours.knn_graph(frame(spark, few).where("false"), 5).count() == 0
    copies = by_source(neighbours.knn_graph(frame(spark, np.ones((90, 2))), 3, "euclidean", cell_rows=8).collect())
    assert all([j for _, j in near] == [j for j in range(4) if j != i][:3] for i, near in copies.items()) and len(copies) == 90
    with pytest.raises(ValueError, match="pivots"):
        neighbours.knn_graph(frame(spark, np.ones((17_000, 1)) * np.arange(17_000)[:, None]), 1, "euclidean", "exact", cell_rows=1)


def test_fuzzy_graph_is_symmetric_and_calibrated(spark):
    rng = np.random.default_rng(5)
    matrix = rng.normal(size=(80, 3))
    knn = neighbours.knn_graph(frame(spark, matrix), 9, "euclidean").cache()
    edges = {(r["src"], r["dst"]): r["weight"] for r in neighbours.fuzzy_graph(knn, 10).collect()}
    assert all(edges[b, a] == w and 0 < w <= 1 + 1e-9 for (a, b), w in edges.items())
    # The nearest neighbour always has weight 1.
    for r in knn.where("rank = 1").collect():
        assert edges[r["src"], r["dst"]] == pytest.approx(1.0)
    knn.unpersist()


def test_mean_pool_with_an_empty_mask(spark):
    rows = [("a", [1.0, 2.0], 1), ("a", [3.0, 4.0], 1), ("a", [9.0, 9.0], 0), ("b", [5.0, 5.0], 0)]
    df = spark.createDataFrame(rows, "id string, v array<float>, m int")
    got = {r["id"]: r["embedding"] for r in vectors.mean_pool(df, "id", "v", "m").collect()}
    assert got == {"a": [2.0, 3.0], "b": [0.0, 0.0]}


def test_l2_normalize_keeps_zero(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "embedding array<float>")
    got = [r["embedding"] for r in vectors.l2_normalize(df).collect()]
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [0.0, 0.0]


TEXTS = ["red cell growth", "red cell death", "stellar orbit of planets", "", "red cell growth"]


@pytest.mark.parametrize("parts", [1, 4])
def test_embed_text_does_not_depend_on_the_partitioning(spark, parts):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string").repartition(parts)
    got = {r["id"]: np.array(r["embedding"]) for r in vectors.embed_text(df, dims=128).collect()}
    assert np.allclose(got[0], got[4]) and np.allclose(got[3], 0.0)
    assert np.linalg.norm(got[0]) == pytest.approx(1.0, abs=1e-6)
    assert got[0] @ got[1] > got[0] @ got[2]


def test_embed_text_with_an_own_encoder(spark):
    def make():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(1, "abc"), (2, None)], "id bigint, text string")
    got = {r["id"]: r["embedding"] for r in vectors.embed_text(df, make, batch=1).collect()}
    assert got[1] == pytest.approx([3 / 10**0.5, 1 / 10**0.5]) and got[2] == [0.0, 1.0]


def test_som_assign_prefers_the_first_of_equal_neurons(spark):
    book = spark.createDataFrame(
        [(0, 0, [0.0]), (0, 1, [2.0]), (1, 0, [2.0]), (1, 1, [9.0])], som.CODEBOOK
    )
    got = {
        r["id"]: (r["som_x"], r["som_y"])
        for r in som.som_assign(frame(spark, [[1.0], [2.0], [8.0]]), book).collect()
    }
    assert got == {0: (0, 0), 1: (0, 1), 2: (1, 1)}


@pytest.mark.parametrize("gx, gy", [(1, 1), (1, 4), (3, 2)])
def test_som_umatrix_shapes(spark, gx, gy):
    book = spark.createDataFrame(
        [(x, y, [float(x * x + y)]) for x in range(gx) for y in range(gy)], som.CODEBOOK
    )
    cells = som.som_umatrix(book).collect()
    assert len(cells) == gx * gy
    assert max(c["distance"] for c in cells) == (0.0 if gx * gy == 1 else 1.0)


def test_som_training_lowers_the_error(spark):
    rng = np.random.default_rng(1)
    matrix = np.vstack([rng.normal(size=(80, 4)) + 6 * rng.normal(size=4) for _ in range(4)])
    df = frame(spark, matrix)

    def error(epochs):
        book = som.som_train(df, 4, 3, sigma=0.5, epochs=epochs)
        return som.som_assign(df, book).agg(F.avg("error")).first()[0]

    assert error(10) < error(1)
    again = [tuple(r) for r in som.som_train(df.repartition(7), 3, 2, epochs=3).collect()]
    assert len(again) == 6


def test_som_density_has_empty_cells(spark):
    assigned = spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "id int, som_x int, som_y int")
    got = {(r["som_x"], r["som_y"]): r["density"] for r in som.som_density(assigned, 2, 2).collect()}
    assert got == {(0, 0): 2, (0, 1): 0, (1, 0): 0, (1, 1): 0}


def test_words_of_a_block_are_sent_once(spark):
    texts = spark.createDataFrame([(i, f"shared words w{i}") for i in range(50)], "id long, words string").coalesce(1)
    rows = vectors._counted(texts, 3).collect()
    sent = [(w, n) for r in rows if r["bucket"] >= 0 for w, n in zip(r["words"].split(b" "), np.frombuffer(r["counts"], "<i4"))]
    assert sorted(sent) == sorted([(b"shared", 50), (b"words", 50), *((f"w{i}".encode(), 1) for i in range(50))])
    assert [r["ids"] for r in rows if r["bucket"] < 0] == [list(range(50))]


def test_embed_text_of_odd_rows(spark):
    """Texts of one id add up, on each of its rows; no id, no text and no words give a zero vector."""
    rows = [(1, "alpha beta"), (1, "beta gamma"), (2, "alpha"), (None, "alpha"), (None, None), (3, None), (4, " ,- "), (5, "delta")]
    got = vectors.embed_text(spark.createDataFrame(rows, "id long, text string"), dims=40).collect()
    assert sorted(r["id"] or 0 for r in got) == [0, 0, 1, 1, 2, 3, 4, 5]

    def signs(word):
        parts = [hashlib.md5(f"42|0|{word}".encode()).hexdigest()[8 * p : 8 * p + 8] for p in range(2)]
        return np.array([1.0 if int(parts[d // 32], 16) >> d % 32 & 1 else -1.0 for d in range(40)])

    idf = {w: math.log(9 / (n + 1)) for w, n in (("alpha", 3), ("beta", 2), ("gamma", 1), ("delta", 1))}
    words = {1: "alpha beta beta gamma", 2: "alpha", 5: "delta"}
    for r in got:
        total = sum((idf[w] * signs(w) for w in words.get(r["id"], "").split()), np.zeros(40))
        assert np.allclose(r["embedding"], total / max(np.linalg.norm(total), 1e-12), atol=1e-6)


@pytest.mark.parametrize("twice", [False, True])
def test_meeting_yields_new_pairs_only(twice):
    rng = np.random.default_rng(8)
    n = 40
    ids = np.arange(n) * 7 if not twice else np.repeat(np.arange(n // 2) * 7, 2)
    vec, bound, source = rng.normal(size=(n, 5)), rng.uniform(0.5, 1.2, n), rng.random(n) < 0.8
    listed = [rng.choice(ids, 4).tolist() for _ in range(n)]
    links = [(int(m), int(i), bool(rng.random() < 0.5)) for m in range(12) for i in rng.choice(ids, 9)]
    people = pa.table({"id": ids, "vec": pa.array(vec.tolist()), "source": source, "listed": listed, "bound": bound})
    met = neighbours._meet(pa.table(list(zip(*links)), ["mid", "id", "fresh"]), people, "cosine").to_pylist()
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    wanted = set()
    for m in range(12):
        old = {i for mid, i, fresh in links if mid == m and not fresh}
        here = [r for r in range(n) if any(mid == m and i == ids[r] for mid, i, _ in links)]
        for r in here:
            for c in here:
                new = ids[r] not in old or ids[c] not in old
                known = not twice and ids[c] in listed[r]
                if new and not known and r != c and source[c] and 1 - unit[r] @ unit[c] <= bound[r]:
                    wanted.add((int(ids[r]), int(ids[c]), round(1 - unit[r] @ unit[c], 6)))
    assert {(r["src"], r["dst"], round(r["distance"], 6)) for r in met} == wanted
    assert twice or len(met) == len(wanted)
