from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from test_topics import _rand_index

from callweave.operators import hierarchy, knn_graph


def _frame(spark, x, firms=None):
    rows = [(int(firms[i]) if firms is not None else 0, i, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "firm int, id long, v array<double>")


def _exact(x, min_cluster_size, min_samples, selection):
    """The definition on all pairs: Prim's tree of mutual reachability, cut from the heaviest link down by plain recursion."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, min_samples]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    inside, links = {0}, []
    while len(inside) < n:
        w, i, j = min((reach[i, j], min(i, j), max(i, j)) for i in inside for j in range(n) if j not in inside)
        links.append((w, i, j))
        inside |= {i, j}
    nodes = []  # of the condensed tree: parent, birth, mass, points at birth

    def parts(points, edges):
        neighbours = {p: [] for p in points}
        for _, i, j in edges:
            neighbours[i].append(j)
            neighbours[j].append(i)
        seen, out = set(), []
        for p in points:
            if p not in seen:
                group, waiting = set(), [p]
                while waiting:
                    q = waiting.pop()
                    if q not in group:
                        group.add(q)
                        waiting += neighbours[q]
                seen |= group
                out.append((group, [e for e in edges if e[1] in group]))
        return out

    def grow(points, edges, parent, birth):
        me = len(nodes)
        nodes.append([parent, birth, 0.0, points, []])
        if parent >= 0:
            nodes[parent][4].append(me)
        while True:
            top = max(edges)
            halves = parts(points, [e for e in edges if e != top])
            large = [h for h in halves if len(h[0]) >= min_cluster_size]
            rise = 1 / top[0]
            leaving = len(points) - (len(large[0][0]) if len(large) == 1 else 0)
            nodes[me][2] += leaving * (rise - birth)
            if len(large) == 2:
                for p, e in large:
                    grow(p, e, me, rise)
            if len(large) != 1:
                return
            points, edges = large[0]

    grow(set(range(n)), links, -1, 0.0)

    def best(c):
        below = [best(k) for k in nodes[c][4]]
        total = sum(b[0] for b in below)
        if selection == "leaf":
            return (0, [c]) if not below else (0, sum((b[1] for b in below), []))
        return (nodes[c][2], [c]) if not below or nodes[c][2] >= total and c else (total, sum((b[1] for b in below), []))

    out = np.full(n, -1)
    for c in best(0)[1]:
        if c:
            out[list(nodes[c][3])] = c
    return out


def _same_groups(a, b):
    return ((a[:, None] == a[None]) == (b[:, None] == b[None])).all() and ((a < 0) == (b < 0)).all()


@pytest.mark.parametrize("selection", ["leaf", "eom"])
def test_clusters_are_those_of_the_definition(selection):
    """With all pairs as links, labels equal the exact ones."""
    for seed in range(12):
        rng = np.random.default_rng(seed)
        x = np.concatenate([rng.normal(c, s, (m, 3)) for c, s, m in ((0, 1, 30), (6, 0.5, 25), (7.5, 0.3, 15), (20, 5, 10))])
        n, k = len(x), int(rng.integers(1, 5))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        core = np.sort(d, axis=1)[:, k]
        i, j = np.triu_indices(n, 1)
        weight = np.maximum(d[i, j], np.maximum(core[i], core[j]))
        nodes, got = hierarchy.cluster_labels(i, j, weight, 5, selection)
        want = _exact(x, 5, k, selection)
        assert (nodes == np.arange(n)).all() and want.max() > 0
        assert _same_groups(got, want)


def _blobs(n, dims, seed=0):
    """Four blobs of unit variance, centres eight from the origin."""
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 4, n)
    x = rng.normal(size=(n, dims))
    if dims < 4:
        return x + 12 * np.stack([label % 2, label // 2], axis=1), label
    x[np.arange(n), label] += 8
    return x, label


@pytest.mark.parametrize(("n", "dims"), [(400, 2), (4_000, 4), (400, 10), (4_000, 10), (40_000, 10), (400, 15), (40_000, 15)])
def test_blobs_in_many_dimensions(spark, n, dims):
    """The clusters are the blobs, whatever the number of points and dimensions and the selection."""
    x, label = _blobs(n, dims)
    placed, links = hierarchy.density_links(_frame(spark, x), [], "id", "v", 5)
    for selection in ("leaf", "eom"):
        got = placed.join(hierarchy.link_clusters(links, n // 20, selection), "node", "left").toPandas().sort_values("id")
        cluster = got["cluster"].fillna(-1).astype(int).to_numpy()
        assert len(cluster) == n and set(cluster) - {-1} == {0, 1, 2, 3}
        assert _rand_index(label, cluster + 1) > 0.9


@pytest.mark.parametrize("selection", ["leaf", "eom"])
def test_the_forest_does_not_depend_on_its_parts(spark, selection):
    """Boruvka rounds over links that do not fit give the clusters of one pass; firms stay apart."""
    x, label = _blobs(900, 6, 3)
    firms = np.arange(900) % 3
    placed, links = hierarchy.density_links(_frame(spark, np.round(x, 1), firms), ["firm"], "id", "v", 3)
    one, many = (placed.join(hierarchy.link_clusters(links, 20, selection, p), "node").toPandas().sort_values("id") for p in (10**6, 150))
    assert one["cluster"].tolist() == many["cluster"].tolist()
    for firm in range(3):
        mine = one[one.firm == firm]
        assert _rand_index(label[mine["id"]], mine["cluster"].to_numpy() + 1) > 0.9


def test_neighbours_of_large_keys(spark):
    """Eight trees with cells of 256 points find nine in ten of the true neighbours, and exact distances."""
    x = np.random.default_rng(5).normal(size=(3_000, 10))
    placed = knn_graph.placed(_frame(spark, x), ["firm"], "id", "v")
    got = knn_graph.graph(placed, 10, trees=8, leaf=256).toPandas()
    ids = placed.select("node", "id").toPandas().set_index("node")["id"]
    a, b = ids[got["a"]].to_numpy(), ids[got["b"]].to_numpy()
    assert np.allclose(np.sqrt(((x[a] - x[b]) ** 2).sum(axis=1)), got["distance"]) and (a != b).all()
    assert (np.bincount(a) == 10).all()
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    true = np.argsort(d, axis=1)[:, 1:11]
    found = set(zip(a.tolist(), b.tolist()))
    assert np.mean([(i, j) in found for i in range(3_000) for j in true[i].tolist()]) > 0.9


def test_copies_nulls_and_tiny_keys(spark):
    """Copies beyond a cell's size, points without a vector, keys of one point, no points."""
    x = [[1.0, 2.0]] * 1500 + [[9.0, 9.0 + i / 100] for i in range(200)] + [None, [50.0, 50.0]]
    firms = [0] * len(x)
    firms[-1] = 1
    got = hierarchy.tree_clusters(_frame(spark, x, firms), ["firm"], "id", "v", 20, 3, "eom").toPandas().sort_values("id")["cluster"].to_numpy()
    assert len(set(got[:1500])) == 1 and len(set(got[1500:1700])) == 1 and got[0] != got[1500]
    assert got[1700] == got[1701] == -1
    none = _frame(spark, [[1.0]]).filter("id < 0")
    assert hierarchy.tree_clusters(none, ["firm"], "id", "v").count() == 0
    with pytest.raises(ValueError, match="selection"):
        hierarchy.tree_clusters(none, ["firm"], "id", "v", selection="best")


def test_lists_are_compared_in_small_batches():
    """A batch of 1,000 lists gives several of pairs, together the same ones."""
    rng = np.random.default_rng(1)
    ids = [rng.choice(10**6, 5, replace=False).tolist() for _ in range(1000)]
    lists = pa.RecordBatch.from_pydict({"ids": ids, "vectors": [rng.normal(size=(5, 3)).tolist() for _ in ids]})
    found = list(knn_graph._among(iter([lists])))
    assert [b.num_rows for b in found] == [20 * n for n in (256, 256, 256, 232)]
    pairs = {(a, b) for part in found for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist())}
    assert pairs == {(a, b) for row in ids for a in row for b in row if a != b}


def test_only_pairs_within_reach_are_sent():
    """A pair goes to the points whose last neighbour is not nearer than it."""
    rng = np.random.default_rng(2)
    ids = [rng.choice(10**6, n, replace=False).tolist() for n in (5, 3, 1, 4) * 100]
    x, reach = ([rng.uniform(0, 2, (len(row), n)).tolist() for row in ids] for n in (3, 1))
    reach = [[r for (r,) in row] for row in reach]
    reach[0][0] = float("inf")
    lists = pa.RecordBatch.from_pydict({"ids": ids, "vectors": x, "reach": reach})
    got = [(r["a"], r["b"], r["distance"]) for part in knn_graph._among(iter([lists])) for r in part.to_pylist()]
    want = []
    for nodes, v, far in zip(ids, x, reach):
        for i in range(len(nodes)):
            for j in range(len(nodes)):
                d = float(np.sqrt(((np.array(v[i]) - np.array(v[j])) ** 2).sum()))
                if i != j and d <= far[i]:
                    want.append((nodes[i], nodes[j], d))
    assert sorted(got) == sorted(want)


def test_cells_are_cut_without_carrying_vectors(spark, monkeypatch):
    """Stored rounds hold no vector, more rounds than were reckoned with too (equal points go by a coin); small keys are one cell."""
    x = np.random.default_rng(4).normal(size=(600, 3))
    x[100:400] = x[0]
    firms = [0] * 580 + [1] * 20
    placed = knn_graph.placed(_frame(spark, x, firms), ["firm"], "id", "v")
    stored, materialize = [], knn_graph.materialize
    monkeypatch.setattr(knn_graph, "materialize", lambda df: (stored.append(df.columns), materialize(df))[1])
    got = knn_graph.cells(placed, trees=3, leaf=32).toPandas()
    assert stored and not any("vector" in columns for columns in stored)
    large = got[got.groupby("scope")["node"].transform("nunique") > 20]
    assert (large.groupby("node")["tree"].agg(list).map(sorted).map(tuple) == (0, 1, 2)).all() and large["node"].nunique() == 580
    assert large.groupby(["tree", "path"]).size().max() <= 32
    small = got[~got["node"].isin(large["node"])]
    assert small[["tree", "path"]].drop_duplicates().values.tolist() == [[0, 0]] and len(small) == 20
    vectors = placed.select("node", "vector").toPandas().set_index("node")["vector"]
    assert all(list(vectors[n]) == list(v) for n, v in zip(got["node"], got["vector"]))


def test_lists_of_several_trees_are_merged():
    """Each neighbour once, at its least distance; ties go by number."""
    lists = pa.RecordBatch.from_pydict({"a": [7, 9], "ids": [[1, 2, 3, 2, 5, 4], [1]], "far": [[0.5, 0.4, 0.9, 0.3, 0.5, 0.5], [2.0]]})
    (got,) = knn_graph._merged(3)(iter([lists]))
    assert [tuple(r.values()) for r in got.to_pylist()] == [(7, 2, 0.3), (7, 1, 0.5), (7, 4, 0.5), (9, 1, 2.0)]
