from __future__ import annotations

import numpy as np
import pytest
from test_hierarchy import _frame

from callweave.operators import density, spectral


def _ranks(x):
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, -1)
    return d.argsort(axis=1).argsort(axis=1)


def _trust(high, low, k=10):
    """Trustworthiness: how little intrudes on the k neighbours in the plane that was far before."""
    n = len(high)
    before, after = _ranks(high), _ranks(low)
    near = (after <= k) & (after > 0)
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(before - k, 0)[near].sum()


def _curve(n, seed=0):
    """Points along a closed curve in six dimensions; the plane of most variance runs through it three times."""
    rng = np.random.default_rng(seed)
    t = rng.uniform(0, 2 * np.pi, n)
    x = np.stack([h * f(k * t) for k, h in ((1, 0.8), (3, 1.3), (2, 1.0)) for f in (np.cos, np.sin)], axis=1)
    return x + rng.normal(size=x.shape) * 0.01


@pytest.mark.parametrize(("n", "leaf"), [(500, 1024), (1_200, 200)])
def test_curved_sheets_are_laid_out(spark, n, leaf):
    """The layout keeps neighbours better than principal components, in one task and by iteration."""
    x = _curve(n)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    frame = _frame(spark, x)
    got = spectral.layout(frame, ["firm"], "id", "v", 2, leaf=leaf).toPandas().sort_values("id")
    flat = density.reduce_dimensions(frame, "v", 2).select("id", "reduced").toPandas().sort_values("id")
    ours, principal = (np.stack(f["reduced"]) for f in (got, flat))
    assert _trust(unit, ours) > _trust(unit, principal) and _trust(unit, ours) > 0.95


def test_iteration_parts_blobs(spark):
    """The leading axes of a large key hold its three blobs far apart."""
    rng = np.random.default_rng(3)
    label = rng.integers(0, 3, 900)
    x = rng.normal(size=(900, 8)) * 0.5 + 4 * np.eye(8)[label]
    y = np.stack(spectral.layout(_frame(spark, x), ["firm"], "id", "v", 2, leaf=300).toPandas().sort_values("id")["reduced"])
    centres = np.stack([y[label == c].mean(axis=0) for c in range(3)])
    gaps = np.linalg.norm(centres[:, None] - centres[None], axis=2)[np.triu_indices(3, 1)]
    assert gaps.min() > 5 * max(y[label == c].std(axis=0).max() for c in range(3))


def test_few_points_and_nulls(spark):
    x = [[1.0, 0.0, 0.0], [1.0, 0.1, 0.0], None, [0.0, 0.0, 0.0], [0.0, 1.0, 0.0]]
    got = {r.id: r.reduced for r in spectral.layout(_frame(spark, x, [0, 0, 0, 0, 1]), ["firm"], "id", "v", 4).collect()}
    assert got[2] is None and got[3] is None and got[4] == [0.0] * 4
    assert len(got[0]) == 4 and got[0][1:] == [0.0] * 3


def test_a_chain_of_steps_reads_its_block_once(spark, capsys):
    """Four steps are four joins, not one more for every path back to the first block."""
    links = spark.sql("SELECT id % 3 AS scope, id AS a, id + 1 AS b, 0.5D AS weight FROM range(9)")
    x = spark.sql("SELECT id % 3 AS scope, id AS node, id * 1D AS degree, array(1D, 2D) AS x FROM range(9)")
    for _ in range(4):
        x = spectral._times(x, links, 2)
    x.explain("simple")
    plan = capsys.readouterr().out
    assert plan.count("Join") == 4


def test_a_wide_rotation_is_little_code(spark, capsys):
    """Written out term by term it passed the size that the JVM compiles."""
    width = 12
    x = spark.range(3).selectExpr("id AS scope", "id AS node", "1D AS degree", f"transform(sequence(1, {width}), i -> i * 1D + id) AS x")
    turn = np.random.default_rng(0).normal(size=(width, width))
    turns = spark.createDataFrame([(i, (turn + i).ravel().tolist()) for i in range(3)], "scope long, turn array<double>")
    out = spectral._turned(x, turns, width)
    for r in out.collect():
        assert np.allclose(r.x, (np.arange(1, width + 1) + r.node) @ (turn + r.scope))
    out.explain("simple")
    assert capsys.readouterr().out.count("turn#") < width * width


def test_steps_send_sums_not_links(spark, monkeypatch):
    """A step is the matrix product; links of one task that go to one node are summed before they are sent, some at a time."""
    rng = np.random.default_rng(7)
    w = np.where(rng.uniform(size=(60, 60)) < 0.3, rng.uniform(size=(60, 60)), 0.0)
    x = rng.normal(size=(60, 3))
    rows = [(f, int(a) + 100 * f, int(b) + 100 * f, float(w[a, b])) for f in (0, 1) for a, b in zip(*w.nonzero())]
    links = spark.createDataFrame(rows, "scope long, a long, b long, weight double")
    block = spark.createDataFrame([(f, i + 100 * f, (x[i] + f).tolist()) for f in (0, 1) for i in range(60)], "scope long, node long, x array<double>")
    got = {r.node: (r.scope, r.x) for r in spectral._times(block, links, 3).collect()}
    for f in (0, 1):
        want = w @ (x + f)
        for a in np.flatnonzero(w.any(axis=1)):
            assert got[a + 100 * f][0] == f and np.allclose(got[a + 100 * f][1], want[a])
    lists = spectral._listed(links).join(block.select("node", "x"), "node").toArrow().to_batches()
    monkeypatch.setattr(spectral, "SENT_LINKS", 10**6)
    assert sum(b.num_rows for b in spectral._sent(3)(iter(lists))) == len({a for _, a, _, _ in rows})
    monkeypatch.setattr(spectral, "SENT_LINKS", 100)
    total = {}
    for part in spectral._sent(3)(iter([b.slice(i, 1) for b in lists for i in range(b.num_rows)])):
        for row in part.to_pylist():
            total[row["node"]] = total.get(row["node"], 0) + np.array([row[f"x{c}"] for c in range(3)])
    assert total.keys() == got.keys() and all(np.allclose(total[n], got[n][1]) for n in got)
