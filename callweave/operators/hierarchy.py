"""Density clusters of any dimension: mutual reachability, a minimum spanning forest and a condensed tree.

A point's core distance is the distance to its `min_samples`-th neighbour, copies included; copies hang on one point by its core distance. Neighbours in the graph of `knn_graph` are linked at their mutual
reachability, the greatest of their distance and both core distances. The minimum spanning forest of these links is the
hierarchy of density levels: cutting it at a weight leaves the groups that are as dense as that. The condensed tree keeps the
splits that leave `min_cluster_size` points on both sides; `leaf` takes its last clusters, `eom` those with the most mass
above their birth. Links have a total order (weight, then nodes), so the forest and the clusters are the same however the links are dealt out.

The forest of a key with more than `part_links` links is built in Boruvka rounds: every component takes its least link to another
one, components are merged and parallel links are thinned out, until the rest fits. Then one task sorts the key's forest, 24 bytes
a point, and walks it with arrays of the same order; no vector and no text comes there.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.operators import knn_graph
from callweave.operators.density import connected
from callweave.session import materialize

NEIGHBORS = 15
PART_LINKS = 2_000_000
MERGE_ROWS = 65_536
LINK = ["weight", "a", "b"]


def reachability(edges: DataFrame, first: DataFrame, min_samples: int) -> tuple[DataFrame, DataFrame]:
    """Undirected links (a < b, weight) of the graph over `first`, whose points stand for `copies` each, and core distances (node, core).

    A point's copies are its nearest neighbours, and a neighbour counts as often as it has copies.
    """
    copies = first.select("node", "copies")
    nearer = Window.partitionBy("a").orderBy("distance", "b").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of k neighbours
    known = edges.join(copies.select(F.col("node").alias("b"), "copies"), "b").withColumn("reached", F.sum("copies").over(nearer))
    mine = copies.select(F.col("node").alias("a"), (F.col("copies") - 1).alias("own"))
    at = F.when(F.col("own") + F.col("reached") >= min_samples, F.col("distance"))
    listed = mine.join(known, "a", "left").groupBy("a", "own").agg(F.min(at).alias("near"), F.max("distance").alias("far"))
    core = F.when(F.col("own") >= min_samples, F.lit(0.0)).otherwise(F.coalesce("near", "far", F.lit(0.0)))
    cores = materialize(listed.select(F.col("a").alias("node"), core.alias("core")))
    pairs = edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("distance").alias("distance"))
    sides = [cores.select(F.col("node").alias(s), F.col("core").alias(f"core_{s}")) for s in "ab"]
    met = pairs.join(sides[0], "a").join(sides[1], "b")
    return met.select("a", "b", F.greatest("distance", "core_a", "core_b").alias("weight")), cores


def thinned(links: DataFrame, part_links: int = PART_LINKS) -> DataFrame:
    """Links (scope, a, b, weight) with the same minimum spanning forest, `part_links` more than its own at most per scope."""
    small = materialize(links.groupBy("scope").agg(F.count(F.lit(1)).alias("n")))
    large = small.filter(F.col("n") > part_links).select("scope")
    if large.isEmpty():
        return links
    kept = links.join(large, "scope", "left_anti").select("scope", *LINK)
    rest = materialize(links.join(large, "scope", "left_semi").select("scope", *LINK, F.col("a").alias("ca"), F.col("b").alias("cb")))
    while True:
        ends = [rest.select("scope", F.col(c).alias("c"), F.struct(*LINK, "ca", "cb").alias("link")) for c in ("ca", "cb")]
        best = ends[0].unionAll(ends[1]).groupBy("scope", "c").agg(F.min("link").alias("link"))
        chosen = materialize(best.select("scope", "link.*").distinct())
        kept = materialize(kept.unionAll(chosen.select("scope", *LINK)))
        both = chosen.select(F.col("ca").alias("a"), F.col("cb").alias("b")).unionAll(chosen.select(F.col("cb").alias("a"), F.col("ca").alias("b")))
        roots = connected(both.select(F.col("a").alias("node")).distinct(), both)
        for c in ("ca", "cb"):
            rest = rest.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c).drop(c).withColumnRenamed(f"{c}_root", c)
        apart = rest.filter("ca <> cb").groupBy("scope", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"))
        rest = materialize(apart.agg(F.min(F.struct(*LINK)).alias("link")).select("scope", "link.*", "ca", "cb"))
        left = rest.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
        done = materialize(left.filter(F.col("n") <= part_links).select("scope"))
        kept = kept.unionAll(rest.join(done, "scope", "left_semi").select("scope", *LINK))
        rest = rest.join(done, "scope", "left_anti")
        if left.filter(F.col("n") > part_links).isEmpty():
            return kept


class Merges:
    """Single-linkage merges of links in order: merge i makes node n + i of two nodes, at a weight."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray):
        self.n = n
        self.left, self.right, self.weight = [], [], []
        self.size = [1] * n
        top = list(range(n))  # union-find over points
        node = list(range(n))  # dendrogram node of a root
        parts = (slice(i, i + MERGE_ROWS) for i in range(0, len(a), MERGE_ROWS))  # never all links as Python numbers
        for x, y, w in chain.from_iterable(zip(a[p].tolist(), b[p].tolist(), weight[p].tolist(), strict=True) for p in parts):
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            while top[y] != y:
                top[y] = top[top[y]]
                y = top[y]
            if x == y:
                continue
            if self.size[node[x]] < self.size[node[y]]:
                x, y = y, x
            self.left.append(node[x])
            self.right.append(node[y])
            self.weight.append(w)
            self.size.append(self.size[node[x]] + self.size[node[y]])
            top[y] = x
            node[x] = n + len(self.left) - 1
        self.roots = [node[x] for x in range(n) if top[x] == x]

    def points(self, node: int) -> list[int]:
        found, waiting = [], [node]
        while waiting:
            x = waiting.pop()
            if x < self.n:
                found.append(x)
            else:
                waiting += (self.left[x - self.n], self.right[x - self.n])
        return found


def condensed(merges: Merges, min_cluster_size: int) -> tuple[list[int], list[float], np.ndarray]:
    """Parent and mass of the clusters, parents first, and the last cluster of every point; cluster 0 holds everything.

    The mass is the points' rise of density (1 / weight) above the birth, summed. Copies, at weight 0, count as
    half the least weight seen.
    """
    positive = [w for w in merges.weight if w > 0]
    least = min(positive) / 2 if positive else 1.0
    parent, birth, mass, last = [-1], [0.0], [0.0], np.zeros(merges.n, np.int64)
    big = [r for r in merges.roots if merges.size[r] >= min_cluster_size]
    waiting: list[tuple[int, int]] = []

    def born(node: int, of: int, rise: float) -> None:
        parent.append(of)
        birth.append(rise)
        mass.append(0.0)
        waiting.append((node, len(parent) - 1))

    if len(big) == 1:
        waiting.append((big[0], 0))
    else:
        for root in big:
            born(root, 0, 0.0)
    while waiting:
        node, cluster = waiting.pop()
        while node >= merges.n:
            i = node - merges.n
            rise = 1 / max(merges.weight[i], least)
            sides = merges.left[i], merges.right[i]
            large = [s for s in sides if merges.size[s] >= min_cluster_size]
            leaving = merges.size[node] - (merges.size[large[0]] if len(large) == 1 else 0)
            mass[cluster] += leaving * (rise - birth[cluster])
            for side in sides:
                if len(large) == 2:
                    born(side, cluster, rise)
                elif side not in large:
                    last[merges.points(side)] = cluster
            if len(large) != 1:
                break
            node = large[0]
        else:
            last[node] = cluster
    for root in merges.roots:
        if merges.size[root] < min_cluster_size:
            last[merges.points(root)] = 0
    return parent, mass, last


def selected(parent: list[int], mass: list[float], selection: str) -> np.ndarray:
    """The chosen cluster above or at each cluster, -1 for none. Cluster 0, everything, is never one."""
    n = len(parent)
    children = np.bincount(np.array(parent[1:], np.int64), minlength=n) if n > 1 else np.zeros(n, np.int64)
    chosen = children == 0
    if selection == "eom":
        below, chosen = np.zeros(n), np.zeros(n, bool)
        for c in range(n - 1, 0, -1):  # children come after their parents
            chosen[c] = not children[c] or mass[c] >= below[c]
            below[parent[c]] += mass[c] if chosen[c] else below[c]
    chosen[0] = False
    top = np.full(n, -1, np.int64)
    for c in range(1, n):
        top[c] = top[parent[c]] if top[parent[c]] >= 0 else c if chosen[c] else -1
    return top


def _numbered(labels: np.ndarray) -> np.ndarray:
    """Clusters from 0 by falling size, then by their first point."""
    names, first, sizes = np.unique(labels, return_index=True, return_counts=True)
    real = np.flatnonzero(names >= 0)
    order = real[np.lexsort((first[real], -sizes[real]))]
    number = np.full(len(names), -1)
    number[order] = np.arange(len(order))
    return number[np.searchsorted(names, labels)]


def cluster_labels(a: np.ndarray, b: np.ndarray, weight: np.ndarray, min_cluster_size: int, selection: str) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links and their clusters, -1 for noise."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    order = np.lexsort((y, x, weight))
    merges = Merges(len(nodes), x[order], y[order], weight[order])
    parent, mass, last = condensed(merges, min_cluster_size)
    return nodes, _numbered(selected(parent, mass, selection)[last])


def density_links(
    points: DataFrame, keys: Sequence[str], item: str, vector: str, min_samples: int = 2, neighbors: int = NEIGHBORS
) -> tuple[DataFrame, DataFrame]:
    """Stored points with their numbers, and the stored links of mutual reachability between them (scope, a, b, weight)."""
    if min_samples < 1:
        raise ValueError("a point's density takes a neighbour at least")
    placed = knn_graph.placed(points, keys, item, vector)
    first = knn_graph.heads(placed)
    links, cores = reachability(knn_graph.graph(first, max(neighbors, min_samples)), first, min_samples)
    between = links.join(first.select(F.col("node").alias("a"), "scope"), "a").select("scope", *LINK)
    copies = knn_graph.to_heads(placed, first).filter("head <> node").join(cores.withColumnRenamed("node", "head"), "head")
    to_copies = copies.select("scope", F.col("core").alias("weight"), F.col("head").alias("a"), F.col("node").alias("b"))
    return placed, materialize(between.unionByName(to_copies))


def link_clusters(links: DataFrame, min_cluster_size: int, selection: str = "leaf", part_links: int = PART_LINKS) -> DataFrame:
    """Cluster of each node of the links, numbered inside its scope by falling size, -1 for noise."""
    if selection not in ("leaf", "eom"):
        raise ValueError(f"unknown selection: {selection}")
    if min_cluster_size < 2:
        raise ValueError("a cluster has two points at least")

    def clustered(part: pa.Table) -> pa.Table:
        ends = [part.column(c).to_numpy() for c in ("a", "b", "weight")]
        nodes, found = cluster_labels(*ends, min_cluster_size, selection)
        return pa.Table.from_pydict({"node": nodes, "cluster": found.astype(np.int32)})

    return thinned(links, part_links).groupBy("scope").applyInArrow(clustered, "node long, cluster int")


def tree_clusters(
    points: DataFrame,
    keys: Sequence[str],
    item: str,
    vector: str,
    min_cluster_size: int = 6,
    min_samples: int = 2,
    selection: str = "leaf",
    neighbors: int = NEIGHBORS,
) -> DataFrame:
    """Cluster number of each point inside its key, -1 for noise; 0 is the largest cluster. Points without a vector are noise."""
    placed, links = density_links(points, keys, item, vector, min_samples, neighbors)
    labels = materialize(link_clusters(links, min_cluster_size, selection))  # the forest is walked once, however often it is read
    return placed.join(labels, "node", "left").select(*keys, item, F.coalesce("cluster", F.lit(-1)).alias("cluster"))
