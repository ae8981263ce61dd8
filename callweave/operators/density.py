"""Density clusters on a grid, with a hierarchy of density levels.

Points are binned into cells, and only cell counts are compared: cells that reach a density
level and share a face form a component of that level. Raising the level splits components;
`leaf` keeps the last splits, `eom` the components with the most mass above their birth. Work after
the first count grows with the number of occupied cells, not with points or pairs of points.

Nothing in it is tied to the number of points: the cell width follows from the key's count, spread and
effective dimension, as a density estimate's bandwidth does; the levels double from `min_samples` up to
the greatest density seen; and a component counts as a cluster only if its peak stands out of
the counting noise at the level where it splits off.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions import vectors
from callweave.session import materialize

# standard errors of a Poisson count that a peak must rise by (the square root of a count has error 1/2)
ERRORS = 4
HIGHEST_LEVEL = 62


def reduce_dimensions(points: DataFrame, vector: str, size: int, out: str = "reduced") -> DataFrame:
    """Principal components of the unit vectors; the fit sends one matrix of the vector's width."""
    unit = points.withColumn("_u", array_to_vector(vectors.unit(F.col(vector))))
    known = unit.filter(F.col("_u").isNotNull())
    if known.isEmpty():
        return points.withColumn(out, F.lit(None).cast("array<double>"))
    fitted = PCA(k=size, inputCol="_u", outputCol="_p").fit(known)
    return fitted.transform(unit).withColumn(out, vector_to_array("_p")).drop("_u", "_p")


def _cells(points: DataFrame, keys: Sequence[str], vector: str, size: int, width: float) -> DataFrame:
    """Cell of every point: one width for all axes, so axes of little spread fall into one cell.

    The width is `width` deviations of the widest axis, shrunk by the count to the power 1 / (d + 4), where d is
    the effective dimension (participation ratio of the variances).
    """
    coordinate = [F.element_at(vector, i + 1) for i in range(size)]
    spread = points.groupBy(*keys).agg(
        F.array(*[F.avg(c) for c in coordinate]).alias("_mean"),
        F.array(*[F.coalesce(F.var_pop(c), F.lit(0.0)) for c in coordinate]).alias("_var"),
        F.count(F.lit(1)).cast("double").alias("_n"),
    )
    total = F.aggregate("_var", F.lit(0.0), lambda a, v: a + v)
    squares = F.aggregate("_var", F.lit(0.0), lambda a, v: a + v * v)
    effective = F.coalesce(F.try_divide(total * total, squares), F.lit(1.0))
    scaled = spread.select(
        *keys, "_mean", (F.lit(width) * F.sqrt(F.array_max("_var")) * F.pow("_n", -1 / (effective + 4))).alias("_width")
    )
    if keys:
        placed = points.join(scaled, list(keys))
    else:
        placed = points.withColumn("_w", scaled.select(F.struct("_mean", "_width").alias("_w")).scalar()).select("*", "_w.*").drop("_w")
    steps = [F.coalesce(F.floor(F.try_divide(c - F.col("_mean")[i], F.col("_width"))), F.lit(0)) for i, c in enumerate(coordinate)]
    return placed.withColumn("cell", F.array(*steps)).drop("_mean", "_width")


def _shifted(axis: int, step: int) -> Column:
    return F.transform("cell", lambda x, i: F.when(i == axis, x + step).otherwise(x))


def _spread(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Each label moves to the least label its nodes touch, and on to that label's own move."""
    offered = links.join(labels, links.b == labels.node).groupBy("a").agg(F.min("root").alias("offer"))
    nearer = labels.join(offered, F.col("node") == F.col("a"), "left").select(
        "node", "root", F.least("root", "offer").alias("next")
    )
    move = nearer.groupBy(F.col("root").alias("label")).agg(F.min("next").alias("to"))
    again = move.select(F.col("label").alias("label2"), F.col("to").alias("to2"))
    moved = labels.join(move, F.col("root") == F.col("label")).join(again, F.col("to") == F.col("label2"), "left")
    return moved.select("node", F.col("root").alias("start"), F.least("to", "to2").alias("root"))


def connected(nodes: DataFrame, edges: DataFrame, key: str = "node") -> DataFrame:
    """Least reachable node of every node, as column `root`; edges must be listed both ways.

    Whole label groups merge with their least neighbour, so the rounds grow with the logarithm
    of a component's size. Each round is written to the shared folder.
    """
    links = materialize(edges.select(F.col("a"), F.col("b")))
    labels = materialize(nodes.select(F.col(key).alias("node"), F.col(key).alias("root")))
    while True:
        stepped = materialize(_spread(links, labels))
        labels = stepped.select("node", "root")
        if stepped.filter(F.col("root") < F.col("start")).isEmpty():
            return labels


def density_clusters(
    points: DataFrame,
    keys: Sequence[str],
    item: str,
    vector: str,
    size: int,
    min_cluster_size: int = 6,
    min_samples: int = 2,
    selection: str = "leaf",
    width: float = 1.0,
) -> DataFrame:
    """Cluster number of each point inside its key, -1 for noise; 0 is the largest cluster.

    Level l asks for `min_samples * 2**l` points in a cell and its face neighbours. Components
    with fewer than `min_cluster_size` points, or without a peak of their own, are no clusters.
    """
    if selection not in ("leaf", "eom"):
        raise ValueError(f"unknown selection: {selection}")
    keys = list(keys)
    placed = materialize(_cells(points.select(*keys, item, vector), keys, vector, size, width).select(*keys, item, "cell"))
    cells = placed.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n"))

    # face neighbours, with the cell itself
    shifts = F.concat(F.array(F.col("cell")), *[F.array(_shifted(d, -1), _shifted(d, 1)) for d in range(size)])
    touched = cells.select(*keys, F.col("cell").alias("from_cell"), F.explode(shifts).alias("cell"))
    dense = (
        touched.join(cells, [*keys, "cell"])
        .groupBy(*keys, F.col("from_cell").alias("cell"))
        .agg(F.sum("n").alias("density"), F.max(F.when(F.col("cell") == F.col("from_cell"), F.col("n"))).alias("n"))
    )
    levels = F.filter(F.sequence(F.lit(0), F.lit(HIGHEST_LEVEL)), lambda l: F.col("density") >= _threshold(l, min_samples))
    # short node numbers, fixed by writing them once
    nodes = materialize(dense.withColumn("level", F.explode(levels)).withColumn("node", F.monotonically_increasing_id()))
    near = nodes.select(*keys, "level", F.col("node").alias("a"), F.explode(shifts).alias("cell"))
    edges = near.join(nodes.select(*keys, "level", "cell", F.col("node").alias("b")), [*keys, "level", "cell"])
    roots = connected(nodes, edges.filter("a <> b"))
    tagged = nodes.join(roots, "node").select(*keys, "level", "cell", "n", "density", "root")
    kept = _clusters_of_levels(tagged, min_cluster_size, min_samples)
    chains = materialize(_chains(kept, keys))
    chosen = _leaves(chains) if selection == "leaf" else _most_mass(chains, keys, min_samples)
    members = chains.filter(F.col("root") == F.col("chain")).join(chosen, "chain", "left_semi")
    numbered = _numbered(members.select(*keys, "cell", "root", "size"), keys)
    found = placed.join(numbered, [*keys, "cell"], "left")
    return found.select(*keys, item, F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))


def _threshold(level: Column, min_samples: int) -> Column:
    return F.lit(float(min_samples)) * F.pow(F.lit(2.0), level)


def _clusters_of_levels(tagged: DataFrame, min_cluster_size: int, min_samples: int) -> DataFrame:
    """Cells of the components that are large enough and rise out of the noise where they split off."""
    saddle = F.when(F.col("level") == 0, F.lit(0.0)).otherwise(_threshold(F.col("level"), min_samples))
    sizes = tagged.groupBy("level", "root").agg(F.sum("n").alias("size"), F.max("density").alias("peak"))
    rising = 2 * (F.sqrt("peak") - F.sqrt(saddle)) >= ERRORS
    return tagged.join(sizes.filter((F.col("size") >= min_cluster_size) & rising).select("root", "size"), "root")


def _chains(kept: DataFrame, keys: list[str]) -> DataFrame:
    """Each cell and level with the cluster (`chain`, named by its first component) and the cluster it split from.

    A component with one successor is the same cluster, thinned out; with several it has split.
    """
    up = Window.partitionBy(*keys, "cell").orderBy("level")  # a cell has one row per level
    placed = kept.withColumn("parent", F.lag("root").over(up))
    parts = placed.select("level", "root", "parent").distinct()
    split = parts.filter("parent IS NOT NULL").groupBy("parent").agg((F.count(F.lit(1)) > 1).alias("split"))
    marked = placed.join(split, "parent", "left").withColumn("born", F.coalesce("split", F.lit(True)))
    path = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = marked.withColumn("chain", F.last(F.when(F.col("born"), F.col("root")), ignorenulls=True).over(path))
    named = named.withColumn("depth", F.sum(F.col("born").cast("int")).over(path))
    return named.withColumn("mother", F.when(F.col("born"), F.lag("chain").over(up))).select(
        *keys, "cell", "level", "root", "size", "chain", "depth", "born", "mother"
    )


def _leaves(chains: DataFrame) -> DataFrame:
    mothers = chains.filter("mother IS NOT NULL").select(F.col("mother").alias("chain")).distinct()
    return chains.select("chain").distinct().join(mothers, "chain", "left_anti")


def _most_mass(chains: DataFrame, keys: list[str], min_samples: int) -> DataFrame:
    """Clusters with more mass above their birth than what they split into: points times the rise of density."""
    parts = chains.select("chain", "depth", "level", "root", "size").distinct()
    lower = F.when(F.col("level") == 0, F.lit(0.0)).otherwise(_threshold(F.col("level") - 1, min_samples))
    rise = _threshold(F.col("level"), min_samples) - lower
    own = parts.groupBy("chain", "depth").agg(F.sum(F.col("size") * rise).alias("own"))
    mothers = chains.filter("mother IS NOT NULL").select("chain", "mother").distinct()
    known = materialize(own.join(mothers, "chain", "left"))
    deepest = known.agg(F.max("depth")).first()[0] or 0  # splits on top of each other, a few
    scores, below = None, None
    for depth in range(deepest, 0, -1):
        here = known.filter(F.col("depth") == depth)
        if below is None:
            here = here.withColumn("sum", F.lit(0.0))
        else:
            here = here.join(below, "chain", "left").withColumn("sum", F.coalesce("sum", F.lit(0.0)))
        here = materialize(here.select("chain", "mother", (F.col("own") >= F.col("sum")).alias("keep"), F.greatest("own", "sum").alias("score")))
        below = here.groupBy(F.col("mother").alias("chain")).agg(F.sum("score").alias("sum"))
        scores = here if scores is None else scores.unionByName(here)
    if scores is None:
        return known.select("chain")
    # of the kept clusters on a cell's path the first one wins
    path = Window.partitionBy(*keys, "cell").orderBy("depth")
    births = chains.filter("born").join(scores.filter("keep").select("chain"), "chain", "left_semi")
    first = births.withColumn("place", F.row_number().over(path)).filter("place = 1")
    return first.select("chain").distinct()


def _numbered(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cluster numbers by falling size; one row per cluster enters the ranking."""
    clusters = cells.groupBy(*keys, "root").agg(F.max("size").alias("size"), F.min("cell").alias("first"))
    by_size = Window.partitionBy(*keys).orderBy(F.desc("size"), "first", "root")
    numbers = clusters.select("root", (F.row_number().over(by_size) - 1).alias("cluster"))
    return cells.join(numbers, "root").select(*keys, "cell", "cluster")
