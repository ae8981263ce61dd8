"""Grid density clusters as DuckDB SQL: cells, levels, recursive components, cluster tree."""

from __future__ import annotations

DEEPEST = 8


def clusters(points: str, key: str, axes: int, min_size: int, min_samples: int, selection: str, out: str) -> str:
    """Query over `points`, a query of `id`, `key` and the coordinate list `v` of length `axes`."""
    return f"""
    WITH RECURSIVE p AS ({points}),
    axis AS (SELECT k, i, avg(x) AS mean, coalesce(var_pop(x), 0) AS var FROM (
        SELECT {key} AS k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM p) GROUP BY k, i),
    spread AS (SELECT k, list(mean ORDER BY i) AS m, sum(var) AS t, sum(var * var) AS q, max(var) AS top FROM axis GROUP BY k),
    width AS (
        SELECT k, m, sqrt(top) * pow(n, -1 / (CASE WHEN q > 0 THEN t * t / q ELSE 1 END + 4)) AS w
        FROM spread JOIN (SELECT {key} AS k, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY 1) USING (k)),
    placed AS (
        SELECT id, k, [CASE WHEN w > 0 THEN CAST(floor((v[i] - m[i]) / w) AS BIGINT) ELSE 0 END for i in range(1, {axes + 1})] AS cell
        FROM (SELECT id, {key} AS k, v FROM p) JOIN width USING (k)),
    cells AS (SELECT k, cell, count(*) AS n FROM placed GROUP BY k, cell),
    dense AS (
        SELECT a.k, a.cell, any_value(a.n) AS n, sum(b.n) AS density FROM cells a JOIN cells b ON a.k = b.k
        WHERE list_sum([abs(a.cell[i] - b.cell[i]) for i in range(1, {axes + 1})]) <= 1 GROUP BY a.k, a.cell),
    nodes AS (
        SELECT *, row_number() OVER (ORDER BY k, level, cell) AS node
        FROM (SELECT *, unnest(range(0, 63)) AS level FROM dense) WHERE density >= {float(min_samples)} * pow(2.0, level)),
    edges AS (
        SELECT a.node AS a, b.node AS b FROM nodes a JOIN nodes b ON a.k = b.k AND a.level = b.level
        WHERE list_sum([abs(a.cell[i] - b.cell[i]) for i in range(1, {axes + 1})]) = 1),
    reach(a, b) AS (SELECT node, node FROM nodes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
    tagged AS (SELECT n.*, root FROM nodes n JOIN (SELECT a AS node, min(b) AS root FROM reach GROUP BY a) USING (node)),
    sizes AS (
        SELECT root, sum(n) AS size FROM tagged GROUP BY root, level
        HAVING sum(n) >= {min_size}
           AND 2 * (sqrt(max(density)) - sqrt(CASE WHEN level = 0 THEN 0 ELSE {float(min_samples)} * pow(2.0, level) END)) >= 4),
    kept AS (SELECT t.*, size, lag(root) OVER (PARTITION BY k, cell ORDER BY level) AS parent FROM tagged t JOIN sizes USING (root)),
    split AS (SELECT parent, count(DISTINCT root) > 1 AS split FROM kept WHERE parent IS NOT NULL GROUP BY parent),
    marked AS (SELECT kept.*, coalesce(split, true) AS born FROM kept LEFT JOIN split USING (parent)),
    named AS (
        SELECT *, last_value(CASE WHEN born THEN root END IGNORE NULLS) OVER path AS chain, sum(CAST(born AS INT)) OVER path AS depth
        FROM marked WINDOW path AS (PARTITION BY k, cell ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    chains AS (SELECT *, CASE WHEN born THEN lag(chain) OVER (PARTITION BY k, cell ORDER BY level) END AS mother FROM named),
    {_leaves() if selection == "leaf" else _most_mass(min_samples)},
    members AS (SELECT * FROM chains WHERE root = chain AND chain IN (SELECT chain FROM chosen)),
    numbers AS (
        SELECT root, row_number() OVER (PARTITION BY k ORDER BY size DESC, first, root) - 1 AS cluster
        FROM (SELECT k, root, max(size) AS size, min(cell) AS first FROM members GROUP BY k, root))
    SELECT {out}, CAST(coalesce(cluster, -1) AS INTEGER) AS cluster
    FROM placed LEFT JOIN (SELECT k, cell, cluster FROM members JOIN numbers USING (root)) USING (k, cell)"""


def _leaves() -> str:
    return "chosen AS (SELECT DISTINCT chain FROM chains WHERE chain NOT IN (SELECT mother FROM chains WHERE mother IS NOT NULL))"


def _most_mass(min_samples: int) -> str:
    low = f"CASE WHEN level = 0 THEN 0 ELSE {float(min_samples)} * pow(2.0, level - 1) END"
    parts = [
        f"""mass AS (
            SELECT chain, depth, max(mother) AS mother, sum(size * ({float(min_samples)} * pow(2.0, level) - {low})) AS own
            FROM (SELECT DISTINCT chain, depth, level, root, size, mother FROM chains) GROUP BY chain, depth)""",
        f"score{DEEPEST + 1} AS (SELECT NULL::BIGINT AS mother, NULL::BIGINT AS chain, 0.0::DOUBLE AS score, false AS keep WHERE false)",
    ]
    for d in range(DEEPEST, 0, -1):
        parts.append(
            f"""score{d} AS (
            SELECT mother, m.chain, greatest(own, coalesce(below, 0)) AS score, own >= coalesce(below, 0) AS keep
            FROM mass m LEFT JOIN (SELECT mother AS chain, sum(score) AS below FROM score{d + 1} GROUP BY mother) USING (chain)
            WHERE depth = {d})"""
        )
    kept = " UNION ALL ".join(f"SELECT chain FROM score{d} WHERE keep" for d in range(1, DEEPEST + 1))
    parts.append(
        f"""chosen AS (
            SELECT DISTINCT chain FROM (
                SELECT chain, row_number() OVER (PARTITION BY k, cell ORDER BY depth) AS place
                FROM chains WHERE born AND chain IN ({kept})) WHERE place = 1)"""
    )
    return ",\n    ".join(parts)
