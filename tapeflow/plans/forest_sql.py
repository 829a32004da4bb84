"""SQL twin of forests of random cuts: growing them on rows and scoring rows, a level at a time."""

from __future__ import annotations


def _down(name: str, rows: str, keep: str, nodes: str, trees: int, depth: int) -> list[str]:
    out = [f"{name}_0 AS (SELECT {keep}, k, x, t AS tree, 1 AS node FROM {rows}, (SELECT unnest(range({trees})) AS t))"]
    for i in range(depth):
        out.append(f"{name}_{i + 1} AS (SELECT {keep}, k, x, tree, CASE WHEN x[feature + 1] <= cut THEN 2 * node ELSE 2 * node + 1 END AS node "
                   f"FROM {name}_{i} JOIN {nodes} USING (k, tree, node))")
    return out


def grown(name: str, rows: str, features: int, labels: tuple[str, ...], trees: int, depth: int, seed: int) -> list[str]:
    """CTEs <name>_nodes and <name>_leaf from the table ``rows`` (k, cycle, x): one forest for each k."""
    def draw(what):
        return f"('0x' || substr(md5('{seed}-{what}-' || t || '-' || n), 1, 8))::BIGINT"

    def edges(f):
        return ", ".join(f"{f}(x[{i + 1}])" for i in range(features))
    counts = ", ".join(f"sum(CASE WHEN cycle = '{c}' THEN n * weight ELSE 0.0 END)::DOUBLE" for c in labels)
    return [
        f"{name}_edge AS (SELECT k, [{edges('min')}] AS lo, [{edges('max')}] AS hi FROM {rows} GROUP BY k)",
        f"{name}_weight AS (SELECT k, cycle, sum(n) OVER (PARTITION BY k)::DOUBLE / (count(*) OVER (PARTITION BY k) * n) AS weight FROM (SELECT k, cycle, count(*) AS n FROM {rows} GROUP BY 1, 2))",
        f"{name}_nodes AS (SELECT k, t AS tree, n AS node, feature, lo[feature + 1] + (hi[feature + 1] - lo[feature + 1]) * ({draw('cut')} / 4294967296.0::DOUBLE) AS cut FROM ("
        f"SELECT t, n, {draw('feature')} % {features} AS feature FROM (SELECT unnest(range({trees})) AS t), (SELECT unnest(range(1, {1 << depth})) AS n)), {name}_edge)",
        *_down(f"{name}_t", rows, "cycle", f"{name}_nodes", trees, depth),
        f"{name}_leaf AS (SELECT k, tree, node, [{counts}] AS counts FROM (SELECT k, tree, node, cycle, count(*) AS n FROM {name}_t_{depth} GROUP BY ALL) JOIN {name}_weight USING (k, cycle) GROUP BY 1, 2, 3)"]


def scored(name: str, rows: str, keys: str, model: str, labels: tuple[str, ...], trees: int, depth: int) -> list[str]:
    """CTE <name> (keys, k, cycle, confidence, p0, p1 ...) for the table ``rows`` (keys, k, x) by the forest ``model``."""
    n = len(labels)
    total = "list_sum(counts)"
    shares = ", ".join(f"avg(CASE WHEN {total} > 0 THEN counts[{i + 1}] / {total} ELSE 1.0::DOUBLE / {n} END) AS p{i}" for i in range(n))
    ps = ", ".join(f"round(p{i}, 12)" for i in range(n))
    names = ", ".join(f"'{c}'" for c in labels)
    return [
        *_down(f"{name}_s", rows, keys, f"{model}_nodes", trees, depth),
        f"{name} AS (SELECT *, [{names}][list_position([{ps}], greatest({ps}))] AS cycle, greatest({', '.join(f'p{i}' for i in range(n))}) AS confidence FROM ("
        f"SELECT {keys}, k, {shares} FROM {name}_s_{depth} LEFT JOIN {model}_leaf USING (k, tree, node) GROUP BY {keys}, k))"]
