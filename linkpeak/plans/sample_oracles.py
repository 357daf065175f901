"""SQL twins, for DuckDB, of the queries in samples.py and of those on explicit paths and k-means."""

from __future__ import annotations

import math

from linkpeak.operators.traffic import SAMPLED_FOR
from linkpeak.plans.oracles import _ALL, _ALL1, _BASE, _CHOSEN, _DEMAND, _FLOW, _HEAVY, _NET, _STATE, _TE, _VEC, _WORST, _listed, _r4, _report, _sum, _top, _with, percent
from linkpeak.sources.generators import STATE_CHANCES, poisson_steps


def _draw(seed: int, *keys: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join([str(seed), *keys])})), 1, 13) AS BIGINT)"


def _u(seed: int, *keys: str) -> str:
    return f"(({_draw(seed, *keys)} + 0.5) / {float(1 << 52)!r})"


def _normal(mean: float, deviation: float, seed: int, *keys: str) -> str:
    return f"({mean!r} + {deviation!r} * sqrt(-2 * ln({_u(seed, *keys)})) * cos({2 * math.pi!r} * {_u(seed + 7919, *keys)}))"


def _log_normal(sigma: float, seed: int, *keys: str) -> str:
    return f"exp({_normal(0.0, sigma, seed, *keys)})"


def _mean_one(cv: float, seed: int, *keys: str) -> str:
    v = math.log(1 + cv * cv)
    return f"exp({_normal(-v / 2, math.sqrt(v), seed, *keys)})"


def _pareto(shape: float, seed: int, *keys: str) -> str:
    scale = 2 ** (-1 / shape)
    return f"({scale!r} * pow({_u(seed, *keys)}, {-1 / shape!r}) - {scale!r})"


def _between(low: float, high: float, seed: int, *keys: str) -> str:
    return f"({low!r} + {high - low!r} * {_u(seed, *keys)})"


def _poisson(mean: float, seed: int, *keys: str) -> str:
    return f"CAST(len([x for x in [{', '.join(f'{x!r}::DOUBLE' for x in poisson_steps(mean))}] if x < {_u(seed, *keys)}]) AS DOUBLE)"


def _r6(x: str) -> str:
    return f"round({x} + 1e-9, 6)"


_PFX = "pfx AS (SELECT p_partkey AS prefix FROM part), srcs AS (SELECT n_nationkey AS src, n_regionkey + 1.0 AS weight FROM nation), grid AS (SELECT src, prefix FROM srcs CROSS JOIN pfx), sizes AS (SELECT (SELECT count(*) FROM srcs) / (SELECT count(*) FROM pfx) AS scale)"
_EXT = "ext_links AS (SELECT s_suppkey AS ext, s_nationkey AS router FROM supplier)"


def _distributions() -> str:
    k = "p_partkey"
    cells = {
        "uniform": _between(2.0, 5.0, 31, k),
        "normal": _normal(1.0, 2.0, 31, k),
        "exponential": f"(-ln({_u(31, k)}) / 0.5)",
        "poisson": _poisson(4.0, 31, k),
        "beta": f"list_sort([{', '.join(_u(31 + 101 * i, k) for i in range(4))}])[2]",
        "log_normal": _log_normal(0.5, 31, k),
        "log_normal_mean_one": _mean_one(0.8, 31, k),
        "pareto": _pareto(1.5, 31, k),
    }
    return f"SELECT p_partkey AS prefix, {', '.join(f'{_r6(x)} AS {name}' for name, x in cells.items())} FROM part"


def _ends(count: int, seed: int, weighted: bool = False, in_turn: bool = False) -> str:
    """wanted: prefix, path_no, egress, ingress."""
    path = ["p.prefix"] if in_turn else ["p.prefix", "n.path_no"]
    key = f"-ln({_u(seed, 'e.prefix', 'e.path_no', 's.src')}) / s.weight" if weighted else _draw(seed, "e.prefix", "e.path_no", "s.src")
    rank = "(n.path_no % (SELECT count(*) FROM borders)) + 1" if in_turn else "1"
    return f"""
egress_order AS (SELECT p.prefix, n.path_no, b.root, row_number() OVER (PARTITION BY p.prefix, n.path_no ORDER BY {_draw(seed + 1, *path, 'b.root')}, b.root) AS r, {rank} AS want FROM pfx p CROSS JOIN (SELECT unnest(range({count})) AS path_no) n CROSS JOIN borders b),
ends AS (SELECT prefix, CAST(path_no AS INTEGER) AS path_no, root AS egress FROM egress_order WHERE r = want),
entry_order AS (SELECT e.*, s.src, row_number() OVER (PARTITION BY e.prefix, e.path_no ORDER BY {key}, s.src) AS r FROM ends e JOIN srcs s ON s.src <> e.egress),
wanted AS (SELECT prefix, src AS ingress, egress, path_no FROM entry_order WHERE r = 1)"""


def _chosen(table: str, by: str, seed: int, many: str) -> str:
    return f"SELECT {by}, ext FROM (SELECT x.{by}, e.ext, {many} AS many, row_number() OVER (PARTITION BY x.{by} ORDER BY {_draw(seed, f'x.{by}', 'e.ext')}, e.ext) AS r FROM {table} x CROSS JOIN ext_links e) WHERE r <= many"


_BORDERS = "borders AS (SELECT DISTINCT s_nationkey AS root FROM supplier)"
_PARTS = {"running_time_sec": 0.25, "analysis_time_sec": 0.25 / 3, "clustering_time_sec": 0.5 / 3}


def _quantiles() -> str:
    cells = ", ".join(f"{_r4(f'quantile_cont(o_totalprice * {x!r}, {q})')} AS {name}_q{round(q * 100)}" for name, x in _PARTS.items() for q in (0.1, 0.5, 0.9))
    return f"SELECT CAST(c_nationkey * 10 AS BIGINT) AS num_edges, CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) % 3 AS BIGINT) AS link_failures, {cells} FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY 1, 2"


def _tables() -> str:
    five = {"min": "min(e)", "q25": "quantile_cont(e, 0.25)", "q50": "quantile_cont(e, 0.5)", "q75": "quantile_cont(e, 0.75)", "max": "max(e)"}
    numbers = ", ".join(f"{x} AS {name}" for name, x in five.items())
    shown = lambda form, digits: ", ".join(f"format('{form}', round({name} + 1e-12, {digits}))" for name in five)
    boxed = lambda form, digits: f"'[' || array_to_string([{shown(form, digits)}], ', ') || ']'"
    return f"""WITH m AS (SELECT 'r' || n_regionkey AS topo, CASE WHEN o_orderstatus = 'O' THEN 'inf' ELSE '10' END AS changes, o_totalprice * 0.25 / 1e6 AS e FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
f AS (SELECT topo, changes, {numbers} FROM m GROUP BY 1, 2)
SELECT lpad(topo, 8, ' ') || ' | ' || lpad(changes, 4, ' ') || ' | ' || {boxed('{:.5f}', 5)} || ' | ' || {boxed('{:07.4f}', 4)} AS text,
  topo || ' & \\EpsilonBoxPlot' || array_to_string(['{{' || x || '}}' for x in [{shown('{:.8f}', 8)}]], '') || ' \\\\' AS latex FROM f""".replace("{{", "{").replace("}}", "}")


_TREE = "tree AS (SELECT root, node, min(next_node) AS next_node FROM dag GROUP BY 1, 2)"
_WALK = f"{_TREE}, way AS (SELECT root, node, next_node AS last, [node, next_node] AS routers FROM tree UNION ALL SELECT w.root, w.node, t.next_node, list_append(w.routers, t.next_node) FROM way w JOIN tree t ON t.root = w.root AND t.node = w.last), ways AS (SELECT root, node, routers FROM way WHERE last = root)"
#: Links turned round, with every router as a root.
_TURNED = _NET.replace("links AS (SELECT", "straight AS (SELECT").replace("borders AS (SELECT DISTINCT s_nationkey AS root FROM supplier)", "links AS (SELECT edge_id, dst AS src, src AS dst, weight FROM straight), borders AS (SELECT router_id AS root FROM routers)").replace("AS edges FROM links GROUP", "AS edges FROM straight GROUP")

#: Worst loads of each prefix with what causes them: ties go to the larger source, then to the smaller egress.
_CAUSES = """
c_egress AS (
  SELECT prefix, edge_id, load AS worst, root AS egress, CAST(NULL AS INTEGER) AS ingress FROM (
    SELECT *, row_number() OVER (PARTITION BY prefix, edge_id ORDER BY round(load, 9) DESC, root) AS r
    FROM (SELECT d.prefix, f.root, f.edge_id, sum(d.demand * f.frac) AS load FROM demand d JOIN flow f ON f.src = d.src GROUP BY 1, 2, 3)
  ) WHERE r = 1
),
c_ingress AS (
  SELECT t.prefix, m.edge_id, t.total * m.frac AS worst, CAST(NULL AS INTEGER) AS egress, m.src AS ingress
  FROM totals t JOIN states s ON t.prefix = s.prefix JOIN (SELECT *, row_number() OVER (PARTITION BY egresses, edge_id ORDER BY round(frac, 9) DESC, src DESC) AS r FROM routed) m ON m.egresses = s.egresses AND m.r = 1
),
c_both AS (
  SELECT t.prefix, m.edge_id, t.total * m.frac AS worst, m.root AS egress, m.src AS ingress
  FROM totals t, (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY round(frac, 9) DESC, src DESC, root) AS r FROM flow) m WHERE m.r = 1
)"""

#: Loads of prefixes with explicit paths for every compatible set that counts: up to two of their paths' egresses, with or without one other.
_TE_WORST = """
lp AS (SELECT DISTINCT s_nationkey AS egress, 100 + 50 * (s_suppkey % 3) AS v FROM supplier),
te_of AS (SELECT DISTINCT prefix FROM te),
te_eg AS (SELECT DISTINCT t.prefix, l.egress, l.v FROM te t JOIN lp l ON l.egress = t.egress),
values_of AS (SELECT prefix, v FROM te_of CROSS JOIN (SELECT DISTINCT v FROM lp)),
opt_te AS (SELECT prefix, v, egress FROM te_eg UNION ALL SELECT prefix, v, NULL FROM values_of),
opt_other AS (SELECT o.prefix, l.v, l.egress FROM te_of o CROSS JOIN lp l WHERE NOT EXISTS (SELECT 1 FROM te_eg t WHERE t.prefix = o.prefix AND t.egress = l.egress) UNION ALL SELECT prefix, v, NULL FROM values_of),
te_sets AS MATERIALIZED (
  SELECT row_number() OVER () AS set_id, * FROM (
    SELECT DISTINCT a.prefix, a.egress AS a, b.egress AS b, c.egress AS c FROM opt_te a
    JOIN opt_te b ON b.prefix = a.prefix AND b.v = a.v AND (b.egress IS NULL OR b.egress > a.egress)
    JOIN opt_other c ON c.prefix = a.prefix AND c.v = a.v WHERE a.egress IS NOT NULL OR c.egress IS NOT NULL
  )
),
set_members AS (SELECT set_id, prefix, x AS root FROM (SELECT set_id, prefix, unnest([a, b, c]) AS x FROM te_sets) WHERE x IS NOT NULL),
set_chosen AS (SELECT m.set_id, m.prefix, c.src, arg_min(c.root, c.cost * 1000 + c.root) AS root FROM set_members m JOIN costs c ON c.root = m.root GROUP BY 1, 2, 3),
set_cells AS (SELECT k.set_id, k.prefix, k.src, k.root, d.demand FROM set_chosen k JOIN demand d ON d.prefix = k.prefix AND d.src = k.src),
set_load AS (
  SELECT set_id, prefix, edge_id, sum(load) AS load FROM (
    SELECT c.set_id, c.prefix, unnest(t.edges) AS edge_id, c.demand AS load FROM set_cells c JOIN te t ON t.prefix = c.prefix AND t.ingress = c.src AND t.egress = c.root
    UNION ALL
    SELECT c.set_id, c.prefix, f.edge_id, c.demand * f.frac FROM set_cells c JOIN flow f ON f.root = c.root AND f.src = c.src
    WHERE NOT EXISTS (SELECT 1 FROM te t WHERE t.prefix = c.prefix AND t.ingress = c.src AND t.egress = c.root)
  ) GROUP BY 1, 2, 3
),
te_now AS (
  SELECT prefix, edge_id, sum(load) AS current FROM (
    SELECT c.prefix, unnest(t.edges) AS edge_id, c.demand AS load FROM cells c JOIN te t ON t.prefix = c.prefix AND t.ingress = c.src AND t.egress = c.root
    UNION ALL
    SELECT c.prefix, f.edge_id, c.demand * f.frac FROM cells c JOIN flow f ON f.root = c.root AND f.src = c.src
    WHERE NOT EXISTS (SELECT 1 FROM te t WHERE t.prefix = c.prefix AND t.ingress = c.src AND t.egress = c.root)
  ) GROUP BY 1, 2
),
worst_of AS (
  SELECT prefix, edge_id, max(load) AS worst FROM set_load GROUP BY 1, 2
  UNION ALL SELECT prefix, edge_id, worst FROM w_mixed WHERE prefix NOT IN (SELECT prefix FROM te_of)
),
te_diffs AS (
  SELECT coalesce(w.edge_id, n.edge_id) AS edge_id, coalesce(w.worst, 0) AS worst, coalesce(n.current, 0) AS current, round(coalesce(w.worst, 0) - coalesce(n.current, 0), 9) AS diff
  FROM worst_of w FULL JOIN te_now n ON n.prefix = w.prefix AND n.edge_id = w.edge_id
)"""

_ONE_CHANGE = "changes AS (SELECT coalesce(w.edge_id, c.edge_id) AS edge_id, coalesce(w.prefix, c.prefix) AS prefix, coalesce(w.worst, 0) AS worst, coalesce(c.current, 0) AS current, w.egress, w.ingress FROM w_named w FULL JOIN current_of c ON c.prefix = w.prefix AND c.edge_id = w.edge_id), ranked AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY round(worst - current, 9) DESC, prefix) AS r FROM changes)"
_NAMED = "w_named AS (" + " UNION ALL ".join(f"SELECT w.* FROM c_{kind} w JOIN rules r ON r.prefix = w.prefix WHERE r.kind = '{kind}'" for kind in ("egress", "ingress", "both")) + ")"


def _kmeans(k: int, steps: int) -> str:
    """Means and assignments in turn, unrolled; once nothing moves, further steps change nothing."""
    near = "SELECT prefix, CAST(min([round(d, 6), cluster])[2] AS INTEGER) AS cluster FROM (SELECT v.prefix, p.cluster, sum(abs(v.norm - p.centre) * v.scale) AS d FROM vec v JOIN {points} p ON v.src = p.src GROUP BY 1, 2) GROUP BY prefix"
    parts = [_DEMAND, _VEC.replace("vec AS (", "vec AS MATERIALIZED ("), _HEAVY.format(k=k), f"points_0 AS MATERIALIZED (SELECT p.cluster, v.src, v.norm AS centre FROM vec v JOIN parts p ON v.prefix = p.prefix WHERE p.cluster < {k})"]
    for i in range(steps):
        means = f"SELECT a.cluster, v.src, sum(v.demand) / sum(v.scale) AS centre FROM vec v JOIN ({near.format(points=f'points_{i}')}) a ON a.prefix = v.prefix GROUP BY 1, 2"
        parts.append(f"points_{i + 1} AS MATERIALIZED (SELECT p.cluster, p.src, coalesce(m.centre, 0) AS centre FROM points_{i} p LEFT JOIN ({means}) m ON m.cluster = p.cluster AND m.src = p.src)")
    return _with(*parts) + f" SELECT prefix, CAST(cluster AS INTEGER) AS cluster FROM ({near.format(points=f'points_{steps}')})"


_BUDGET = """
egress_classes AS (
  SELECT 'egress:' || array_to_string(s.egresses, ',') AS class, count(DISTINCT d.prefix) AS members, sum(d.demand) AS total
  FROM demand d JOIN states s ON s.prefix = d.prefix JOIN rules r ON r.prefix = d.prefix WHERE r.kind = 'egress' GROUP BY 1
),
room AS (SELECT *, members - 1 AS room, {budget} - (SELECT count(*) FROM egress_classes) AS free FROM egress_classes),
filling AS (
  SELECT *, free - coalesce(sum(room) OVER (ORDER BY room / total, class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free_here,
    sum(total) OVER (ORDER BY room / total, class ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS total_here FROM room
),
filled AS (SELECT *, min(CASE WHEN floor(free_here * (total / total_here)) >= room THEN 1 ELSE 0 END) OVER (ORDER BY room / total, class ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS is_full FROM filling),
quotas AS (SELECT *, (free - (SELECT coalesce(sum(room), 0) FROM filled WHERE is_full)) * (total / (SELECT sum(total) FROM filled WHERE NOT is_full)) AS q FROM filled),
placed AS (
  SELECT *, row_number() OVER (ORDER BY is_full, round(q - floor(q), 9) DESC, members, class) AS place,
    free - (SELECT coalesce(sum(room), 0) FROM filled WHERE is_full) - (SELECT sum(floor(q)) FROM quotas WHERE NOT is_full) AS more FROM quotas
)"""

#: Classes in the place of prefixes: their demand, state and rule.
_CLASSES = """
members AS (SELECT s.prefix, s.egresses, r.kind, dense_rank() OVER (ORDER BY r.kind, s.egresses) AS class FROM single_states s JOIN single_rules r ON r.prefix = s.prefix),
demand AS (SELECT d.src, m.class AS prefix, sum(d.demand) AS demand FROM single_demand d JOIN members m ON m.prefix = d.prefix GROUP BY 1, 2),
states AS (SELECT DISTINCT class AS prefix, egresses FROM members),
rules AS (SELECT DISTINCT class AS prefix, kind FROM members)"""

_STRINGS = """
named_links AS (SELECT l.*, r.region AS graph FROM links l JOIN routers r ON r.router_id = l.src),
strings AS (SELECT graph, string_agg(src || ':' || dst || ':' || weight || ';' || dst || ':' || dst || ':7;' || src || ':' || dst || ':99', ';' ORDER BY edge_id) || ';' AS edges FROM named_links GROUP BY graph),
pieces AS (SELECT graph, generate_subscripts(string_split(edges, ';'), 1) AS place, unnest(string_split(edges, ';')) AS e FROM strings),
rows_of AS (SELECT graph, place, string_split(e, ':') AS p FROM pieces WHERE e <> ''),
seen AS (SELECT graph, node, min(place) AS place FROM (SELECT graph, 2 * place AS place, p[1] AS node FROM rows_of UNION ALL SELECT graph, 2 * place + 1, p[2] FROM rows_of) GROUP BY 1, 2),
ids AS (SELECT graph, node, CAST(row_number() OVER (PARTITION BY graph ORDER BY place) - 1 AS INTEGER) AS id FROM seen)"""


def _sweep() -> str:
    base = (300, "10", 30, 0, 2)
    rows = [base, *((c, "10", 30, 0, 2) for c in (100, 600, 1000)), *((300, k, 30, 0, 2) for k in ("1", "100", "inf")), (300, "10", 100, 0, 2), *((300, "10", 30, p, 2) for p in (1, 3, 5)), *((300, "10", 30, 0, x) for x in (0, 1))]
    listed = ", ".join(f"({c}, '{k}', {e}, {p}, {x})" for c, k, e, p, x in rows)
    return _with(_NET, "n AS (SELECT count(*) AS n FROM units)") + f" SELECT clusters, k, externals, te_paths, l, CAST(1 + CASE WHEN l >= 1 THEN n ELSE 0 END + CASE WHEN l >= 2 THEN n * (n - 1) // 2 ELSE 0 END AS BIGINT) AS scenarios FROM (VALUES {listed}) v(clusters, k, externals, te_paths, l), n"


def _report_columns() -> str:
    total = "(SELECT round(sum(demand)) FROM demand)"
    load = lambda x: f"coalesce((SELECT load FROM {x} y WHERE y.edge_id = l.edge_id), 0)"
    shown = lambda x: percent(f"greatest({load(x)}, 0)" if x == "changed" else load(x), total)
    return _with(*_ALL, _WORST, _top(1), f"unbounded AS {_sum('w_mixed')}") + f" SELECT lpad(a.name, 20, ' ') || ' -> ' || rpad(b.name, 20, ' ') || ': ' || {shown('fixed')} || ' | ' || {shown('changed')} || ' ± 0.0% | ' || {shown('unbounded')} || ' +5.0% -2.0%' AS line FROM links l JOIN routers a ON a.router_id = l.src JOIN routers b ON b.router_id = l.dst"


_STATE3 = f"CASE WHEN {_u(21, 'x.prefix')} < 0.6 THEN 1 WHEN {_u(21, 'x.prefix')} < 0.9 THEN 2 ELSE 3 END"
_STATE4 = f"CASE WHEN {_u(24, 'x.state')} < 0.3 THEN 1 WHEN {_u(24, 'x.state')} < 0.6 THEN 2 WHEN {_u(24, 'x.state')} < 0.8 THEN 3 ELSE 4 END"

SQL: dict[str, str] = {
    "complete_graph": "SELECT CAST(a.n_nationkey * (SELECT count(*) - 1 FROM nation) + b.n_nationkey - CASE WHEN b.n_nationkey > a.n_nationkey THEN 1 ELSE 0 END AS INTEGER) AS edge_id, a.n_nationkey AS src, b.n_nationkey AS dst, CAST(1 AS BIGINT) AS weight FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey",
    "random_weights": _with(_NET) + f" SELECT src, dst, 10 + {_draw(5, 'least(src, dst)', 'greatest(src, dst)')} % 91 AS weight FROM links",
    "internal_graph": _with(_NET) + " SELECT edge_id, src, dst, CAST(round(weight + 0.4) AS BIGINT) AS weight FROM links",
    "external_routers": f"WITH r AS (SELECT n_nationkey AS router, row_number() OVER (ORDER BY {_draw(3, 'n_nationkey')}, n_nationkey) - 1 AS place, count(*) OVER () AS n FROM nation) SELECT CAST(t * n + place AS INTEGER) AS ext, router FROM r, (SELECT unnest(range(60)) AS t) WHERE t * n + place < 60",
    "random_states": _with(_PFX, _EXT) + " " + _chosen("pfx", "prefix", 22, _STATE3),
    "pooled_states": _with(_PFX, _EXT, f"taken AS (SELECT prefix, CAST(floor(ln({_u(22, 'prefix')}) / {math.log(1 - STATE_CHANCES[10])!r}) AS INTEGER) AS state FROM pfx)", "states_of AS (SELECT DISTINCT state FROM taken)", f"drawn AS ({_chosen('states_of', 'state', 25, _STATE4)})") + " SELECT t.prefix, d.ext FROM taken t JOIN drawn d ON d.state = t.state",
    "distributions": _distributions(),
    "gravity_matrix": _with(_PFX) + f" SELECT src, prefix, {_r6(f'{_between(0.75, 1.25, 41, chr(115) + "rc")} * {_pareto(1.5, 42, "prefix")} * (1 / {_between(0.75, 1.25, 43, "src", "prefix")}) * scale')} AS demand FROM grid, sizes",
    "gravity_matrix_options": _with(_PFX, f"att AS (SELECT prefix, {_mean_one(0.8, 43, 'prefix')} AS a FROM pfx)", f"m AS (SELECT src, g.prefix, {_log_normal(0.5, 42, 'src')} * a * {_log_normal(0.5, 44, 'src', 'g.prefix')} * scale AS d FROM grid g JOIN att ON att.prefix = g.prefix, sizes)", "s AS (SELECT prefix, sum(d) AS s FROM m GROUP BY 1)")
    + f" SELECT src, m.prefix, {_r6('d * (a / (SELECT sum(a) FROM att) * (SELECT sum(d) FROM m) / s)')} AS demand FROM m JOIN s ON s.prefix = m.prefix JOIN att ON att.prefix = m.prefix",
    "iid_matrix": _with(_PFX) + f" SELECT src, prefix, {_poisson(4.0, 43, 'src', 'prefix')} AS demand FROM grid",
    "all_pairs_matrix": f"SELECT a.n_nationkey AS src, CAST(b.n_nationkey AS BIGINT) AS prefix, b.n_nationkey AS router, {_r6(f'{_log_normal(0.5, 44, "a.n_nationkey")} * {_log_normal(0.5, 45, "b.n_nationkey")} * {_log_normal(0.5, 46, "a.n_nationkey", "b.n_nationkey")}')} AS demand FROM nation a CROSS JOIN nation b",
    "parsed_edges": _with(_NET, _STRINGS) + " SELECT r.graph, p[1] AS src, p[2] AS dst, CAST(arg_min(p[3], place) AS BIGINT) AS weight, any_value(a.id) AS src_id, any_value(b.id) AS dst_id FROM rows_of r JOIN ids a ON a.graph = r.graph AND a.node = p[1] JOIN ids b ON b.graph = r.graph AND b.node = p[2] WHERE p[1] <> p[2] GROUP BY r.graph, p[1], p[2]",
    "te_ends_weighted": _with(_PFX, _BORDERS, _ends(2, 51, weighted=True)) + " SELECT * FROM wanted",
    "te_ends_alike": _with(_PFX, _BORDERS, _ends(2, 52)) + " SELECT * FROM wanted",
    "te_ends_in_turn": _with(_PFX, _BORDERS, _ends(3, 53, in_turn=True)) + " SELECT * FROM wanted",
    "te_path_costs": _with(_NET, _PFX, _ends(1, 54, weighted=True), f"drawn AS MATERIALIZED (SELECT w.*, l.src, l.dst, 1 + {_draw(55, 'w.prefix', 'w.ingress', 'w.egress', 'w.path_no', 'l.edge_id')} % 10 AS weight FROM wanted w CROSS JOIN links l)", "walk AS (SELECT prefix, ingress, egress, ingress AS node, CAST(0 AS BIGINT) AS cost FROM wanted UNION SELECT w.prefix, w.ingress, w.egress, d.dst, w.cost + d.weight FROM walk w JOIN drawn d ON d.prefix = w.prefix AND d.src = w.node WHERE w.node <> w.egress AND w.cost + d.weight <= 45)")
    + " SELECT prefix, ingress, egress, min(cost) AS cost FROM walk WHERE node = egress GROUP BY 1, 2, 3",
    "destination_tree": _with(_NET, _BASE, _FLOW, _TREE) + " SELECT root, node, next_node FROM tree",
    "source_tree": _with(_TURNED, _BASE, _FLOW, _TREE) + " SELECT root AS source, node, next_node AS from_node FROM tree",
    "tree_paths": _with(_NET, _BASE, _FLOW, _WALK) + f" SELECT root, node, {_listed('routers')} AS routers FROM ways",
    "tree_subpaths": _with(_NET, _BASE, _FLOW, _WALK, "cut AS (SELECT root, node, routers, list_position(routers, 1) AS a, list_position(routers, 0) AS b FROM ways)") + f" SELECT root, node, {_listed('routers[a:b]')} AS routers, CAST(b - a AS INTEGER) AS hops FROM cut WHERE a > 0 AND b >= a",
    "subtree_sizes": _with(_NET, _BASE, _FLOW, _WALK) + " SELECT root, count(*) AS nodes FROM ways WHERE list_contains(routers, 0) GROUP BY root",
    "csv_report": _quantiles(),
    "accuracy_tables": _tables(),
    "link_report_columns": _report_columns(),
    "causes_k1": _with(*_ALL, _WORST, _top(1), _CAUSES, _NAMED, _ONE_CHANGE) + f" SELECT l.src, l.dst, CAST(r.r AS INTEGER) AS rank, r.prefix, {_r4('r.current')} AS current, {_r4('r.worst')} AS worst, r.egress, r.ingress FROM links l JOIN changed c ON c.edge_id = l.edge_id AND c.load > 0 JOIN ranked r ON r.edge_id = l.edge_id AND r.r = 1",
    "failures_l1_k1_failed": _with(*_ALL1, _WORST, _top(1), "best AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY round(load, 9) DESC, scenario_id) AS r FROM changed WHERE load > 0)") + f" SELECT l.src, l.dst, {_r4('coalesce(b.load, 0)')} AS load, {_listed('s.failed')} AS failed FROM links l LEFT JOIN best b ON b.edge_id = l.edge_id AND b.r = 1 LEFT JOIN scenarios s ON s.scenario_id = b.scenario_id",
    "worst_ingress_witness": _with(*_ALL, _WORST, _CAUSES) + f" SELECT prefix, edge_id, {_r4('worst')} AS worst, ingress FROM c_ingress",
    "worst_both_witness": _with(*_ALL, _WORST, _CAUSES) + f" SELECT prefix, edge_id, {_r4('worst')} AS worst, egress, ingress FROM c_both",
    "te_worst_k1": _with(*_ALL, _WORST, _TE, _TE_WORST) + f" SELECT l.src, l.dst, {_r4('coalesce(sum(d.current) + max(d.diff), 0)')} AS load FROM links l LEFT JOIN te_diffs d ON d.edge_id = l.edge_id GROUP BY l.src, l.dst",
    "te_worst_inf": _with(*_ALL, _WORST, _TE, _TE_WORST) + f" SELECT l.src, l.dst, {_r4('coalesce(sum(d.worst), 0)')} AS load FROM links l LEFT JOIN te_diffs d ON d.edge_id = l.edge_id GROUP BY l.src, l.dst",
    "graph_counts": _with(_NET) + " SELECT (SELECT count(*) FROM routers) AS nodes, (SELECT count(*) FROM links) AS edges",
    "demand_shares": _with(_DEMAND) + " SELECT src, round(sum(demand) / (SELECT sum(demand) FROM demand), 9) AS share FROM demand GROUP BY src",
    "sampled_for": f"""WITH known(a, r, f, sample_attraction, sample_repulsion, sample_friction) AS (VALUES {', '.join(f'({", ".join(map(str, (*w, *(f"{x}::DOUBLE" for x in s))))})' for w, s in SAMPLED_FOR)}),
wanted AS (SELECT p_partkey, 20 + p_size % 6 * 5 AS a, 20 + p_size % 4 * 5 AS r, 30 + p_size % 3 * 5 AS f FROM part)
SELECT w.p_partkey, w.a / 10.0 AS attraction, w.r / 10.0 AS repulsion, w.f / 10.0 AS friction, sample_attraction, sample_repulsion, sample_friction FROM wanted w LEFT JOIN known k ON k.a = w.a AND k.r = w.r AND k.f = w.f""",
    "classes_by_members": _with(_DEMAND, _STATE, f"c AS (SELECT r.kind, {_listed('s.egresses')} AS egresses, count(DISTINCT d.prefix) AS members, {_r4('sum(d.demand)')} AS total FROM demand d JOIN states s ON d.prefix = s.prefix JOIN rules r ON r.prefix = d.prefix GROUP BY r.kind, s.egresses)")
    + " SELECT *, CAST(row_number() OVER (ORDER BY members DESC, kind, egresses) AS INTEGER) AS by_members, CAST(row_number() OVER (ORDER BY total DESC, kind, egresses) AS INTEGER) AS by_demand FROM c",
    "class_demand": _with(_DEMAND, _STATE) + f" SELECT r.kind, {_listed('s.egresses')} AS egresses, d.src, {_r4('sum(d.demand)')} AS demand FROM demand d JOIN states s ON d.prefix = s.prefix JOIN rules r ON r.prefix = d.prefix GROUP BY r.kind, s.egresses, d.src",
    "cluster_budget": _with(_DEMAND, _STATE, _BUDGET.format(budget=600)) + " SELECT class, CAST(CASE WHEN free <= 0 THEN 1 ELSE 1 + (CASE WHEN is_full THEN room ELSE floor(q) + CASE WHEN place <= more THEN 1 ELSE 0 END END) END AS INTEGER) AS k FROM placed",
    "cluster_members": _with(_DEMAND, _VEC, _HEAVY.format(k=50)) + " SELECT cluster, CAST(count(*) AS INTEGER) AS members, md5(string_agg(CAST(prefix AS VARCHAR), ',' ORDER BY prefix)) AS prefixes FROM parts GROUP BY cluster",
    "first_points": _with(_DEMAND, _VEC, _HEAVY.format(k=10)) + " SELECT p.cluster, v.src, round(v.norm, 6) AS centre FROM vec v JOIN parts p ON p.prefix = v.prefix WHERE p.cluster < 10",
    "first_points_drawn": _with(_DEMAND, _VEC, f"order_of AS (SELECT prefix, row_number() OVER (ORDER BY {_draw(61, 'prefix')}, prefix) - 1 AS r FROM norm0)") + " SELECT CAST(o.r AS INTEGER) AS cluster, v.src, round(v.norm, 6) AS centre FROM vec v JOIN order_of o ON o.prefix = v.prefix WHERE o.r < 10",
    "scenario_network": f"WITH r AS (SELECT n_nationkey AS router, row_number() OVER (ORDER BY {_draw(72, 'n_nationkey')}, n_nationkey) - 1 AS place, count(*) OVER () AS n FROM nation) SELECT a.n_nationkey AS src, b.n_nationkey AS dst, 10 + {_draw(71, 'least(a.n_nationkey, b.n_nationkey)', 'greatest(a.n_nationkey, b.n_nationkey)')} % 91 AS weight FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey UNION ALL SELECT router, CAST(t * n + place + 1000 AS INTEGER), NULL FROM r, (SELECT unnest(range(60)) AS t) WHERE t * n + place < 60",
    "limited_egress_inf": _with(*_ALL, _WORST.replace("FROM demand d JOIN flow f ON f.src = d.src GROUP BY 1, 2, 3, 4", "FROM demand d JOIN flow f ON f.src = d.src WHERE f.root % 2 = 0 GROUP BY 1, 2, 3, 4")) + _report(_sum("w_mixed")),
    "class_clustered_inf": _with(_NET, _BASE, _FLOW, _DEMAND.replace("demand AS (", "single_demand AS ("), _STATE.replace("states AS (SELECT", "single_states AS (SELECT").replace("rules AS (SELECT", "single_rules AS (SELECT"), _CLASSES, _CHOSEN, _WORST) + _report(_sum("w_mixed")),
    "kmeans": _kmeans(8, 150),
    "sweep_settings": _sweep(),
}
