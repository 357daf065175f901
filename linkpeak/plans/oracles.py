"""SQL twins of the queries, for DuckDB over the same tables.

Shortest paths come from recursive walks with a bound on cost, the DAG from differences of costs, and flows
from expanding all paths; none of the Spark code is used.
"""

from __future__ import annotations

#: No shortest path of the derived network costs more, with any single link down.
_FAR = 60

_NET = """
routers AS (SELECT n_nationkey AS router_id, n_name AS name, n_regionkey AS region FROM nation),
one_way AS (
  SELECT router_id AS a, (router_id + 1) % (SELECT count(*) FROM routers) AS b, 1 + router_id % 3 AS weight FROM routers
  UNION ALL
  SELECT h.a, r.router_id, 2 + r.router_id % 2 FROM routers r JOIN (SELECT region, min(router_id) AS a FROM routers GROUP BY region) h ON r.region = h.region WHERE r.router_id <> h.a
),
pairs AS (SELECT a AS src, b AS dst, min(weight) AS weight FROM (SELECT a, b, weight FROM one_way UNION ALL SELECT b, a, weight FROM one_way) WHERE a <> b GROUP BY a, b),
links AS (SELECT CAST(row_number() OVER (ORDER BY src, dst) - 1 AS INTEGER) AS edge_id, CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst, CAST(weight AS BIGINT) AS weight FROM pairs),
units AS (SELECT min(edge_id) AS link_id, list_sort(list(edge_id)) AS edges FROM links GROUP BY least(src, dst), greatest(src, dst)),
borders AS (SELECT DISTINCT s_nationkey AS root FROM supplier)"""

_BASE = "scenarios AS (SELECT 0 AS scenario_id, CAST([] AS INTEGER[]) AS failed)"
_L1 = "scenarios AS (SELECT 0 AS scenario_id, CAST([] AS INTEGER[]) AS failed UNION ALL SELECT link_id + 1, edges FROM units)"

_L1D = "scenarios AS (SELECT 0 AS scenario_id, CAST([] AS INTEGER[]) AS failed UNION ALL SELECT edge_id + 1, [edge_id] FROM links)"

_FLOW = f"""
alive AS (SELECT s.scenario_id, l.* FROM scenarios s JOIN links l ON NOT list_contains(s.failed, l.edge_id)),
walk AS (
  SELECT s.scenario_id, b.root, b.root AS src, CAST(0 AS BIGINT) AS cost FROM scenarios s, borders b
  UNION
  SELECT w.scenario_id, w.root, l.src, w.cost + l.weight FROM walk w JOIN alive l ON l.scenario_id = w.scenario_id AND l.dst = w.src WHERE w.cost + l.weight <= {_FAR}
),
costs AS (SELECT scenario_id, root, src, min(cost) AS cost FROM walk GROUP BY scenario_id, root, src),
dag AS (
  SELECT a.scenario_id, a.root, a.src AS node, l.dst AS next_node, l.edge_id
  FROM costs a JOIN alive l ON l.scenario_id = a.scenario_id AND l.src = a.src
  JOIN costs b ON b.scenario_id = a.scenario_id AND b.root = a.root AND b.src = l.dst WHERE a.cost = l.weight + b.cost
),
hops AS (SELECT *, count(*) OVER (PARTITION BY scenario_id, root, node) AS degree FROM dag),
expand AS (
  SELECT scenario_id, root, src, src AS node, CAST(1 AS DOUBLE) AS f, TRUE AS sole, CAST(NULL AS INTEGER) AS edge_id FROM costs
  UNION ALL
  SELECT e.scenario_id, e.root, e.src, h.next_node, e.f / h.degree, e.sole AND h.degree = 1, h.edge_id
  FROM expand e JOIN hops h ON h.scenario_id = e.scenario_id AND h.root = e.root AND h.node = e.node
),
flow AS (SELECT scenario_id, root, src, edge_id, sum(f) AS frac, bool_or(sole) AS sole FROM expand WHERE edge_id IS NOT NULL GROUP BY scenario_id, root, src, edge_id)"""

_DEMAND = """
demand AS (
  SELECT c_nationkey AS src, l_partkey AS prefix, sum(l_quantity) AS demand
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2 HAVING sum(l_quantity) > 0
)"""

_STATE = """
supplied AS (SELECT l_partkey AS prefix, s_nationkey AS egress, sum(l_quantity) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
route_state AS (SELECT prefix, egress FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY q DESC, egress) AS r FROM supplied) WHERE r <= 2),
states AS (SELECT prefix, list_sort(list(egress)) AS egresses FROM route_state GROUP BY prefix),
rules AS (SELECT p_partkey AS prefix, CASE WHEN p_size % 10 = 0 THEN 'ingress' WHEN p_size % 10 = 5 THEN 'both' ELSE 'egress' END AS kind FROM part)"""

_CHOSEN = """
sets AS (SELECT DISTINCT egresses FROM states),
set_roots AS (SELECT egresses, unnest(egresses) AS root FROM sets),
chosen AS (SELECT c.scenario_id, s.egresses, c.src, arg_min(c.root, c.cost * 1000 + c.root) AS root FROM set_roots s JOIN costs c ON c.root = s.root GROUP BY 1, 2, 3),
routed AS (SELECT c.scenario_id, c.egresses, c.src, f.edge_id, f.frac FROM chosen c JOIN flow f ON f.scenario_id = c.scenario_id AND f.root = c.root AND f.src = c.src),
by_state AS (SELECT s.egresses, d.src, sum(d.demand) AS demand FROM demand d JOIN states s ON d.prefix = s.prefix GROUP BY 1, 2),
fixed AS (SELECT r.scenario_id, r.edge_id, sum(b.demand * r.frac) AS load FROM by_state b JOIN routed r ON b.egresses = r.egresses AND b.src = r.src GROUP BY 1, 2),
current_of AS (
  SELECT r.scenario_id, d.prefix, r.edge_id, sum(d.demand * r.frac) AS current
  FROM demand d JOIN states s ON d.prefix = s.prefix JOIN routed r ON r.egresses = s.egresses AND r.src = d.src GROUP BY 1, 2, 3
)"""

_WORST = """
totals AS (SELECT prefix, sum(demand) AS total FROM demand GROUP BY prefix),
w_egress AS (
  SELECT scenario_id, prefix, edge_id, max(load) AS worst FROM (
    SELECT f.scenario_id, d.prefix, f.root, f.edge_id, sum(d.demand * f.frac) AS load FROM demand d JOIN flow f ON f.src = d.src GROUP BY 1, 2, 3, 4
  ) GROUP BY 1, 2, 3
),
most_in AS (SELECT scenario_id, egresses, edge_id, max(frac) AS frac FROM routed GROUP BY 1, 2, 3),
w_ingress AS (SELECT m.scenario_id, t.prefix, m.edge_id, t.total * m.frac AS worst FROM totals t JOIN states s ON t.prefix = s.prefix JOIN most_in m ON m.egresses = s.egresses),
most_both AS (SELECT scenario_id, edge_id, max(frac) AS frac FROM flow GROUP BY 1, 2),
w_both AS (SELECT m.scenario_id, t.prefix, m.edge_id, t.total * m.frac AS worst FROM totals t, most_both m),
w_mixed AS (
  SELECT w.* FROM w_egress w JOIN rules r ON w.prefix = r.prefix WHERE r.kind = 'egress'
  UNION ALL SELECT w.* FROM w_ingress w JOIN rules r ON w.prefix = r.prefix WHERE r.kind = 'ingress'
  UNION ALL SELECT w.* FROM w_both w JOIN rules r ON w.prefix = r.prefix WHERE r.kind = 'both'
)"""

_VEC = """
norm0 AS (SELECT prefix, sum(demand) AS scale FROM demand GROUP BY prefix),
vec AS (
  SELECT p.prefix, s.src, coalesce(d.demand, 0) AS demand, p.scale, coalesce(d.demand, 0) / p.scale AS norm
  FROM norm0 p CROSS JOIN (SELECT DISTINCT src FROM demand) s LEFT JOIN demand d ON d.prefix = p.prefix AND d.src = s.src
)"""

_MEASURED = """
measured AS (
  SELECT n_regionkey AS region, o_orderstatus AS status, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, o_totalprice AS seconds, n_nationkey AS nation
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


def _r4(x: str) -> str:
    return f"round({x} + 1e-7, 4)"


def _listed(x: str) -> str:
    return f"array_to_string({x}, ',')"


def _report(source: str) -> str:
    """source: a relation (scenario_id, edge_id, load)."""
    return f" SELECT l.src, l.dst, {_r4('coalesce(x.load, 0)')} AS load FROM links l LEFT JOIN (SELECT * FROM {source} WHERE scenario_id = 0) x ON x.edge_id = l.edge_id"


def _sum(source: str) -> str:
    return f"(SELECT scenario_id, edge_id, sum(worst) AS load FROM {source} GROUP BY 1, 2)"


def _top(k: int) -> str:
    return f"""
diffs AS (
  SELECT coalesce(w.scenario_id, c.scenario_id) AS scenario_id, coalesce(w.edge_id, c.edge_id) AS edge_id, coalesce(w.prefix, c.prefix) AS prefix,
    round(coalesce(w.worst, 0) - coalesce(c.current, 0), 9) AS diff
  FROM w_mixed w FULL JOIN current_of c ON w.scenario_id = c.scenario_id AND w.edge_id = c.edge_id AND w.prefix = c.prefix
),
extra AS (SELECT scenario_id, edge_id, sum(diff) AS extra FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id, edge_id ORDER BY diff DESC, prefix) AS r FROM diffs) WHERE r <= {k} GROUP BY 1, 2),
changed AS (
  SELECT coalesce(f.scenario_id, x.scenario_id) AS scenario_id, coalesce(f.edge_id, x.edge_id) AS edge_id, coalesce(f.load, 0) + coalesce(x.extra, 0) AS load
  FROM fixed f FULL JOIN extra x ON f.scenario_id = x.scenario_id AND f.edge_id = x.edge_id
)"""


_ALL = (_NET, _BASE, _FLOW, _DEMAND, _STATE, _CHOSEN)
_ALL1 = (_NET, _L1, _FLOW, _DEMAND, _STATE, _CHOSEN)
_HEAVY = """
ranked AS (SELECT prefix, scale, row_number() OVER (ORDER BY scale DESC, prefix) - 1 AS r FROM norm0),
parts AS (SELECT prefix, CAST(least(r, {k}) AS INTEGER) AS cluster FROM ranked)"""
_CENTRES = """
centres AS (SELECT p.cluster, v.src, sum(v.demand) / sum(v.scale) AS centre FROM vec v JOIN parts p ON v.prefix = p.prefix GROUP BY 1, 2),
errors AS (
  SELECT p.cluster, sum(greatest(v.norm - c.centre, 0) * v.scale) AS error_pos, sum(greatest(c.centre - v.norm, 0) * v.scale) AS error_neg
  FROM vec v JOIN parts p ON v.prefix = p.prefix JOIN centres c ON c.cluster = p.cluster AND c.src = v.src GROUP BY 1
)"""
_TE = """
ring AS (SELECT src, edge_id FROM links WHERE dst = (src + 1) % 25),
te AS (
  SELECT s.prefix, 0 AS ingress, s.egress, (SELECT list(edge_id ORDER BY src) FROM ring WHERE ring.src < s.egress) AS edges
  FROM route_state s JOIN part ON p_partkey = s.prefix WHERE p_size % 10 = 7 AND s.egress > 0
),
cells AS (SELECT c.scenario_id, d.prefix, d.src, c.root, d.demand FROM demand d JOIN states s ON d.prefix = s.prefix JOIN chosen c ON c.egresses = s.egresses AND c.src = d.src),
te_load AS (
  SELECT scenario_id, edge_id, sum(load) AS load FROM (
    SELECT c.scenario_id, unnest(t.edges) AS edge_id, c.demand AS load FROM cells c JOIN te t ON t.prefix = c.prefix AND t.ingress = c.src AND t.egress = c.root
    UNION ALL
    SELECT c.scenario_id, f.edge_id, c.demand * f.frac FROM cells c JOIN flow f ON f.scenario_id = c.scenario_id AND f.root = c.root AND f.src = c.src
    WHERE NOT EXISTS (SELECT 1 FROM te t WHERE t.prefix = c.prefix AND t.ingress = c.src AND t.egress = c.root)
  ) GROUP BY 1, 2
)"""


def _centre(value: str) -> str:
    return _with(_DEMAND, _VEC) + f" SELECT 0 AS cluster, src, round({value}, 6) AS centre FROM vec GROUP BY src"


def _quantile(q: float) -> str:
    return f"quantile_cont(seconds, {q})"


def percent(load: str, total: float) -> str:
    """A share as text of 8 characters."""
    return f"CASE WHEN abs({load} * 100 / {total}) <= 1e-9 THEN '  0%    ' ELSE format('{{:7.3f}}%', round({load} * 100 / {total} + 1e-9, 3)) END"


def _scores() -> str:
    modes = {"direct": ("avg(v.demand)", "v.demand", "1.0"), "normalized": ("avg(v.norm)", "v.norm", "v.scale"), "scaled": ("sum(v.demand) / sum(v.scale)", "v.norm", "v.scale")}
    methods = {("single", 1): "0", ("heaviest", 10): "least(r, 10)", ("heaviest", 50): "least(r, 50)"}
    rows = []
    for (method, k), cluster in methods.items():
        for mode, (centre, x, weight) in modes.items():
            parts = f"(SELECT prefix, {cluster} AS cluster FROM (SELECT prefix, row_number() OVER (ORDER BY scale DESC, prefix) - 1 AS r FROM norm0))"
            middle = f"(SELECT p.cluster, v.src, {centre} AS centre FROM vec v JOIN {parts} p ON v.prefix = p.prefix GROUP BY 1, 2)"
            rows.append(f"SELECT '{method}' AS method, {k} AS k, '{mode}' AS mode, round(sum(greatest({x} - c.centre, 0) * {weight}) / (SELECT sum(scale) FROM norm0), 6) AS error FROM vec v JOIN {parts} p ON v.prefix = p.prefix JOIN {middle} c ON c.cluster = p.cluster AND c.src = v.src")
    return _with(_DEMAND, _VEC) + " " + " UNION ALL ".join(rows)


SQL: dict[str, str] = {
    "current_link_load": _with(*_ALL) + _report("fixed"),
    "unit_flow_costs": _with(_NET, _BASE, _FLOW) + " SELECT root, src, cost FROM costs",
    "unit_flow": _with(_NET, _BASE, _FLOW) + f" SELECT root, src, edge_id, {_r4('frac')} AS frac, sole FROM flow",
    "ecmp_dag": _with(_NET, _BASE, _FLOW) + " SELECT root, node, next_node FROM dag",
    "merged_dag": _with(*_ALL, "near AS (SELECT s.egresses, c.root, c.src AS node, rank() OVER (PARTITION BY s.egresses, c.src ORDER BY c.cost) AS r FROM set_roots s JOIN costs c ON c.root = s.root)")
    + f" SELECT {_listed('n.egresses')} AS egresses, n.node, {_listed('list_sort(list(DISTINCT d.next_node))')} AS next_nodes FROM near n JOIN dag d ON d.root = n.root AND d.node = n.node WHERE n.r = 1 GROUP BY n.egresses, n.node",
    "chosen_egress": _with(*_ALL) + f" SELECT {_listed('egresses')} AS egresses, src, root FROM chosen",
    "worst_egress_inf": _with(*_ALL, _WORST) + _report(_sum("w_egress")),
    "worst_ingress_inf": _with(*_ALL, _WORST) + _report(_sum("w_ingress")),
    "worst_both_inf": _with(*_ALL, _WORST) + _report(_sum("w_both")),
    "worst_mixed_inf": _with(*_ALL, _WORST) + _report(_sum("w_mixed")),
    "worst_k1": _with(*_ALL, _WORST, _top(1)) + _report("changed"),
    "worst_k10": _with(*_ALL, _WORST, _top(10)) + _report("changed"),
    "worst_egress_witness": _with(*_ALL, _WORST, "w_root AS (SELECT d.prefix, f.root, f.edge_id, round(sum(d.demand * f.frac), 9) AS load FROM demand d JOIN flow f ON f.src = d.src GROUP BY 1, 2, 3)")
    + f" SELECT prefix, edge_id, {_r4('load')} AS worst, root AS egress FROM (SELECT *, row_number() OVER (PARTITION BY prefix, edge_id ORDER BY load DESC, root) AS r FROM w_root) WHERE r = 1",
    "failures_l1_fixed": _with(*_ALL1) + f" SELECT l.src, l.dst, {_r4('coalesce(max(f.load), 0)')} AS load FROM links l LEFT JOIN fixed f ON f.edge_id = l.edge_id GROUP BY l.src, l.dst",
    "failures_l1_witness": _with(*_ALL1) + f" SELECT {_listed('s.failed')} AS failed, f.edge_id, {_r4('f.load')} AS load FROM fixed f JOIN scenarios s ON s.scenario_id = f.scenario_id",
    "failures_l1_k1": _with(*_ALL1, _WORST, _top(1)) + f" SELECT l.src, l.dst, {_r4('greatest(coalesce(max(f.load), 0), 0)')} AS load FROM links l LEFT JOIN changed f ON f.edge_id = l.edge_id GROUP BY l.src, l.dst",
    "failures_directed_k1": _with(_NET, _L1D, _FLOW, _DEMAND, _STATE, _CHOSEN, _WORST, _top(1)) + f" SELECT l.src, l.dst, {_r4('greatest(coalesce(max(f.load), 0), 0)')} AS load FROM links l LEFT JOIN changed f ON f.edge_id = l.edge_id GROUP BY l.src, l.dst",
    "link_combinations": _with(_NET) + f" SELECT '' AS failed UNION ALL SELECT {_listed('edges')} FROM units UNION ALL SELECT {_listed('list_concat(a.edges, b.edges)')} FROM units a JOIN units b ON a.link_id < b.link_id",
    "undirected_links": _with(_NET) + f" SELECT link_id, {_listed('edges')} AS edges FROM units",
    "lp_compatible_subsets": """WITH RECURSIVE lp AS (SELECT s_nationkey AS egress, list_sort(list(DISTINCT 100 + 50 * (s_suppkey % 3))) AS prefs FROM supplier GROUP BY 1),
grow AS (
  SELECT [egress] AS egresses, egress AS last, prefs FROM lp
  UNION ALL
  SELECT list_append(g.egresses, l.egress), l.egress, list_intersect(g.prefs, l.prefs) FROM grow g JOIN lp l ON l.egress > g.last WHERE len(g.egresses) < 4 AND len(list_intersect(g.prefs, l.prefs)) > 0
) SELECT '' AS egresses UNION ALL SELECT array_to_string(egresses, ',') FROM grow""",
    "te_path_override": _with(*_ALL, _TE) + _report("te_load"),
    "path_to_edges": _with(
        _NET,
        """visits AS (SELECT l_orderkey AS path_id, s_nationkey AS router, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, s_nationkey) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
steps AS (SELECT a.path_id, a.pos, l.edge_id FROM visits a JOIN visits b ON a.path_id = b.path_id AND b.pos = a.pos + 1 LEFT JOIN links l ON l.src = a.router AND l.dst = b.router WHERE a.n >= 2)""",
    )
    + f" SELECT path_id, {_listed('list(edge_id ORDER BY pos)')} AS edges FROM steps GROUP BY path_id HAVING count(*) = count(edge_id)",
    "rule_precedence": """WITH named AS (SELECT p_partkey AS prefix, max(r) AS rule_id FROM part, (SELECT unnest([2, 3, 4, 5, 6, 7]) AS r) WHERE p_partkey % r = 0 GROUP BY 1)
SELECT p_partkey AS prefix, rule_id, CASE rule_id WHEN 2 THEN 'ingress' WHEN 3 THEN 'both' WHEN 4 THEN 'egress' WHEN 5 THEN 'ingress' WHEN 6 THEN 'both' ELSE 'egress' END AS kind
FROM part LEFT JOIN named ON p_partkey = prefix""",
    "prefix_classes": _with(_DEMAND, _STATE) + f" SELECT r.kind, {_listed('s.egresses')} AS egresses, count(DISTINCT d.prefix) AS members, {_r4('sum(d.demand)')} AS total FROM demand d JOIN states s ON d.prefix = s.prefix JOIN rules r ON r.prefix = d.prefix GROUP BY r.kind, s.egresses",
    "heaviest_truncation": _with(_DEMAND, "t AS (SELECT prefix, sum(demand) AS d, row_number() OVER (ORDER BY sum(demand) DESC, prefix) AS r FROM demand GROUP BY prefix)")
    + f" SELECT count(*) FILTER (r <= 100) AS kept, {_r4('sum(d) FILTER (r <= 100)')} AS demand, {_r4('coalesce(sum(d) FILTER (r > 100), 0)')} AS dropped FROM t",
    "tm_stats_source": _with(_DEMAND) + f" SELECT src, {_r4('sum(demand)')} AS demand FROM demand GROUP BY src",
    "tm_stats_prefix": _with(_DEMAND) + f" SELECT prefix, {_r4('sum(demand)')} AS demand FROM demand GROUP BY prefix",
    "tm_topk_share": _with(_DEMAND, "t AS (SELECT sum(demand) AS d, row_number() OVER (ORDER BY sum(demand) DESC, prefix) AS r FROM demand GROUP BY prefix)")
    + f" SELECT top, {_r4('sum(d)')} AS demand, round(sum(d) / (SELECT sum(d) FROM t), 6) AS share FROM t JOIN (SELECT unnest([1, 10, 100, 1000, 2000, 5000, 10000, 15000]) AS top) ON r <= top GROUP BY top",
    "top_k_prefixes": _with(_DEMAND) + f" SELECT prefix, {_r4('sum(demand)')} AS demand FROM demand GROUP BY prefix ORDER BY sum(demand) DESC, prefix LIMIT 20",
    "normalized_demand": _with(_DEMAND) + f" SELECT src, prefix, round(demand / sum(demand) OVER (PARTITION BY prefix), 6) AS norm, {_r4('sum(demand) OVER (PARTITION BY prefix)')} AS scale FROM demand",
    "single_cluster_center_direct": _centre("avg(demand)"),
    "single_cluster_center_norm": _centre("avg(norm)"),
    "single_cluster_center_scaled": _centre("sum(demand) / sum(scale)"),
    "heaviest_k_error": _with(_DEMAND, _VEC, _HEAVY.format(k=10), _CENTRES) + f" SELECT cluster, {_r4('error_pos')} AS error_pos, {_r4('error_neg')} AS error_neg FROM errors",
    "effective_demand": _with(_DEMAND, _VEC, _HEAVY.format(k=10), _CENTRES) + f" SELECT c.cluster, c.src, {_r4('c.centre * s.s')} AS demand FROM centres c JOIN (SELECT cluster, sum(scale) AS s FROM parts JOIN norm0 USING (prefix) GROUP BY 1) s ON s.cluster = c.cluster",
    "kmeans_one_step": _with(_DEMAND, _VEC, _HEAVY.format(k=10), "points AS (SELECT p.cluster, v.src, v.norm AS centre FROM vec v JOIN parts p ON v.prefix = p.prefix WHERE p.cluster < 10)")
    + " SELECT prefix, CAST(min([round(d, 6), cluster])[2] AS INTEGER) AS cluster FROM (SELECT v.prefix, p.cluster, sum(abs(v.norm - p.centre) * v.scale) AS d FROM vec v JOIN points p ON v.src = p.src GROUP BY 1, 2) GROUP BY prefix",
    "approx_matrix_error": _with(_DEMAND, _VEC, _HEAVY.format(k=50), _CENTRES) + " SELECT round(sum(error_pos) / (SELECT sum(scale) FROM norm0), 6) AS error FROM errors",
    "clustering_scores": _scores(),
    "equivalent_top_k": _with(_DEMAND, "t AS (SELECT prefix, sum(demand) AS d FROM demand GROUP BY prefix)", "run AS (SELECT row_number() OVER w AS r, sum(d) OVER (w ROWS UNBOUNDED PRECEDING) AS c FROM t WINDOW w AS (ORDER BY d DESC, prefix))")
    + " SELECT CAST(coalesce((SELECT min(r) FROM run WHERE c > (SELECT sum(d) - round(sum(d) * 0.3) FROM t)), (SELECT count(*) FROM t)) AS BIGINT) AS k",
    "report_difference": _with(*_ALL, _WORST, f"a AS ({_report('fixed')}), b AS ({_report(_sum('w_egress'))}), d AS (SELECT abs(a.load - b.load) / 1000.0 AS d FROM a JOIN b ON a.src = b.src AND a.dst = b.dst)")
    + " SELECT round(min(d), 5) AS d_min, round(list_sort(list(d))[count(*) // 2 + 1], 5) AS d_median, round(max(d), 5) AS d_max, round(sum(d), 5) AS d_sum, round(avg(d), 5) AS d_mean FROM d",
    "link_overload": _with(*_ALL, f"a AS ({_report('fixed')})") + " SELECT l.src, l.dst, CAST(l.weight * 20000 AS DOUBLE) AS capacity, a.load FROM links l JOIN a ON a.src = l.src AND a.dst = l.dst WHERE a.load >= l.weight * 20000",
    "lognormal_sigma": _with(
        _DEMAND,
        "rel AS (SELECT src, prefix, demand / (SELECT sum(demand) FROM demand) AS rel FROM demand), ss AS (SELECT src, sum(rel) AS s FROM rel GROUP BY 1), ps AS (SELECT prefix, sum(rel) AS p FROM rel GROUP BY 1), ff AS (SELECT greatest(coalesce(r.rel, 0), 1e-9) / (s * p) AS f FROM ss CROSS JOIN ps LEFT JOIN rel r ON r.src = ss.src AND r.prefix = ps.prefix)",
    )
    + " SELECT round((SELECT stddev_pop(ln(p)) FROM ps), 6) AS attraction, round((SELECT stddev_pop(ln(s)) FROM ss), 6) AS repulsion, round((SELECT stddev_pop(ln(f)) FROM ff), 6) AS friction",
    "gravity_expected": _with(_DEMAND) + f" SELECT src, prefix, {_r4('s * p / (SELECT sum(demand) FROM demand)')} AS demand FROM (SELECT src, sum(demand) AS s FROM demand GROUP BY 1), (SELECT prefix, sum(demand) AS p FROM demand GROUP BY 1)",
    "attraction_renorm": _with(_DEMAND) + f" SELECT src, d.prefix, {_r4('demand * p_size / (SELECT sum(p_size) FROM part) * (SELECT sum(demand) FROM demand) / s')} AS demand FROM demand d JOIN part ON p_partkey = prefix JOIN (SELECT prefix, sum(demand) AS s FROM demand GROUP BY 1) t ON t.prefix = d.prefix",
    "variability_check": _with(*_ALL) + " SELECT count(*) AS n FROM fixed WHERE load > 0 AND edge_id NOT IN (SELECT edge_id FROM flow WHERE sole)",
    "variability_added": _with(*_ALL, f"a AS ({_report('fixed')})") + " SELECT src, dst, CASE WHEN load > 0 THEN load + 100 ELSE load END AS load FROM a",
    "runtime_quantiles": _with(_MEASURED) + f" SELECT region, priority, {_r4(_quantile(0.1))} AS seconds_q10, {_r4(_quantile(0.5))} AS seconds_q50, {_r4(_quantile(0.9))} AS seconds_q90 FROM measured WHERE status = 'F' GROUP BY 1, 2",
    "accuracy_quantiles": _with(_MEASURED) + f" SELECT region, status, {_r4('min(seconds)')} AS min, {_r4(_quantile(0.25))} AS q25, {_r4(_quantile(0.5))} AS q50, {_r4(_quantile(0.75))} AS q75, {_r4('max(seconds)')} AS max, {_r4('avg(seconds)')} AS mean FROM measured GROUP BY 1, 2",
    "aspect_factors": _with(_MEASURED, f"m AS (SELECT region, status, {_quantile(0.5)} AS median FROM measured GROUP BY 1, 2)") + f" SELECT region, status, {_r4('median')} AS median, round(median / (SELECT median FROM m WHERE region = 0 AND status = 'F'), 6) AS ratio FROM m",
    "kl_ecdf": _with(_MEASURED, "m AS (SELECT nation, status, max(seconds) AS most FROM measured GROUP BY 1, 2)", "f AS (SELECT a.status, a.nation, a.most / b.most AS fraction FROM m a JOIN m b ON a.nation = b.nation AND a.status <> 'F' AND b.status = 'F')")
    + " SELECT status, round(fraction, 9) AS fraction, round(row_number() OVER (PARTITION BY status ORDER BY fraction, nation) / count(*) OVER (PARTITION BY status), 9) AS ecdf FROM f",
    "link_report_text": _with(*_ALL, f"a AS ({_report('fixed')})")
    + f" SELECT lpad(x.name, 20, ' ') || ' -> ' || rpad(y.name, 20, ' ') || ': ' || {percent('load', 1000000.0)} AS line FROM a JOIN routers x ON a.src = x.router_id JOIN routers y ON a.dst = y.router_id",
    "topk_per_link": _with(*_ALL, "t AS (SELECT edge_id, prefix, round(current, 6) AS current FROM current_of)", "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY edge_id ORDER BY current DESC, prefix) AS INTEGER) AS rank FROM t)") + f" SELECT edge_id, rank, prefix, {_r4('current')} AS current FROM r WHERE rank <= 3",
}
