"""SQL twins, for DuckDB, of the queries in experiments.py."""

from __future__ import annotations

from linkpeak.plans.oracles import _ALL, _ALL1, _BASE, _CHOSEN, _DEMAND, _FLOW, _NET, _STATE, _TE, _WORST, _r4, _report, _sum, _top, _with
from linkpeak.plans.sample_oracles import _CAUSES, _NAMED, _TE_WORST, _normal

_LISTED = "array_to_string({}, ',')"
_RAW = _DEMAND.replace("demand AS (", "raw AS (", 1)


def _grouped(more: str) -> str:
    """Clusters of prefixes that share their state, their rule and ``more``, named by their smallest prefix."""
    return f"""
setting AS (SELECT s.prefix, s.egresses, r.kind, {more} AS more FROM states s JOIN rules r ON r.prefix = s.prefix JOIN part ON p_partkey = s.prefix WHERE s.prefix IN (SELECT prefix FROM raw)),
member AS (
  SELECT prefix, min(prefix) OVER w AS rep, scale / sum(scale) OVER w AS share FROM setting JOIN (SELECT prefix, sum(demand) AS scale FROM raw GROUP BY 1) USING (prefix)
  WINDOW w AS (PARTITION BY egresses, kind, more)
),
demand AS (SELECT d.src, m.rep AS prefix, sum(d.demand) AS demand FROM raw d JOIN member m ON m.prefix = d.prefix GROUP BY 1, 2)"""


_CLUSTERED = (_NET, _BASE, _FLOW, _RAW, _STATE, _grouped("s.prefix % 3"), _CHOSEN, _WORST)
#: Changes of members: of each cluster their shares.
_MEMBERS = """
of_members AS (SELECT d.edge_id, m.prefix, m.rep, d.diff * m.share AS diff, m.share FROM diffs d JOIN member m ON m.rep = d.prefix),
ranked_members AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY round(diff, 9) DESC, prefix) AS r FROM of_members)"""


def _limited(egress: str, ingress: str, both: str) -> str:
    """_WORST with conditions on f.root of egresses, on src of ingresses, and on both."""
    out = _WORST.replace("FROM demand d JOIN flow f ON f.src = d.src GROUP BY 1, 2, 3, 4", f"FROM demand d JOIN flow f ON f.src = d.src WHERE {egress} GROUP BY 1, 2, 3, 4")
    out = out.replace("max(frac) AS frac FROM routed GROUP BY 1, 2, 3", f"max(frac) AS frac FROM routed WHERE {ingress} GROUP BY 1, 2, 3")
    return out.replace("max(frac) AS frac FROM flow GROUP BY 1, 2", f"max(frac) AS frac FROM flow WHERE {both} GROUP BY 1, 2")


def _kinds(of_rows: str) -> str:
    """_STATE with other rules."""
    head, _ = _STATE.split("rules AS (")
    return head + f"rules AS (SELECT p_partkey AS prefix, {of_rows} AS kind FROM part)"


#: A prefix that never loads a link changes it by nothing, which is more than a change that lowers its load.
_WITH_NONE = """
seen AS (SELECT scenario_id, edge_id, count(*) AS n, max(diff) AS most FROM diffs GROUP BY 1, 2),
with_none AS (
  SELECT s.scenario_id, s.edge_id, coalesce(f.load, 0) + CASE WHEN s.n < (SELECT count(DISTINCT prefix) FROM demand) THEN greatest(s.most, 0) ELSE s.most END AS load
  FROM seen s LEFT JOIN fixed f ON f.scenario_id = s.scenario_id AND f.edge_id = s.edge_id
)"""

_HIGHEST = "best AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY round(load, 9) DESC, scenario_id) AS r FROM changed WHERE load > 0)"

#: Loads of all prefixes for each set of egresses: those of the two paths, with or without another one.
_INSTALLED = """
ring AS (SELECT src, edge_id FROM links WHERE dst = src + 1),
te AS (
  SELECT 0 AS ingress, 3 AS egress, (SELECT list(edge_id) FROM ring WHERE src BETWEEN 0 AND 2) AS edges
  UNION ALL SELECT 5, 8, (SELECT list(edge_id) FROM ring WHERE src BETWEEN 5 AND 7)
),
tied AS (SELECT [x for x in [3, 8] if x IN (SELECT root FROM borders)] AS t),
te_sets AS MATERIALIZED (
  SELECT row_number() OVER () AS set_id, list_filter(list_concat(own, [other]), lambda x: x IS NOT NULL) AS members FROM
    (SELECT unnest([[], [3], [8], [3, 8]]) AS own), (SELECT root AS other FROM borders WHERE root NOT IN (3, 8) UNION ALL SELECT NULL)
  WHERE len(own) > 0 OR other IS NOT NULL
),
known_sets AS (SELECT * FROM te_sets WHERE list_has_all((SELECT list(root) FROM borders), members)),
set_chosen AS (SELECT m.set_id, c.src, arg_min(c.root, c.cost * 1000 + c.root) AS root FROM (SELECT set_id, unnest(members) AS root FROM known_sets) m JOIN costs c ON c.root = m.root GROUP BY 1, 2),
tied_flow AS (
  SELECT f.root, f.src, f.edge_id, f.frac FROM flow f WHERE NOT EXISTS (SELECT 1 FROM te t WHERE t.ingress = f.src AND t.egress = f.root)
  UNION ALL SELECT egress, ingress, unnest(edges), 1.0 FROM te WHERE egress IN (SELECT root FROM borders)
),
set_flow AS MATERIALIZED (SELECT c.set_id, f.src, f.edge_id, f.frac FROM set_chosen c JOIN tied_flow f ON f.root = c.root AND f.src = c.src),
set_load AS (SELECT f.set_id, d.prefix, f.edge_id, sum(d.demand * f.frac) AS load FROM set_flow f JOIN demand d ON d.src = f.src JOIN rules r ON r.prefix = d.prefix AND r.kind = 'egress' GROUP BY 1, 2, 3),
now_flow AS (SELECT c.egresses, f.src, f.edge_id, f.frac FROM chosen c JOIN tied_flow f ON f.root = c.root AND f.src = c.src),
te_now AS (SELECT d.prefix, f.edge_id, sum(d.demand * f.frac) AS current FROM demand d JOIN states s ON s.prefix = d.prefix JOIN now_flow f ON f.egresses = s.egresses AND f.src = d.src GROUP BY 1, 2),
totals AS (SELECT prefix, sum(demand) AS total FROM demand GROUP BY prefix),
worst_of AS (
  SELECT prefix, edge_id, max(load) AS worst FROM set_load GROUP BY 1, 2
  UNION ALL
  SELECT t.prefix, m.edge_id, t.total * m.frac FROM totals t JOIN states s ON s.prefix = t.prefix JOIN rules r ON r.prefix = t.prefix AND r.kind = 'ingress'
    JOIN (SELECT egresses, edge_id, max(frac) AS frac FROM now_flow GROUP BY 1, 2) m ON m.egresses = s.egresses
  UNION ALL
  SELECT t.prefix, m.edge_id, t.total * m.frac FROM totals t JOIN rules r ON r.prefix = t.prefix AND r.kind = 'both', (SELECT edge_id, max(frac) AS frac FROM tied_flow GROUP BY 1) m
),
te_diffs AS (
  SELECT coalesce(w.edge_id, n.edge_id) AS edge_id, coalesce(n.current, 0) AS current, round(coalesce(w.worst, 0) - coalesce(n.current, 0), 9) AS diff
  FROM worst_of w FULL JOIN te_now n ON n.prefix = w.prefix AND n.edge_id = w.edge_id
)"""

_TE_DIFFS = "FROM links l LEFT JOIN te_diffs d ON d.edge_id = l.edge_id GROUP BY l.src, l.dst"
#: What causes the worst loads of prefixes with explicit paths: of equal loads the smaller set.
_TE_CAUSES = """
te_named AS (
  SELECT prefix, edge_id, load AS worst, list_sort([x for x in [a, b, c] if x IS NOT NULL]) AS egresses, CAST(NULL AS INTEGER) AS ingress FROM (
    SELECT l.*, s.a, s.b, s.c, row_number() OVER (PARTITION BY l.prefix, l.edge_id ORDER BY round(l.load, 9) DESC, len([x for x in [s.a, s.b, s.c] if x IS NOT NULL]), list_sort([x for x in [s.a, s.b, s.c] if x IS NOT NULL])) AS r
    FROM set_load l JOIN te_sets s ON s.set_id = l.set_id
  ) WHERE r = 1
),
all_named AS (
  SELECT * FROM te_named
  UNION ALL SELECT prefix, edge_id, worst, CASE WHEN egress IS NULL THEN NULL ELSE [egress] END, ingress FROM w_named WHERE prefix NOT IN (SELECT prefix FROM te_of)
),
changes AS (
  SELECT coalesce(w.edge_id, c.edge_id) AS edge_id, coalesce(w.prefix, c.prefix) AS prefix, coalesce(w.worst, 0) AS worst, coalesce(c.current, 0) AS current, w.egresses, w.ingress
  FROM all_named w FULL JOIN te_now c ON c.prefix = w.prefix AND c.edge_id = w.edge_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY round(worst - current, 9) DESC, prefix) AS r FROM changes),
sums AS (SELECT edge_id, sum(current) + max(round(worst - current, 9)) AS load FROM changes GROUP BY 1)"""

_ROUTERS = "scenarios AS (SELECT CAST(router_id AS BIGINT) AS scenario_id, (SELECT list(edge_id) FROM links WHERE src = router_id OR dst = router_id) AS failed FROM routers)"

_WIDTHS = f"""WITH settings AS (SELECT CAST(i AS INTEGER) AS setting, i % 3 * 0.5 + 0.5 AS a, i // 3 % 3 * 0.5 + 0.5 AS r, i // 9 % 3 * 0.5 + 0.5 AS f FROM range(27) t(i)),
z_src AS (SELECT n_nationkey AS src, {_normal(0.0, 1.0, 81, "n_nationkey")} AS zr FROM nation),
z_prefix AS (SELECT p_partkey AS prefix, {_normal(0.0, 1.0, 82, "p_partkey")} AS za FROM part),
z AS (SELECT src, prefix, zr, za, {_normal(0.0, 1.0, 83, "src", "prefix")} AS zf FROM z_src, z_prefix),
raw AS (SELECT setting, src, prefix, exp(r * zr) * exp(a * za) / exp(f * zf) AS d FROM z, settings),
rel AS (SELECT setting, src, prefix, d / sum(d) OVER (PARTITION BY setting) AS rel, sum(d) OVER (PARTITION BY setting, src) / sum(d) OVER (PARTITION BY setting) AS s, sum(d) OVER (PARTITION BY setting, prefix) / sum(d) OVER (PARTITION BY setting) AS p FROM raw)
SELECT setting, round((SELECT stddev_pop(ln(p)) FROM (SELECT DISTINCT prefix, p FROM rel x WHERE x.setting = y.setting)), 6) AS attraction,
  round((SELECT stddev_pop(ln(s)) FROM (SELECT DISTINCT src, s FROM rel x WHERE x.setting = y.setting)), 6) AS repulsion, round(stddev_pop(ln(greatest(rel, 1e-9) / (s * p))), 6) AS friction FROM rel y GROUP BY setting"""



def _accuracy() -> str:
    five = {"min": "min({})", "q25": "quantile_cont({}, 0.25)", "q50": "quantile_cont({}, 0.5)", "q75": "quantile_cont({}, 0.75)", "max": "max({})"}
    names = {"e": "price * 0.5", "d": "price * price", "s": "price * 100 + 1"}
    numbers = ", ".join(f"{f.format(x)} AS {c}_{name}" for c, x in names.items() for name, f in five.items())
    shown = lambda c, form, digits: [f"printf('{form}', round({c}_{name} + 1e-12, {digits}))" for name in five]
    box = lambda command, c, form, digits: f"'\\{command}{{' || array_to_string([{', '.join(shown(c, form, digits))}], '}}{{') || '}}'"
    plain = lambda c, form, digits: f"'[' || array_to_string([{', '.join(shown(c, form, digits))}], ', ') || ']'"
    field = lambda i, c: f"CASE WHEN region % 3 = {i} THEN printf('\\textbf{{%4.2f (%3.1f)}}', round({c} + 1e-12, 2), round({c} + 1e-12, 1)) ELSE printf('  \\WEAK{{%4.2f (%3.1f)}}', round({c} + 1e-12, 2), round({c} + 1e-12, 1)) END"
    fields = " || ' & ' || ".join(field(i, c) for i, c in enumerate(("rep", "att", "fri")))
    plots = " || ' & ' || ".join((box("EpsilonBoxPlot", "e", "%.8f", 8), box("DeltaBoxPlot", "d", "%.8f", 8), box("EfficiencyBoxPlot", "s", "%09.6f", 6)))
    text = " || ' | ' || ".join(("printf('%4.2f, %4.2f, %4.2f', round(rep + 1e-12, 2), round(att + 1e-12, 2), round(fri + 1e-12, 2))", plain("e", "%.5f", 5), plain("d", "%.5f", 5), plain("s", "%07.4f", 4)))
    return f"""WITH m AS (SELECT n_regionkey AS region, o_orderstatus AS status, n_nationkey / 10.0 AS nation, o_totalprice / 1e6 AS price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
f AS (SELECT region, status, {numbers}, avg(region + 1) AS rep, avg(nation) AS att, avg(price + 1) AS fri, quantile_cont(price * price / (price * 0.5), 0.5) AS fraction FROM m GROUP BY 1, 2)
SELECT region, status, {text} AS text, '  yes & ' || {fields} || ' & ' || {plots} || ' \\\\' AS latex, round(fraction, 6) AS fraction FROM f"""


def _settings() -> str:
    last = "(SELECT edge_id, max({}) AS load FROM {} GROUP BY 1)"
    parts = {
        ("1", 0): _with(*_ALL, _WORST, _top(1)) + f" SELECT load FROM {last.format('load', 'changed')}",
        ("10", 0): _with(*_ALL, _WORST, _top(10)) + f" SELECT load FROM {last.format('load', 'changed')}",
        ("inf", 0): _with(*_ALL, _WORST) + f" SELECT load FROM {_sum('w_mixed')}",
        ("1", 1): _with(*_ALL1, _WORST, _top(1)) + f" SELECT load FROM {last.format('load', 'changed')}",
    }
    return " UNION ALL ".join(f"SELECT '{k}' AS k, {l} AS l, round(max(load) + 1e-7, 3) AS highest, round(sum(load) + 1e-7, 2) AS sum FROM ({x})" for (k, l), x in parts.items())


SQL: dict[str, str] = {
    "running_time_sweep": _settings(),
    "accuracy_lines": _accuracy(),
    "fitted_widths": _WIDTHS,
    "outside_sources": _with(_NET, _DEMAND, "inside AS (SELECT router_id FROM routers WHERE region <= 1), known AS (SELECT src AS r FROM links WHERE src IN (FROM inside) AND dst IN (FROM inside) UNION SELECT dst FROM links WHERE src IN (FROM inside) AND dst IN (FROM inside) UNION SELECT root FROM borders WHERE root IN (FROM inside))")
    + f" SELECT src, {_r4('sum(demand)')} AS demand FROM demand WHERE src NOT IN (FROM known) GROUP BY src",
    "clustered_k10": _with(*_CLUSTERED, _top(1), _MEMBERS) + f" SELECT l.src, l.dst, {_r4('coalesce(f.load, 0) + coalesce(x.extra, 0)')} AS load FROM links l LEFT JOIN fixed f ON f.edge_id = l.edge_id LEFT JOIN (SELECT edge_id, sum(diff) AS extra FROM ranked_members WHERE r <= 10 GROUP BY 1) x ON x.edge_id = l.edge_id",
    "clustered_causes_k1": _with(*_CLUSTERED, _top(1), _CAUSES, _NAMED, _MEMBERS)
    + f""" SELECT l.src, l.dst, m.prefix, {_r4("coalesce(c.current, 0) * m.share")} AS current, {_r4("coalesce(w.worst, 0) * m.share")} AS worst, w.egress, w.ingress
FROM links l JOIN ranked_members m ON m.edge_id = l.edge_id AND m.r = 1 LEFT JOIN fixed f ON f.edge_id = l.edge_id
LEFT JOIN w_named w ON w.edge_id = m.edge_id AND w.prefix = m.rep LEFT JOIN current_of c ON c.edge_id = m.edge_id AND c.prefix = m.rep WHERE coalesce(f.load, 0) + m.diff > 0""",
    "limited_ingress_inf": _with(_NET, _BASE, _FLOW, _DEMAND, _kinds("CASE WHEN p_size % 10 = 5 THEN 'egress' ELSE 'ingress' END"), _CHOSEN, _limited("f.root % 3 = 0", "src % 2 = 0", "true")) + _report(_sum("w_mixed")),
    "limited_both_k1": _with(_NET, _BASE, _FLOW, _DEMAND, _kinds("CASE WHEN p_size % 10 = 0 THEN 'ingress' ELSE 'both' END"), _CHOSEN, _limited("true", "src < 10", "root % 2 = 0 AND src % 2 = 1"), _top(1), _WITH_NONE) + _report("with_none"),
    "te_installed_at": _with(
        *_ALL,
        """classes AS (SELECT s.egresses, row_number() OVER (ORDER BY sum(d.demand) DESC, s.egresses) AS at_class FROM demand d JOIN states s ON s.prefix = d.prefix JOIN rules r ON r.prefix = d.prefix AND r.kind = 'egress' GROUP BY 1),
tied AS (SELECT s.prefix FROM states s JOIN rules r ON r.prefix = s.prefix AND r.kind = 'egress' JOIN classes c ON c.egresses = s.egresses WHERE c.at_class <= 3),
cells AS (SELECT d.prefix, d.src, c.root, d.demand FROM demand d JOIN states s ON s.prefix = d.prefix JOIN chosen c ON c.egresses = s.egresses AND c.src = d.src),
te_load AS (
  SELECT 0 AS scenario_id, edge_id, sum(load) AS load FROM (
    SELECT l.edge_id, c.demand AS load FROM cells c JOIN links l ON l.dst = l.src + 1 AND l.src < 3 WHERE c.src = 0 AND c.root = 3 AND c.prefix IN (SELECT prefix FROM tied)
    UNION ALL
    SELECT f.edge_id, c.demand * f.frac FROM cells c JOIN flow f ON f.root = c.root AND f.src = c.src WHERE NOT (c.src = 0 AND c.root = 3 AND c.prefix IN (SELECT prefix FROM tied))
  ) GROUP BY 2
)""",
    )
    + _report("te_load"),
    "te_installed_k1": _with(*_ALL, _INSTALLED) + f" SELECT l.src, l.dst, {_r4('coalesce(sum(d.current) + max(d.diff), 0)')} AS load {_TE_DIFFS}",
    "causes_te_k1": _with(*_ALL, _WORST, _TE, _TE_WORST, _CAUSES, _NAMED, _TE_CAUSES)
    + f" SELECT l.src, l.dst, r.prefix, {_r4('r.current')} AS current, {_r4('r.worst')} AS worst, {_LISTED.format('r.egresses')} AS egresses, r.ingress FROM links l JOIN sums s ON s.edge_id = l.edge_id AND s.load > 0 JOIN ranked r ON r.edge_id = l.edge_id AND r.r = 1",
    "te_clustered_inf": _with(_NET, _BASE, _FLOW, _RAW, _STATE, _grouped("p_size % 10 = 7 AND list_max(s.egresses) > 0"), _CHOSEN, _WORST, _TE, _TE_WORST) + f" SELECT l.src, l.dst, {_r4('coalesce(sum(d.worst), 0)')} AS load {_TE_DIFFS}",
    "variability_worst_k1": _with(*_ALL1, _WORST, _top(1), _HIGHEST)
    + " SELECT count(*) AS n FROM best b WHERE b.r = 1 AND NOT EXISTS (SELECT 1 FROM flow f WHERE f.scenario_id = b.scenario_id AND f.edge_id = b.edge_id AND f.sole AND f.src IN (SELECT src FROM demand))",
    "dropped_demand_routers": _with(_NET, _ROUTERS, _FLOW, _DEMAND, _STATE, _CHOSEN)
    + f" SELECT s.scenario_id AS router, {_r4('sum(b.demand) - coalesce(sum(b.demand) FILTER (c.root IS NOT NULL), 0)')} AS dropped FROM scenarios s CROSS JOIN by_state b LEFT JOIN chosen c ON c.scenario_id = s.scenario_id AND c.egresses = b.egresses AND c.src = b.src GROUP BY 1",
}
