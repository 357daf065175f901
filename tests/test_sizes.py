"""What keeps work in proportion to the input: draws made once, tasks for all, no needless rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from linkpeak.operators import paths, sweeps
from linkpeak.sources import generators as g
from linkpeak.sources import hashes
from linkpeak.sources.hashes import Tails


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def few(spark):
    sources = spark.createDataFrame([(i, i + 1.0) for i in range(5)], "src int, weight double")
    return sources, spark.range(40).withColumnRenamed("id", "prefix").coalesce(1)


def test_cells_of_a_short_file_are_drawn_once_and_by_all_tasks(spark, few):
    cells = g.iid(*few, 3, g.poisson(4.0))
    assert not re.search(r"lambdafunction\([^\n]*md5", plan_of(cells))
    assert cells.rdd.getNumPartitions() >= 16


def test_gravity_draws_by_source_and_prefix_before_they_meet(spark, few):
    law = g.between(1.0, 2.0)
    above = plan_of(g.gravity(*few, 3, law, law, law)).split("Generate")[0]
    assert above.count("md5") == 1


@pytest.mark.parametrize("in_turn", [False, True])
def test_ends_of_a_path_are_drawn_once(spark, few, in_turn):
    ends = paths.wanted_paths(few[1], few[0], few[0].select(F.col("src").alias("root")), 2, 51, in_turn=in_turn)
    assert plan_of(ends).count("md5") == 2
    assert ends.rdd.getNumPartitions() >= 16


def test_states_hash_no_list_by_row(spark, few):
    ext_links = spark.createDataFrame([(i, 0) for i in range(200)], "ext int, router int")
    states = g.random_states(few[1], ext_links, 21)
    assert not re.search(r"lambdafunction\([^\n]*md5", plan_of(states))
    found = {}
    for r in states.collect():
        found.setdefault(r["prefix"], set()).add(r["ext"])
    for p, own in found.items():
        order = sorted(range(200), key=lambda e: (hashlib.md5(f"22|{p}|{e}".encode()).hexdigest()[:13], e))  # noqa: B023
        assert own == set(order[: len(own)])
    assert len(found) == 40


def test_first_bits_of_many_texts():
    texts = [b"", b"|7", b"|12345", b"|-3", b"|" + b"9" * 30]
    for head in (b"", b"22|1", b"22|123456"):
        assert Tails(texts).draws(head).tolist() == [int(hashlib.md5(head + t).hexdigest()[:13], 16) for t in texts]


def test_smallest_draws_hash_many_heads_and_all_lengths_at_once(monkeypatch):
    calls, keep = [], hashes._registers
    monkeypatch.setattr(hashes, "_registers", lambda *some: (calls.append(some[1]), keep(*some))[1])
    texts = [f"|{i * i}".encode() for i in range(1500)]
    heads, wanted = [f"22|{p}".encode() for p in range(20, 32)], [1, 2, 3] * 4
    full = [sorted((int(hashlib.md5(head + t).hexdigest()[:13], 16), i) for i, t in enumerate(texts))[:n] for head, n in zip(heads, wanted, strict=True)]
    assert Tails(texts).firsts(heads, wanted) == full
    assert calls == [12 * 1500]
    # Too few start with zeros: these heads are looked at in full.
    monkeypatch.setattr(hashes, "SPARE", 0.1)
    assert Tails(texts).firsts(heads, wanted) == full
    assert len(calls) > 2
    assert Tails(texts[:2]).firsts(heads[:1] * 2, [4, 1]) == [sorted((int(hashlib.md5(heads[0] + t).hexdigest()[:13], 16), i) for i, t in enumerate(texts[:2]))[:n] for n in (4, 1)]
    assert Tails([]).firsts(heads[:1], [2]) == [[]]


def test_widths_write_a_row_a_prefix(spark, few, monkeypatch):
    rows = []
    keep = sweeps.checkpointed

    def counted(df, *done):
        out = keep(df, *done)
        rows.append(out.count())
        return out

    monkeypatch.setattr(sweeps, "checkpointed", counted)
    settings = spark.createDataFrame([(0, 0.5, 0.7, 0.2), (1, 1.0, 0.0, 0.9)], "setting int, attraction double, repulsion double, friction double")
    assert sweeps.fitted_widths(settings, *few, 7).count() == 2
    assert rows == [40]
    rows.clear()
    sweeps.search_widths((0.6, 0.5, 0.7), *few, 7, most=3, close=0.0)
    assert rows == [40]


def test_prepared_report_is_aggregated_by_all_tasks(spark, tmp_path, monkeypatch):
    from linkpeak.operators import reports
    from linkpeak.plans import samples
    from linkpeak.sources.tables import Tables
    from tests.compare import DATA

    plans, keep = [], reports.write_csv
    monkeypatch.setattr(reports, "write_csv", lambda df, path: (plans.append(plan_of(df)), keep(df, path)))
    assert samples.csv_report(Tables(spark, f"{DATA}/sf0.001")).count()
    assert plans[-1].startswith("Repartition 1, true")


def test_class_is_one_block_and_settles_in_one_job(spark, monkeypatch):
    from linkpeak.operators.means import Vectors, started

    rows = [(f"c{p % 3}", s, p, float(1 + p * (s + 1) % 7)) for p in range(90) for s in range(3)]
    blocks = Vectors.of(spark.createDataFrame(rows, "class string, src int, prefix long, demand double"))
    assert blocks.blocks.count() == 3
    problems = dict(enumerate(started(blocks, {"c0": 4, "c1": 5, "c2": 2}, "scaled").values()))
    steps, plain = [], Vectors(blocks.sources, blocks.blocks)
    want = plain.converged(problems)
    monkeypatch.setattr(Vectors, "means", lambda *_: steps.append(1))
    found = blocks.converged(problems)
    assert not steps
    for i, one in want.items():
        assert found[i].points == pytest.approx(one.points)


def plain_clusters(mode, prefixes, mat, k, max_iter):
    """The clusters of k-means with all its points, and its error."""
    import numpy as np

    from linkpeak.operators import means

    scale, ones = mat.sum(axis=1), np.ones(len(mat))
    order = np.lexsort((prefixes, -scale))
    begin = mat if mode == "direct" else mat / scale[:, None]
    one = means.Problem("", mode, alone=prefixes[order[: k - 1]])
    if 1 < k < len(mat):
        one = means._settled(means.Problem("", mode, begin[order[:k]]), prefixes, mat, scale, ones, max_iter, 1e-5)
    centres = means._centres(means._totals(one, prefixes, mat, scale, ones))
    return one.assigned(prefixes, mat, scale).tolist(), means._missed(one, centres, prefixes, mat, scale, ones)[:, :2].sum()


@pytest.mark.parametrize("mode", ["direct", "normalized", "scaled"])
@pytest.mark.parametrize("max_iter", [1, 2, 150])
def test_equal_vectors_climb_as_one(monkeypatch, mode, max_iter):
    import numpy as np

    from linkpeak.operators.means import Alike

    draw = np.random.default_rng(max_iter)
    # With few demands in a row some vectors are nearer to a point at zero than to any other.
    for copies, share in ((1, 0.6), (4, 0.3), (5, 1.0)):
        base = draw.integers(1, 9, (9, 4)) * (draw.random((9, 4)) < share)
        base[base.sum(axis=1) == 0, 0] = 5
        mat = np.tile(np.vstack([base, base[:2]]), (copies, 1)).astype(float)
        prefixes = draw.permutation(len(mat)).astype(np.int64)
        want = {k: plain_clusters(mode, prefixes, mat, k, max_iter) for k in range(1, len(mat) + 1)}
        for k, (clusters, _) in want.items():
            assert Alike(mode, prefixes, mat).clusters(k, max_iter, 1e-5).tolist() == clusters
        runs, keep = [], Alike.settled
        monkeypatch.setattr(Alike, "settled", lambda *some: (runs.append(some[1]), keep(*some))[1])  # noqa: B023
        found = Alike(mode, prefixes, mat).errors(list(want), -1.0, max_iter, 1e-5)
        monkeypatch.setattr(Alike, "settled", keep)
        assert dict(found) == pytest.approx({k: error for k, (_, error) in want.items()}, abs=1e-7)
        assert copies == 1 or len(runs) < len(mat) / 2


def test_equal_vectors_are_one_row_of_a_score_grid(spark, monkeypatch):
    import numpy as np

    from linkpeak.operators import clustering, means

    # The last two of nine vectors weigh the same, so that prefixes alone are of both.
    kinds = [(3, 0, 1, 1), (1, 4, 0, 2), (2, 2, 2, 3), (0, 0, 9, 1), (5, 1, 1, 2), (1, 1, 7, 1), (2, 8, 0, 4), (9, 9, 0, 2), (0, 9, 9, 2)]
    rows = [(s, p, float(x)) for p in range(90) for s, x in enumerate(kinds[p % 9]) if x]
    demand = spark.createDataFrame(rows, "src int, prefix long, demand double")
    vectors, top, points = means.Vectors.folded(demand, 13)
    assert top.tolist() == [p for p in range(90) if p % 9 > 6][:13]
    assert points.tolist() == [list(kinds[p % 9]) for p in top]
    counts = np.concatenate([np.frombuffer(r["counts"], dtype=np.int64) for r in vectors.blocks.collect()])
    assert sorted(counts.tolist()) == [1] * 13 + [3, 4] + [10] * 7
    assert vectors.totals()[""] == sum(x for _, _, x in rows)

    mat = np.array([kinds[p % 9] for p in range(90)], dtype=float)
    want = {("kmeans", k, mode): plain_clusters(mode, np.arange(90), mat, k, 150)[1] for k in (3, 12) for mode in clustering.MODES}
    for mode in clustering.MODES:
        one = means.Problem("", mode, alone=top)
        block = np.arange(90), mat, mat.sum(axis=1), np.ones(90)
        want["heaviest", 13, mode] = means._missed(one, means._centres(means._totals(one, *block)), *block)[:, :2].sum()
    steps, keep = [], means.Vectors.means
    monkeypatch.setattr(means.Vectors, "means", lambda *some: (steps.append(1), keep(*some))[1])
    for whole in (means.WHOLE, 0):
        monkeypatch.setattr(means, "WHOLE", whole)
        found = {(r["method"], r["k"], r["mode"]): 2 * r["error"] * mat.sum() for r in clustering.score_grid(demand, (13,), (3, 12)).collect()}
        assert {name: found[name] for name in want} == pytest.approx(want)
        # Vectors of one block settle where they lie; the only means are those that errors are told by.
        assert len(steps) == 1 or not whole


def test_points_of_classes_that_are_one_block_stay_off_the_driver(spark, monkeypatch):
    from linkpeak.operators.means import Vectors

    rows = [(s, p, float(1 + p % 8 * (s + 1) % 7)) for p in range(60) for s in range(3)]
    demand = spark.createDataFrame(rows, "src int, prefix long, demand double")
    settings = spark.createDataFrame([(p, "egress", [p % 2]) for p in range(60)], "prefix long, kind string, egresses array<int>")
    monkeypatch.setattr(Vectors, "heaviest", lambda *_: pytest.fail("points came to the driver"))
    found = sweeps.cluster_to_error(demand, settings, 0.05)
    assert found.count() == found.select("prefix").distinct().count() == 60


def test_nearest_point_is_that_of_full_distances():
    import numpy as np

    from linkpeak.operators.means import Problem

    draw = np.random.default_rng(5)
    mat = np.concatenate([draw.integers(0, 50, (400, 7)), np.eye(7, dtype=int)[[0] * 30] * 3]).astype(float)
    scale = np.where(mat.sum(axis=1) == 0, 1.0, mat.sum(axis=1))
    for mode in ("direct", "normalized", "scaled"):
        x = mat if mode == "direct" else mat / scale[:, None]
        points = np.concatenate([x[:20], x[:5], np.zeros((3, 7)), x[400:403] + 1e-9])
        far = np.abs(x[:, None, :] - points[None]).sum(axis=2) * (scale[:, None] if mode == "scaled" else 1.0)
        found = Problem("", mode, points).assigned(np.arange(len(mat)), mat, scale)
        assert found.tolist() == np.round(far, 6).argmin(axis=1).tolist()


@pytest.mark.parametrize("low", [0, -9])
def test_nearest_of_many_points_by_short_numbers(monkeypatch, low):
    import numpy as np

    from linkpeak.operators import means

    draw = np.random.default_rng(6)
    x = np.concatenate([draw.integers(low, 9, (300, 5)).astype(float), np.exp(draw.normal(0, 3, (300, 5))), np.zeros((2, 5))])
    points = np.concatenate([x[::7], x[::9] + 1e-8, np.zeros((1, 5))])
    kinds, keep = set(), np.add
    monkeypatch.setattr(np, "add", lambda a, b, **more: (kinds.add(a.dtype.name), keep(a, b, **more))[1])
    for weight in (np.ones(len(x)), draw.integers(1, 10**5, len(x)).astype(float)):
        far = np.zeros((len(x), len(points)))
        for s in range(5):
            far += np.abs(x[:, s, None] - points[None, :, s])
        assert means._nearest(x, points, weight).tolist() == np.round(far * weight[:, None], 6).argmin(axis=1).tolist()
    assert kinds == {"float32" if low else "int16"}


def test_rows_of_several_blocks_are_dealt_evenly(spark, monkeypatch):
    from linkpeak.operators import means

    demand = spark.createDataFrame([(s, p, float(1 + p * (s + 1) % 37)) for p in range(60) for s in range(3)], "src int, prefix long, demand double")
    monkeypatch.setattr(means, "WHOLE", 0)
    vectors, _, _ = means.Vectors.folded(demand, 5)
    assert vectors.blocks.count() >= spark.sparkContext.defaultParallelism


def test_routes_kept_do_not_grow_with_paths():
    import numpy as np

    from linkpeak.operators import blocks
    from linkpeak.operators.flow import Routes

    class Line:
        """Three routers in a row, two of them roots."""

        names, root_at, edge = np.arange(3), np.array([0, 2]), np.arange(4)

        def roots_at(self, routers):
            return np.flatnonzero(np.isin(self.names[self.root_at], list(routers)))

    share = np.arange(24, dtype=float).reshape(2, 3, 4)
    routes = Routes(share, np.array([[0.0, 1.0, 2.0], [2.0, 1.0, 0.0]]), None, None)
    scene = blocks.Scene(blocks.Ways(Line(), blocks.PLAIN), routes)
    plain = scene.routed((0, 2), "").copy()
    for n in range(1, 30):
        found = scene.routed((0, 2), f"1,0,{n},0 3")
        assert found[1].tolist() == [1 / n, 0, 0, 1 / n]
        assert found[[0, 2]].tolist() == plain[[0, 2]].tolist()
    assert scene.routed((0, 2), "").tolist() == plain.tolist()
    assert len(scene._routed) == 1


def test_only_pairs_that_changes_can_lift_are_computed(spark, monkeypatch):
    from linkpeak.operators import blocks
    from linkpeak.plans import registry
    from linkpeak.sources.tables import Tables
    from tests.compare import DATA

    asked, keep = [], blocks.scenario_loads

    def counted(packed, scenarios, k, *rest, **more):
        if k:
            asked.append(scenarios.select(F.sum(F.size("edges"))).first()[0] if "edges" in scenarios.columns else scenarios.count() * len(packed.graph.edge))
        return keep(packed, scenarios, k, *rest, **more)

    monkeypatch.setattr(blocks, "scenario_loads", counted)
    assert registry.failures_l1_k1(Tables(spark, f"{DATA}/sf0.01")).count() == 90
    # 46 scenarios by 90 links.
    assert sum(asked) < 46 * 90 / 4


def test_ways_that_others_exceed_are_left_out():
    import numpy as np

    from linkpeak.operators import blocks
    from linkpeak.operators.flow import Routes

    class Any:
        rules = {0: blocks.Rule("egress")}
        roots = staticmethod(lambda _: np.arange(40))
        allowed = staticmethod(lambda _: None)

    draw = np.random.default_rng(8)
    share = draw.integers(0, 3, (40, 3, 11)) / 2.0
    share[:, :, 4], share[5] = 0, share[6]
    order, parts = blocks.Scene(Any(), Routes(share, np.ones((40, 3)), None, None)).leading(0, "")
    demand, best = draw.random((50, 3)), np.zeros((50, 11))
    for way in parts:
        best[:, : way.shape[1]] = np.maximum(best[:, : way.shape[1]], demand @ way)
    assert np.allclose(best[:, np.argsort(order)], np.max([demand @ s for s in share], axis=0))
    assert sum(way.shape[1] for way in parts) < 40 * 11 / 4


def test_clusters_need_no_rows_of_zeros(spark):
    from linkpeak.operators import clustering

    rows = [(s, p, float(1 + (p * 7 + s * 3) % 11)) for p in range(30) for s in range(6) if (p + s) % 3]
    demand = spark.createDataFrame(rows, "src int, prefix long, demand double")
    groups = demand.select("prefix").distinct().withColumn("cluster", (F.col("prefix") % 4).cast("int"))
    vec = clustering.vectors(demand)
    for mode in clustering.MODES:
        want = {(r["cluster"], r["src"]): r["demand"] for r in clustering.effective_demand(vec, groups, mode).where("demand > 0").collect()}
        assert {(r["cluster"], r["src"]): r["demand"] for r in clustering.clustered_demand(demand, groups, mode).collect()} == pytest.approx(want)
        error = clustering.errors(vec, groups, mode).agg(F.sum(F.col("error_pos") + F.col("error_neg"))).first()[0]
        assert clustering.half_error(demand, groups, mode).first()["half"] * 2 == pytest.approx(error)


def test_classes_of_one_cluster_pack_no_vectors(spark, monkeypatch):
    from linkpeak.operators.means import Vectors

    rows = [(s, p, float(1 + p * s % 5)) for p in range(12) for s in range(3)]
    demand = spark.createDataFrame(rows, "src int, prefix long, demand double")
    settings = spark.createDataFrame([(p, "egress" if p % 4 else "both", [p % 2]) for p in range(12)], "prefix long, kind string, egresses array<int>")
    monkeypatch.setattr(Vectors, "of", lambda *_: pytest.fail("vectors were packed"))
    found = sweeps.cluster_within_budget(demand, settings, 1).join(sweeps.classed(demand, settings).select("prefix", "class").distinct(), "prefix")
    assert found.count() == 12
    assert found.groupBy("class").agg(F.countDistinct("cluster").alias("n")).where("n > 1").count() == 0
    assert found.select("cluster").distinct().count() == found.select("class").distinct().count()


def test_settings_of_a_sweep_share_what_is_packed(spark, monkeypatch):
    from linkpeak.operators import blocks
    from linkpeak.plans import experiments
    from linkpeak.sources.tables import Tables
    from tests.compare import DATA

    packs, keep = [], blocks.Packed.of
    monkeypatch.setattr(blocks.Packed, "of", lambda *some: (packs.append(1), keep(*some))[1])
    assert experiments.running_time_sweep(Tables(spark, f"{DATA}/sf0.001")).count() == 4
    assert len(packs) == 1


def test_variability_works_demand_out_once(spark):
    from linkpeak.plans.experiments import variability_worst_k1
    from linkpeak.sources.tables import Tables
    from tests.compare import DATA

    # What is left to run reads written tables only.
    assert "l_quantity" not in plan_of(variability_worst_k1(Tables(spark, f"{DATA}/sf0.001")))


def test_items_are_dealt_by_prefix_once_and_never_by_customer(spark):
    from linkpeak.operators import blocks
    from linkpeak.sources.tables import Tables
    from tests.compare import DATA

    t = Tables(spark, f"{DATA}/sf0.001")
    cells = blocks.cells_of(t.demand)
    physical = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\((\w+)#\d+L?, \d+\), REPARTITION", physical(cells)) == ["prefix"]
    assert not re.search(r"hashpartitioning\((src|prefix)#\d+L?, [a-z]|hashpartitioning\([^\n]*ENSURE[^\n]*\n[^\n]*collect_list", physical(cells))
    assert "c_custkey" not in re.search(r"l_orderkey#\d+L = o_orderkey[^\n]*", plan_of(cells)).group()
    assert physical(t.states).count("hashpartitioning(prefix") == 1
    want = {(r["src"], r["prefix"]): r["demand"] for r in t.demand.collect()}
    assert {(r["src"], r["prefix"]): r["demand"] for r in blocks.demand_of(cells).collect()} == want


def test_no_lists_of_nulls_go_to_python_where_there_are_no_clusters(spark, monkeypatch):
    from linkpeak.operators import blocks
    from linkpeak.plans import samples
    from linkpeak.sources.tables import Tables
    from tests.compare import DATA

    plans, keep = [], blocks.checkpointed
    monkeypatch.setattr(blocks, "checkpointed", lambda df, *done: (plans.append(plan_of(df)), keep(df, *done))[1])
    net = samples.network(Tables(spark, f"{DATA}/sf0.001"))
    assert net.packed(1).blocks.count()
    assert len(plans) == 1
    assert "members" not in plans[0]
    # The written cells are joined as they are, neither gathered nor sorted again.
    assert "collect_list" not in plans[0]
