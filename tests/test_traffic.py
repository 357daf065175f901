"""Statistics, clusters, generators and reports on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from linkpeak.operators import clustering, reports, traffic
from linkpeak.sources import generators as g

CASES = {
    "perfect": [(9.0, 1.0), (90.0, 10.0)],
    "almost": [(9.1, 0.9), (89.0, 11.0)],
    "three": [(8.1, 0.9, 1.0), (79.5, 10.5, 10.0), (795.0, 105.0, 100.0)],
}


def matrix(spark, rows):
    return spark.createDataFrame([(s, p, x) for p, row in enumerate(rows) for s, x in enumerate(row)], "src int, prefix long, demand double")


def centre(spark, rows, mode):
    v = clustering.vectors(matrix(spark, rows))
    return [round(r["centre"], 9) for r in clustering.centres(v, clustering.single(v), mode).orderBy("src").collect()]


def test_centres(spark):
    assert centre(spark, [(1.0, 10.0), (100.0, 10.0)], "direct") == [50.5, 10.0]
    assert centre(spark, CASES["perfect"], "normalized") == [0.9, 0.1] == centre(spark, CASES["perfect"], "scaled")
    assert centre(spark, CASES["almost"], "normalized") == [0.9, 0.1]
    assert 0.89 < centre(spark, CASES["almost"], "scaled")[0] < 0.9
    assert centre(spark, CASES["three"], "normalized") == pytest.approx([0.8, 0.1, 0.1], abs=1e-9)


@pytest.mark.parametrize("mode", ["direct", "scaled"])
def test_errors_are_symmetric(spark, mode):
    v = clustering.vectors(matrix(spark, CASES["three"]))
    row = clustering.errors(v, clustering.single(v), mode).first()
    assert row["error_pos"] == pytest.approx(row["error_neg"])


def test_kmeans_separates_two_shapes(spark):
    rows = [(10.0 * k, 1.0 * k) for k in range(1, 6)] + [(1.0 * k, 10.0 * k) for k in range(1, 6)]
    v = clustering.vectors(matrix(spark, rows))
    points = clustering.kmeans(v, 2, "scaled", seed=3, max_iter=10)
    found = {r["prefix"]: r["cluster"] for r in points.collect()}
    assert len(found) == 10


def test_approximated_matrix_keeps_all_demand(spark):
    v = clustering.vectors(matrix(spark, CASES["three"]))
    m, lookup, back = clustering.approximated(v, clustering.heaviest(v, 1), "scaled")
    assert m.agg(F.sum("demand")).first()[0] == pytest.approx(1110.0)
    assert lookup.count() == 3
    assert sorted(len(r["prefixes"]) for r in back.collect()) == [1, 2]


def test_sigma_fit(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (0, 2, 2.0)], "src int, prefix long, demand double")
    assert traffic.lognormal_sigmas(df).first()["attraction"] == pytest.approx(0.32675, abs=1e-4)


@pytest.mark.parametrize(("bound", "k"), [(0.0, 4), (1.0, 4), (1.5, 3), (4.0, 2), (100.0, 0)])
def test_equivalent_top_k(spark, bound, k):
    """The first rank whose running sum exceeds the total less the bound, else all prefixes."""
    sizes = [5.0, 3.0, 1.0, 1.0]
    df = spark.createDataFrame([(0, p, x) for p, x in enumerate(sizes)], "src int, prefix long, demand double")
    run, expected = 0.0, None
    for i, x in enumerate(sizes, 1):
        run += x
        if expected is None and run > sum(sizes) - bound:
            expected = i
    assert traffic.equivalent_top_k(df, bound).first()[0] == (expected or len(sizes))


def test_difference_takes_the_upper_median(spark):
    a = spark.createDataFrame([(0, 1, 1.0), (1, 2, 5.0), (2, 3, 7.0), (3, 4, 9.0)], "src int, dst int, load double")
    b = spark.createDataFrame([(0, 1, 0.0), (1, 2, 3.0), (2, 3, 4.0), (3, 4, 4.0)], "src int, dst int, load double")
    row = traffic.difference(a, b, 1.0).first()
    assert (row["min"], row["median"], row["max"], row["sum"], row["mean"]) == (1.0, 3.0, 5.0, 11.0, 2.75)


def test_generators_are_fixed_by_seed_and_have_their_means(spark):
    keys = spark.range(20000).select(F.col("id"))
    laws = {
        "uniform": (g.between(2.0, 4.0), 3.0, 1 / 3), "normal": (g.normal(1.0, 2.0), 1.0, 4.0), "exponential": (g.exponential(2.0), 0.5, 0.25), "poisson": (g.poisson(3.5), 3.5, 3.5),
        "whole": (g.beta(2, 3), 0.4, 0.04), "broken": (g.beta(0.5, 1.5), 0.25, 0.0625), "mean_one": (g.log_normal_mean_one(0.5), 1.0, 0.25), "log_normal": (g.log_normal(0.2), math.exp(0.02), (math.exp(0.04) - 1) * math.exp(0.04)),
    }
    drawn = keys.select(*[law(7, "id").alias(name) for name, (law, _, _) in laws.items()], g.shifted_pareto(1.5)(7, "id").alias("pareto"))
    stats = drawn.agg(*[f(name).alias(f"{name}_{kind}") for name in laws for kind, f in (("mean", F.avg), ("var", F.var_samp))], F.median("pareto").alias("pareto"), F.min("pareto").alias("least")).first()
    for name, (_, mean, var) in laws.items():
        assert stats[f"{name}_mean"] == pytest.approx(mean, abs=4 * math.sqrt(var / 20000) + 1e-9), name
        assert stats[f"{name}_var"] == pytest.approx(var, rel=0.1), name
    # The median is 1 before the law is moved to start at 0.
    assert stats["pareto"] == pytest.approx(1 - 2 ** (-1 / 1.5), abs=0.05)
    assert stats["least"] >= 0
    assert keys.select(g.beta(0.5, 1.5)(3, "id")).collect() == keys.repartition(3).select("id", g.beta(0.5, 1.5)(3, "id").alias("x")).orderBy("id").select("x").collect()
    assert g.complete_graph(spark, 5).select("edge_id").distinct().count() == 20
    weights = g.random_weights(g.complete_graph(spark, 5), 7).collect()
    back = {(r["src"], r["dst"]): r["weight"] for r in weights}
    assert all(10 <= w <= 100 and back[b, a] == w for (a, b), w in back.items())


def test_states_and_matrices(spark):
    prefixes, exts = spark.range(500).withColumnRenamed("id", "prefix"), spark.createDataFrame([(i,) for i in range(6)], "ext int")
    many = [r["n"] for r in g.random_states(prefixes, exts, 1).groupBy("prefix").agg(F.count("*").alias("n")).collect()]
    assert len(many) == 500
    assert set(many) == {1, 2, 3}
    pooled = g.pooled_states(prefixes, exts, 10, 1).groupBy("prefix").agg(F.array_sort(F.collect_list("ext")).alias("e"))
    assert pooled.count() == 500
    assert 2 <= pooled.select("e").distinct().count() <= 15
    with pytest.raises(ValueError, match="one of"):
        g.pooled_states(prefixes, exts, 15, 1)
    sources = spark.createDataFrame([(i,) for i in range(4)], "src int")
    laws = g.uniform_around_one(0.5), g.shifted_pareto(1.0), g.uniform_around_one(0.5)
    m = g.gravity(sources, prefixes, 3, *laws)
    assert m.count() == 2000
    turned = g.gravity(sources, prefixes, 3, *laws, invert_friction=True)
    friction = laws[2](5, "src", "prefix").alias("f")
    both = m.join(turned.withColumnRenamed("demand", "d"), ["src", "prefix"]).select("demand", "d", friction)
    assert all(r["d"] / r["demand"] == pytest.approx(r["f"] ** 2) for r in both.where("demand > 0").limit(50).collect())
    assert g.iid(sources, prefixes, 4, g.between(0.0, 1.0)).count() == 2000
    demand, ext_links, state = g.all_pairs(spark.createDataFrame([(i,) for i in range(4)], "router_id int"), 5, *laws)
    assert (demand.count(), ext_links.count(), state.where("prefix = ext").count()) == (16, 4, 4)
    att = prefixes.select("prefix", (1.0 + F.col("prefix")).alias("attraction"))
    shares = g.renormalised(m, att).groupBy("prefix").agg(F.sum("demand").alias("d")).orderBy("prefix").collect()
    assert shares[9]["d"] / shares[4]["d"] == pytest.approx(2.0)
    edges = g.parse_edges(spark.createDataFrame([(1, "7:3:1;6:2:1;3:3:9;7:3:5;"), (2, "9:9:1;9:7:2;7:3:4"), (3, ""), (4, None)], "graph int, edges string")).collect()
    assert sorted((r["graph"], r["src"], r["dst"], r["weight"], r["src_id"], r["dst_id"]) for r in edges) == [(1, "6", "2", 1, 2, 3), (1, "7", "3", 1, 0, 1), (2, "7", "3", 4, 1, 2), (2, "9", "7", 2, 0, 1)]


def test_newest_csv_and_texts(spark, tmp_path):
    for day, x in (("01", 1), ("02", 2)):
        (tmp_path / f"run_2024-01-{day}.csv").write_text(f"a,b\n{x},inf\n")
    df = reports.newest_csv(spark, str(tmp_path), "run_", "a int, b string")
    row = df.select("a", reports.as_number(F.col("b")).alias("b")).first()
    assert row["a"] == 2
    assert math.isinf(row["b"])
    (tmp_path / "run_zz.csv").write_text("a,b\n9,1\n")
    assert reports.newest_csv(spark, str(tmp_path), "run_", "a int, b string", timed=True).first()["a"] == 2
    (tmp_path / "run_2024-01-03.csv").write_text("a,b\n")
    assert reports.newest_csv(spark, str(tmp_path), "run_2", "a int, b string").count() == 0
    with pytest.raises(FileNotFoundError):
        reports.newest_csv(spark, str(tmp_path), "none", "a int")
    assert [reports.bound_text(*x, 100.0) for x in ((1.0, 1.0), (2.0, 1.0), (0.0, 0.0), (3.0, 0.0), (0.0, 4.0))] == ["± 1.0%", "+2.0% -1.0%", "± 0.0%", "+3.0%", "-4.0%"]


def test_reports_side_by_side(spark):
    load = lambda rows: spark.createDataFrame(rows, "src int, dst int, load double")
    rows = reports.report_columns(load([(0, 1, 5.0)]), [load([(1, 0, 10.0)]), load([(0, 1, 7.0), (1, 0, 0.0)])])
    assert sorted(map(tuple, rows.collect())) == [(0, 1, 5.0, 0.0, 7.0), (1, 0, 0.0, 10.0, 0.0)]
    names = spark.createDataFrame([(0, "a"), (1, "b")], "router_id int, name string")
    lines = sorted(r["line"] for r in reports.link_text(rows, names, 100.0, [(0.0, 0.0), (5.0, 2.0)]).collect())
    assert lines == [f"{'a': >20} -> {'b': <20}:   5.000% |   0%     ± 0.0% |   7.000% +5.0% -2.0%", f"{'b': >20} -> {'a': <20}:   0%     |  10.000% ± 0.0% |   0%     +5.0% -2.0%"]


def test_shares_are_of_the_total_or_of_one(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0)], "src int, demand double")
    assert [r["demand"] for r in traffic.shares(df, 4.0).orderBy("src").collect()] == [0.25, 0.75]
    assert traffic.shares(traffic.shares(df, 4.0), 4.0).agg(F.sum("demand")).first()[0] == 1.0
    with pytest.raises(ValueError, match="neither"):
        traffic.shares(df, 5.0)
    wanted = spark.createDataFrame([(3.0, 3.0, 2.5), (3.04, 2.96, 2.5), (9.0, 9.0, 9.0)], "attraction double, repulsion double, friction double")
    assert [r["sample_attraction"] for r in traffic.sampled_for(wanted).orderBy("attraction").collect()] == [2.82, 2.82, None]


def kmeans_by_hand(rows, k, mode):
    """The cluster of each row: L1 distances, ties to the lowest, means until they hardly move; the same start."""
    scale = [sum(r) for r in rows]
    x = [list(r) if mode == "direct" else [a / s for a in r] for r, s in zip(rows, scale, strict=True)]
    weight = scale if mode == "scaled" else [1.0] * len(rows)
    points = [x[i] for i in sorted(range(len(rows)), key=lambda i: (-scale[i], i))[:k]]
    near = lambda v, w: min((round(sum(abs(a - b) * w for a, b in zip(v, p, strict=True)), 6), c) for c, p in enumerate(points))[1]
    for _ in range(150):
        parts = [near(v, w) for v, w in zip(x, weight, strict=True)]
        moved = []
        for c in range(len(points)):
            own = [i for i, p in enumerate(parts) if p == c]
            total = sum(weight[i] for i in own)
            moved.append([sum(x[i][s] * weight[i] for i in own) / total if own else 0.0 for s in range(len(rows[0]))])
        change = sum(abs(a - b) for p, q in zip(points, moved, strict=True) for a, b in zip(p, q, strict=True))
        points = moved
        if change < 1e-5 * (sum(scale) if mode == "direct" else 1.0):
            break
    return [near(v, w) for v, w in zip(x, weight, strict=True)]


def test_score_grid_has_every_method(spark):
    rows = [tuple(float(1 + (p * p * 7 + s * 5 + p * s) % 23) for s in range(3)) for p in range(14)]
    v = clustering.vectors(matrix(spark, rows))
    whole = {(r["method"], r["k"], r["mode"]) for r in clustering.score_grid(v, means=()).collect()}
    assert whole == {(m, k, mode) for m, k in [("single", 1), *(("heaviest", k) for k in (10, 50, 100, 500, 1000))] for mode in clustering.MODES}
    found = {(r["method"], r["k"], r["mode"]): r["error"] for r in clustering.score_grid(v, (), (3,)).collect()}
    assert set(found) == {(m, k, mode) for m, k in (("single", 1), ("kmeans", 3)) for mode in clustering.MODES}
    total = sum(map(sum, rows))
    for mode in clustering.MODES:
        parts, error = kmeans_by_hand(rows, 3, mode), 0.0
        for c in set(parts):
            own = [r for r, p in zip(rows, parts, strict=True) if p == c]
            for s in range(3):
                share = [r[s] / sum(r) for r in own]
                middle = {"direct": sum(r[s] for r in own) / len(own), "normalized": sum(share) / len(own), "scaled": sum(r[s] for r in own) / sum(map(sum, own))}[mode]
                error += sum(max(r[s] - middle, 0.0) if mode == "direct" else max(x - middle, 0.0) * sum(r) for r, x in zip(own, share, strict=True))
        assert found["kmeans", 3, mode] == pytest.approx(error / total)
