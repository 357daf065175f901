"""Sweeps, searches and clusters to a target error, against the plain way, one after the other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkpeak.operators import clustering, sweeps, traffic
from linkpeak.plans.experiments import accuracy
from tests.test_analysis import base, loads_of  # noqa: F401
from tests.test_rules_and_members import weighted


def test_search_in_boxes_takes_the_same_steps():
    cases = [(lambda p: (p[0] * 0.9, p[1] + 0.2 * p[0]), (0.5, 0.1), (0.9, 0.3)), (lambda p: (0.0 if p[0] < 0.55 else 0.8,), (0.5,), (0.5,))]
    for shape, start, target in cases:
        asked = []

        def many(some, shape=shape, asked=asked):
            asked.append(len(some))
            return {at: shape(at) for at in some}

        assert sweeps.search_many(many, start, target, ahead=3) == sweeps.search(shape, start, target)
        assert len(asked) < 15


def test_widths_of_all_settings_at_once(spark):
    sources, prefixes = spark.createDataFrame([(i,) for i in range(9)], "src int"), spark.range(40).withColumnRenamed("id", "prefix")
    settings = spark.createDataFrame([(0, 0.5, 0.7, 0.2), (1, 1.0, 0.0, 0.9)], "setting int, attraction double, repulsion double, friction double")
    found = {r["setting"]: r for r in sweeps.fitted_widths(settings, sources, prefixes, 7).collect()}
    from linkpeak.sources import generators as g

    for i, a, r, f in settings.collect():
        demand = g.gravity(sources, prefixes, 7, g.log_normal(r), g.log_normal(a), g.log_normal(f))
        alone = traffic.lognormal_sigmas(demand).first()
        assert [found[i][f"fitted_{c}"] for c in ("attraction", "repulsion", "friction")] == pytest.approx([alone["attraction"], alone["repulsion"], alone["friction"]])


def by_hand(demand, settings, target):
    """Class after class: as few clusters as its allowance asks for."""
    tagged = sweeps.classed(demand, settings)
    rows = tagged.groupBy("class").agg(F.countDistinct("prefix").alias("n"), F.sum("demand").alias("t")).orderBy("n", "class").collect()
    total = sum(r["t"] for r in rows)
    left, rest, out = target * total, total, {}
    for r in rows:
        vec, k = clustering.vectors(tagged.where(F.col("class") == r["class"]).select("src", "prefix", "demand")), 1
        while True:
            one = clustering.single(vec) if k == 1 else clustering.kmeans(vec, k) if k < r["n"] else clustering.heaviest(vec, k - 1)
            error = clustering.errors(vec, one, "scaled").agg(F.sum(F.col("error_pos") + F.col("error_neg"))).first()[0]
            if error <= left * r["t"] / rest or k >= r["n"]:
                break
            k += 1
        out[r["class"]], left, rest = k, left - error, rest - r["t"]
    return out


def test_target_error_of_all_classes_in_common_jobs(spark):
    draw = np.random.default_rng(3)
    rows = [(s, p, float(x)) for p in range(11) for s, x in enumerate(draw.integers(1, 12, 3))]
    demand = spark.createDataFrame(rows, "src int, prefix long, demand double")
    settings = spark.createDataFrame([(p, "egress", [p % 2]) for p in range(11)], "prefix long, kind string, egresses array<int>")
    for target in (0.2, 0.0):
        found = sweeps.cluster_to_error(demand, settings, target, at_once=2).join(sweeps.classed(demand, settings).select("prefix", "class").distinct(), "prefix")
        assert {r["class"]: r["k"] for r in found.groupBy("class").agg(F.countDistinct("cluster").alias("k")).collect()} == by_hand(demand, settings, target)


def test_accuracy_is_that_of_separate_runs(spark, base):  # noqa: F811
    net = weighted(spark, base)
    net = type(net)(net.links, net.ext_links, net.demand.withColumn("demand", F.col("demand") + F.col("prefix") % 3 * F.col("src")), net.route_state)
    row = accuracy(net, (2,), 2).first()
    total = net.demand.agg(F.sum("demand")).first()[0]
    one, two = loads_of(net.analyze(2, 0)), loads_of(net.with_cluster_number(2).analyze(2, 0))
    gaps = sorted(abs(one[e] - two[e]) / total for e in one)
    assert [row["error_min"], row["error_max"], row["error_mean"]] == pytest.approx([gaps[0], gaps[-1], sum(gaps) / len(gaps)], abs=1e-6)
    assert row["error_max"] <= row["bound"] * 2 + 1e-9
    assert row["equivalent_top_k"] >= 1
