"""Every query with SQL gives the rows that DuckDB gives for it."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from linkpeak.plans import registry
from tests.compare import DATA, connect, duck_rows, spark_rows

SF = "sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(f"{DATA}/{SF}"), reason="the test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert spark_rows(registry.queries()[name](spark, f"{DATA}/{SF}")) == duck_rows(con, registry.oracle_sql()[name])


def test_entry_module_needs_no_session():
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 90)"], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[1], check=True)
    assert out.stdout.strip().endswith("True")


def test_kmeans_covers_every_prefix(spark):
    rows = registry.queries()["kmeans"](spark, f"{DATA}/{SF}").collect()
    assert len({r["prefix"] for r in rows}) == len(rows) == 200
    assert {r["cluster"] for r in rows} <= set(range(8))


def test_compatible_subsets_of_all_border_routers(spark):
    from tests.test_loads import compatible

    prefs = {}
    for r in spark.read.parquet(f"{DATA}/{SF}/supplier.parquet").collect():
        prefs.setdefault(r["s_nationkey"], set()).add(100 + 50 * (r["s_suppkey"] % 3))
    rows = registry.queries()["lp_compatible_subsets_all"](spark, f"{DATA}/{SF}").collect()
    assert max(prefs) >= 12
    assert sorted(r["egresses"] for r in rows) == sorted(",".join(map(str, s)) for s in compatible(prefs))


def test_kmeans_has_converged(spark):
    from linkpeak.operators import clustering
    from linkpeak.sources.tables import Tables

    v = clustering.vectors(Tables(spark, f"{DATA}/{SF}").demand)
    now = registry.queries()["kmeans"](spark, f"{DATA}/{SF}").checkpoint()
    # A further step changes no cluster; clusters without members keep no point that could take any.
    after = clustering.assign(v, clustering.centres(v, now, "scaled"), "scaled")
    assert sorted(map(tuple, now.collect())) == sorted(map(tuple, after.collect()))
