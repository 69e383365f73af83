"""Every registered query against its DuckDB text; the others run and give rows."""

import pytest

from ledgerloom.plans import load
from ledgerloom.plans.registry import REGISTRY
from tests.compare import same

load()


@pytest.mark.parametrize("name", sorted(REGISTRY.oracles))
def test_oracle(spark, sf_dir, name):
    same(spark, sf_dir, REGISTRY.queries[name], REGISTRY.oracles[name])


@pytest.mark.parametrize("name", sorted(set(REGISTRY.queries) - set(REGISTRY.oracles)))
def test_runs(spark, sf_dir, name):
    df = REGISTRY.queries[name](spark, sf_dir)
    assert df.columns and df.count() > 0


def test_registry_reports_instead_of_raising(spark, sf_dir, monkeypatch):
    status = lambda *a, **k: REGISTRY.run(spark, *a, **k).first()["status"]
    assert status("nothing", sf_dir) == "unknown"
    assert status("q11_dupont", sf_dir, wrong=1) == status("p2_swing_episodes", sf_dir, threshold="x") == status("p2_swing_episodes", sf_dir, threshold=True) == "bad_argument"
    assert status("q11_dupont", "/nowhere") == "failed"
    late = lambda s, d: s.range(3).selectExpr("raise_error(concat('late ', id)) as x")
    monkeypatch.setitem(REGISTRY.queries, "late", late)
    failed = REGISTRY.run(spark, "late", sf_dir).collect()
    assert len(failed) == 1 and failed[0]["status"] == "failed" and "late" in failed[0]["message"]
    assert REGISTRY.run(spark, "q11_dupont", sf_dir).count() > 0


def test_registry_lists_and_passes_parameters(spark, sf_dir):
    listed = {r["tool"]: r["parameters"] for r in REGISTRY.tools(spark).collect()}
    assert set(listed) == set(REGISTRY.queries) and listed["p2_swing_episodes"] == "threshold: float = 0.25, min_points: int = 8" and listed["q11_dupont"] == ""
    few, many = (REGISTRY.run(spark, "p2_swing_episodes", sf_dir, threshold=x).count() for x in (1, 0.1))
    assert 0 < few < many


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
