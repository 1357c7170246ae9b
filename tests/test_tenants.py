"""Tenants have stores of their own, and only those asked for are opened."""

import datetime as dt

import pytest
from conftest import rows

from worklens.operators import overview, rankings
from worklens.plans import cube
from worklens.sources import readers, store, tenants, writers

NAMES = ["north", "s/o=u t%h", "ñ"]


def made(make_log):
    return make_log(
        *[
            {"analyst": a, "queue": n, "completed_at": dt.datetime(2024, 1, 1 + i % 3)}
            for i in range(6) for a, n in zip(("ana", "bob", "eve"), NAMES)
        ]
    ).withColumnRenamed("queue", "tenant")


def productivity(spark):
    return lambda found: overview.daily_productivity(store.scan_log(spark, found))


def test_no_rows_of_another(spark, tmp_path, make_log):
    base, log = str(tmp_path / "all"), made(make_log)
    assert set(tenants.write_tenants(log, 0, base, with_cube=True)) == set(NAMES)
    assert tenants.tenants_at(spark, base) == sorted(NAMES)
    for name, analyst in zip(NAMES, ("ana", "bob", "eve")):
        root = tenants.tenant_root(base, name)
        assert {r.analyst for r in readers.scan_task_log(spark, root).collect()} == {analyst}
    ranked = tenants.for_each_tenant(
        spark, base, lambda found: rankings.rank_overall(cube.scan_stored_cube(spark, found))
    )
    assert rows(ranked, "tenant", "position", "analyst", "total") == sorted(
        (n, 1, a, 6) for n, a in zip(NAMES, ("ana", "bob", "eve"))
    )
    # One tenant's batch is replaced; the others' stay.
    writers.write_task_log(make_log(), 0, tenants.tenant_root(base, NAMES[0]))
    left = tenants.for_each_tenant(spark, base, productivity(spark))
    assert {r.tenant for r in left.collect()} == set(NAMES[1:])


def test_only_those_asked_for_are_read(spark, tmp_path, make_log):
    base = str(tmp_path / "all")
    tenants.write_tenants(made(make_log), 0, base)
    allowed = spark.createDataFrame([("north", 1), ("nobody", 2), (None, 3)], "name string, user int")
    for chosen in (allowed, ["north"]):
        found = tenants.for_each_tenant(spark, base, productivity(spark), chosen)
        assert found.inputFiles() and all("/tenant=north/" in f for f in found.inputFiles())
        assert rows(found, "tenant", "productivity") == [("north", 2)] * 3
    none = tenants.for_each_tenant(spark, base, productivity(spark), ["nobody"])
    assert none.columns == ["tenant", "day", "productivity"] and none.count() == 0
    assert tenants.for_each_tenant(spark, str(tmp_path / "none"), productivity(spark)).count() == 0


def test_rows_without_a_tenant(spark, tmp_path, make_log):
    log = made(make_log).selectExpr("* EXCEPT (tenant)", "nullif(tenant, 'north') AS tenant")
    with pytest.raises(ValueError, match="tenant"):
        tenants.write_tenants(log, 0, str(tmp_path / "all"))
