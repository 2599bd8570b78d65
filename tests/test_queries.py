import pytest

import __spark_entry__ as entry
from moradia.plans import extract, general, pages, records, tables
from oracle import connection, rows

CORE = {k: v for m in (general, tables, extract, records, pages) for k, v in m.ORACLE.items()}
PLAIN = [k for m in (general, tables, extract, records, pages) for k in m.QUERIES if k not in CORE]


@pytest.mark.parametrize("name", sorted(CORE))
def test_equals_sql(spark, sf, name):
    got = entry.queries()[name](spark, sf).toPandas()
    want = connection(sf).execute(CORE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_runs(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    assert df.count() >= 0 and df.columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["snapshot_sync", "sync_counts", "disable_missing", "delta_counts", "compare_overlap", "exclusive_urls"])
def test_every_snapshot_equals_sql(spark, sf, name):
    got, con = entry.queries()[f"{name}_all"](spark, sf).toPandas(), connection(sf)
    steps = [r[0] for r in con.execute("select distinct snapshot_no from imoveis_snapshots where snapshot_no is not null order by 1").fetchall()]
    assert sorted(set(got.snapshot_no)) == steps[1:] and len(steps) > 2
    for a, b in zip(steps, steps[1:]):
        sql = CORE[name].replace("snapshot_no = 2", f"snapshot_no = -{b}").replace("snapshot_no = 1", f"snapshot_no = {a}").replace(f"= -{b}", f"= {b}")
        assert rows(got[got.snapshot_no == b].drop(columns="snapshot_no")) == rows(con.execute(sql).df())
