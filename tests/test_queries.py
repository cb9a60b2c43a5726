import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from strandloom.plans import registry

NAMES = "customer documents benchmark conversations events lineitem orders supplier".split()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    rel = con.sql(registry.ORACLE_SQL[name])
    want, cols = rel.fetchall(), rel.columns
    df = registry.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(cols)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_flagship(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry_module.queries())


def test_lines_are_gathered_in_parts_of_a_bounded_size(spark, sf_dir, monkeypatch):
    """More lines make more parts, not larger ones, whatever the number of shuffle partitions."""
    monkeypatch.setattr(registry, "GATHERED", 500)
    lines = registry.table(spark, sf_dir, "lineitem").count()
    rows = registry.mapped_orders(spark, sf_dir)
    assert rows.rdd.getNumPartitions() == -(-lines // 500) > 4
    assert rows.count() == registry.table(spark, sf_dir, "orders").count()
