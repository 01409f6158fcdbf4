"""Queries that SQL can express, over whole tables."""

import pytest

from tallyforge.llm import registry

from ..test_queries import connection, same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_against_sql(spark, sf_dir, name):
    same(registry.QUERIES[name](spark, sf_dir), connection(sf_dir), registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - {"pipeline"}))
def test_other_queries_give_every_row(spark, sf_dir, name):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert registry.QUERIES[name](spark, sf_dir).count() == (2 * rows if name == "op3_pieces" else rows)


def test_all_are_registered():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in registry.QUERIES if k != "pipeline"}
