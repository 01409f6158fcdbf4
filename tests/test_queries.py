import math

import duckdb
import pytest

from tallyforge.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else v


def same(df, con, sql):
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    rows = con.execute(sql)
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in rows.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_against_sql(spark, sf_dir, name):
    same(catalog.QUERIES[name](spark, sf_dir), connection(sf_dir), catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_other_queries_run(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_import_without_the_training_data_operators(tmp_path):
    """The entry file and the rest work where that subpackage is gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "tallyforge", tmp_path / "tallyforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'risk_scores' in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_tasks_of_heavy_rows_stay_of_one_size(spark, tmp_path, monkeypatch):
    """A small file of many rows is dealt to more tasks than cores, so the longest one doesn't grow with the table."""
    from tallyforge.plans import catalog

    spark.range(0, 10_000, 1, 1).write.parquet(str(tmp_path / "keys"))
    keys = spark.read.parquet(str(tmp_path / "keys"))
    cores = spark.sparkContext.defaultParallelism
    assert catalog._spread(keys).rdd.getNumPartitions() == cores
    monkeypatch.setattr(catalog, "SPREAD", 500)
    dealt = catalog._spread(keys)
    sizes = dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == 20 > cores and max(sizes) <= 600 and sum(sizes) == 10_000
    wide = spark.range(0, 10_000, 1, 32)
    assert catalog._spread(wide).rdd.getNumPartitions() == 32
