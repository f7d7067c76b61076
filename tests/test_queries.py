"""Every registered query against its SQL (DuckDB) on the smallest tables."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "scripts"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import TABLES, digest  # noqa: E402
from pairlens.plans.catalog import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["rank", "latent", "diff", "v_chosen", "v_rejected"]
    assert df.count() >= 0


def test_every_pipeline_query_has_sql():
    assert set(QUERIES) <= set(SQL) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(dcols, drows)[0]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The tables with one document less: the last pair has a chosen side only."""
    folder = str(tmp_path_factory.mktemp("odd"))
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            os.symlink(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
    os.remove(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    last = docs.agg({"doc_id": "max"}).first()[0]
    docs.filter(docs.doc_id < last).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return folder, con


@pytest.mark.parametrize("name", ["line_pairs", "dataset_scan", "dataset_rows", "pair_scores", "segment_counts"])
def test_a_pair_with_one_side(spark, odd, name):
    df = E.queries()[name](spark, odd[0])
    rows = [tuple(r) for r in df.collect()]
    cur = odd[1].execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert len(rows) == len(drows) and digest(df.columns, rows)[0] == digest(dcols, drows)[0]
    n = len({r[df.columns.index("pair_id")] for r in rows})
    assert n == odd[1].execute("SELECT count(*) FROM documents").fetchone()[0] // 2 + (name not in ("dataset_scan", "dataset_rows"))
