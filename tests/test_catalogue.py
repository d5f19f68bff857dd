"""Every query against its SQL on the smallest tables; the entry with and without the optional subpackage."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from wordloom.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(columns).collect()), key=str)
    sql = catalogue.oracle_sql()[name]
    want = sorted(duck.execute(f"select {', '.join(columns)} from ({sql})").fetchall(), key=str)
    assert len(got) == len(want)
    assert all(all(close(x, y) for x, y in zip(a, b, strict=True)) for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_gives_rows(spark, name):
    assert catalogue.queries()[name](spark, str(DATA)).count() > 0


def test_entry_without_the_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("wordloom.llm", "corpus_pipeline")):
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 40 and not any(k.startswith("op") and k[2].isdigit() for k in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True)
