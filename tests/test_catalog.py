"""The catalog against DuckDB on the smallest tables, and without the optional subpackage."""

import math
import os
import subprocess
import sys

import pytest

from loclake.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    ours = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    got = con.execute(catalog.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted(tuple(_plain(r[i]) for i in at) for r in got.fetchall())
    assert ours == theirs


def test_imports_without_the_optional_subpackage(tmp_path):
    code = (
        "import sys\n"
        "class No:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('loclake.llm'): raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import loclake.plans.catalog, loclake.sources.binary, loclake.operators.fuzzy\n"
        "assert not any(m.startswith('loclake.llm') for m in sys.modules)\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(__file__)))
