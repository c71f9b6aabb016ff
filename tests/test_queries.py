"""Every query with a SQL twin against DuckDB, on the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from dossier.plans import archive_queries as _archive_queries  # noqa: F401  registers
from dossier.plans import more_queries as _more  # noqa: F401  registers
from dossier.plans import queries as _queries  # noqa: F401  registers
from dossier.plans import registry
from dossier.plans import stream_queries as _stream_queries  # noqa: F401  registers


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf_dir, db):
    found = registry.QUERIES[name](spark, sf_dir)
    names = sorted(found.columns)
    rows = sorted(tuple(map(plain, r)) for r in found.select(*names).collect())
    if name in registry.ORACLE:
        other = db.sql(registry.ORACLE[name])
        assert sorted(other.columns) == names
        assert sorted(tuple(plain(r[other.columns.index(c)]) for c in names) for r in other.fetchall()) == rows
