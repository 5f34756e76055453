"""Every registered rule query against its DuckDB SQL on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from kinespark.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def canonical(rows):
    def cell(x):
        if isinstance(x, bool) or x is None:
            return str(x)
        if isinstance(x, (int, float)) or hasattr(x, "as_tuple"):
            return "nan" if math.isnan(x) else f"{float(x):.9g}"
        return str(x)

    return sorted([tuple(cell(x) for x in r) for r in rows])


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    want = duck.execute(catalogue.ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    expected = canonical([[r[i] for i in order] for r in want.fetchall()])
    assert canonical(got.select(*[f"`{c}`" for c in cols]).collect()) == expected
