"""The driver contract: every query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from segmentry.oracle import ORACLE
from segmentry.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")


def values(rows, columns):
    def plain(x):
        if x is None or x != x:
            return None
        number = isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_))
        return round(float(x), 6) if number else str(x)

    return sorted(repr([plain(r[c]) for c in columns]) for r in rows)


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, name):
    import duckdb

    frame = QUERIES[name](spark, str(DATA))
    got = [r.asDict() for r in frame.collect()]
    if name not in ORACLE:
        assert got
        return
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.sql(ORACLE[name]).df().astype(object).to_dict("records")
    columns = sorted(frame.columns)
    assert not want or sorted(want[0]) == columns
    assert values(got, columns) == values(want, columns)


def test_entry_point_imports_without_the_corpus_operators(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "segmentry.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLE)
    sys.modules.pop("__spark_entry__", None)
