"""Each query against its DuckDB form on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tidemark.plans import oracle, queries

TABLES = "events orders lineitem documents pages labels".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list:
    def plain(x):
        if x is None or pd.isna(x):
            return None
        x = x.item() if hasattr(x, "item") else x
        return round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    columns = sorted(df.columns)
    return [columns, sorted(repr([plain(x) for x in row]) for row in df[columns].astype(object).itertuples(index=False))]


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_equals_oracle(spark, sf, duck, name):
    assert canonical(queries.QUERIES[name](spark, sf).toPandas()) == canonical(duck.execute(oracle.ORACLE[name]).df())
