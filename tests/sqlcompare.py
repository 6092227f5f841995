"""Runs a query and its SQL on the same tables and compares columns and rows."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(df):
    value = lambda x: None if pd.isna(x) else x if isinstance(x, (str, bool)) else round(float(x), 6)
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(value, r)) for r in df[columns].astype(object).values.tolist()), key=repr)


def check(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found, want = rows_of(query(spark, sf_dir).toPandas()), rows_of(con.sql(sql).df())
    assert found[0] == want[0]
    assert found[1] == want[1]
    assert found[1]
