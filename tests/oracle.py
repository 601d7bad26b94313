"""Compares queries with their SQL in DuckDB, as sets of rows."""

import os

import duckdb


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in found), key=str)


def connect(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    said = connect(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(said.columns)
    assert rows(df.columns, df.collect()) == rows(said.columns, said.fetchall())
