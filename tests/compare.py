"""Rows of a Spark and a DuckDB query in one comparable form."""

from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, (bytes, bytearray, memoryview)):
        return bytes(x).hex()
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(repr([plain(v[i]) for i in order]) for v in values)


def of_spark(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def of_duckdb(sql, folder):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(sql)
    return rows([d[0] for d in found.description], found.fetchall())
