"""Results of Spark and DuckDB as comparable sets of rows."""

import decimal
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value) -> str:
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else f"{float(value):.6g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


def rows_of_spark(df) -> tuple[list[str], list[str]]:
    names = sorted(df.columns)
    return names, sorted("|".join(plain(r[n]) for n in names) for r in df.collect())


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows_of_duck(con, sql: str) -> tuple[list[str], list[str]]:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(names)
    return order, sorted("|".join(plain(r[names.index(n)]) for n in order) for r in found.fetchall())
