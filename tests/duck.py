"""Rows of a Spark query beside the rows of its DuckDB SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def tidy(rows, columns, order):
    at = [columns.index(c) for c in order]
    plain = [tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in rows]
    return sorted(plain, key=lambda r: tuple((x is None, str(x)) for x in r))


def same(df, sql: str, sf_dir: str) -> None:
    names, want = rows_of_sql(sql, sf_dir)
    order = sorted(df.columns)
    assert order == sorted(names)
    assert tidy([tuple(r) for r in df.collect()], df.columns, order) == tidy(want, names, order)
