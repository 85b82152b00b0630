"""Holds a Spark result against DuckDB's on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(sf_dir: str = SF):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows(frame) -> list[tuple]:
    names = sorted(frame.columns)

    def plain(x):
        if x is None or x != x:
            return None
        if isinstance(x, (bool,)) or type(x).__name__ == "bool":
            return str(bool(x))
        try:
            return f"{float(x):.9g}" if not isinstance(x, str) else x
        except (TypeError, ValueError):
            return str(x)

    values = frame[names].astype(object).where(frame[names].notna(), None).values.tolist()
    return sorted((tuple(map(plain, r)) for r in values), key=str)


def assert_same(spark_frame, duck_frame) -> None:
    assert sorted(spark_frame.columns) == sorted(duck_frame.columns)
    assert rows(spark_frame) == rows(duck_frame)
