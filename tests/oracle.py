"""Runs a query and its SQL on the same tables and compares rows."""

import os

import duckdb


def views(sf_dir):
    con = duckdb.connect()
    con.sql("set threads=4")
    for n in os.listdir(sf_dir):
        path = f"{sf_dir}/{n}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{n}") else "")
        con.sql(f"create view {n[:-8]} as select * from '{path}'")
    return con


def differences(spark, sf_dir, query, sql, out):
    query(spark, sf_dir).write.mode("overwrite").parquet(out)
    con = views(sf_dir)
    con.sql(f"create table want as {sql}")
    got = f"'{out}/*.parquet'"
    names = sorted(c[0] for c in con.sql("describe want").fetchall())
    assert names == sorted(c[0] for c in con.sql(f"describe select * from {got}").fetchall())
    c = ", ".join(f'"{x}"' for x in names)
    return [con.sql(f"select count(*) from (select {c} from {a} except all select {c} from {b})").fetchall()[0][0] for a, b in ((got, "want"), ("want", got))]
