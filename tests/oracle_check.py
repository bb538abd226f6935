"""Run registered queries and their SQL side by side: ``python tests/oracle_check.py [prefix ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
import warnings

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

warnings.filterwarnings("ignore")

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_cell(v[k])}" for k in v) + "}"
    return repr(v)


def rows_of(table):
    table = table.select(sorted(table.column_names))
    data = [table.column(c).to_pylist() for c in table.column_names]
    return table.column_names, [str(f.type) for f in table.schema], sorted(
        tuple(_cell(v) for v in r) for r in zip(*data)
    )


def compare(spark_table, duck_table) -> str:
    sn, st, sr = rows_of(spark_table)
    dn, dt, dr = rows_of(duck_table)
    norm = lambda t: t.replace("large_", "").replace("[us, tz=Etc/UTC]", "[us]").replace("[us, tz=UTC]", "[us]")
    if sn != dn:
        return f"columns {sn} != {dn}"
    if [norm(t) for t in st] != [norm(t) for t in dt]:
        return f"types {list(zip(sn, st, dt))}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} != {len(dr)}\n  spark {sr[:3]}\n  duck  {dr[:3]}"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        return f"{len(bad)} of {len(sr)} rows differ; {sn}\n  " + "\n  ".join(f"{a}\n  {b}" for a, b in bad[:3])
    return ""


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    oracles = entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if argv and not any(name == p or name.startswith(p) for p in argv):
            continue
        start = time.time()
        try:
            got = fn(spark, sf_dir).toArrow()
            took = time.time() - start
            if name in oracles:
                begun = time.time()
                want = con.execute(oracles[name]).to_arrow_table()
                problem = compare(got, want)
                kind = f"sql {time.time() - begun:.1f}s"
            else:
                problem, kind = ("" if got.num_rows else "no rows"), "rows only"
        except Exception as exc:  # report and go on with the next query
            problem, kind, took, got = f"{type(exc).__name__}: {str(exc)[:700]}", "error", time.time() - start, None
        print(f"{'FAIL' if problem else 'ok  '} {name} {took:.1f}s {kind} rows={got.num_rows if got is not None else '-'} {problem}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
