"""Run the registered queries against their SQL answers:

    python tests/parity.py /root/testdata/sf0.01 [names...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6f}"
    return str(v)


#: Types of both engines under one name; DuckDB sums whole numbers as HUGEINT.
SAME = {"bigint": "whole", "BIGINT": "whole", "HUGEINT": "whole", "int": "int", "INTEGER": "int", "string": "text", "VARCHAR": "text",
        "double": "double", "DOUBLE": "double", "boolean": "boolean", "BOOLEAN": "boolean"}


def rows_of(columns, types, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [(columns[i], SAME.get(str(types[i]), str(types[i]))) for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, query, sql):
    df = query(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, f"{name} compares all pairs"
    got = rows_of(df.columns, [t for _, t in df.dtypes], [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], [d[1] for d in cur.description], cur.fetchall())
    return got, want


def main():
    sf_dir, names = sys.argv[1], sys.argv[2:]
    from conftest import make_session
    spark, con = make_session(), connect(sf_dir)
    queries, answers = entry.queries(), entry.oracle_sql()
    bad = []
    for name in names or list(queries):
        if name not in answers:
            print(f"{name:28s} no SQL answer")
            continue
        start = time.time()
        try:
            got, want = compare(spark, con, sf_dir, name, queries[name], answers[name])
        except Exception as error:
            bad.append(name)
            print(f"{name:28s} ERROR {str(error)[:600]}", flush=True)
            continue
        same = got == want
        print(f"{name:28s} {'ok' if same else 'DIFFERENT'} rows={len(got[1])}/{len(want[1])} {time.time() - start:.1f}s", flush=True)
        if not same:
            bad.append(name)
            a, b = set(got[1]), set(want[1])
            print("   columns", got[0], want[0])
            print("   spark only", len(a - b), [tuple(c[:80] for c in r) for r in sorted(a - b)[:3]])
            print("   sql only  ", len(b - a), [tuple(c[:80] for c in r) for r in sorted(b - a)[:3]], flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
