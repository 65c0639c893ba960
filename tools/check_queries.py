"""Run registered queries next to their SQL and report rows, columns, types, values and seconds.

    python tools/check_queries.py SF_DIR [name ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from webtraj.plans.registry import load  # noqa: E402
from webtraj.session import build_session  # noqa: E402


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: repr(float(v)) if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def main(sf_dir: str, names: list[str]) -> int:
    spark = build_session("check", "local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    queries, oracle = load()
    bad = 0
    for name in names or queries:
        begin = time.time()
        try:
            df = queries[name](spark, sf_dir)
            got = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: {str(e)[:700]}", flush=True)
            continue
        spent = time.time() - begin
        if name not in oracle:
            print(f"rows  {name}: {len(got)} rows {spent:.2f}s", flush=True)
            continue
        try:
            cur = con.execute(oracle[name])
            types = {c[0]: str(c[1]) for c in cur.description}
            want = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ORACLE {name}: {str(e)[:700]}", flush=True)
            continue
        gc, gr = canonical(got, df.columns)
        wc, wr = canonical(want, list(types))
        kinds = {c: t for c, t in df.dtypes}
        off = [f"{c}:{kinds[c]}/{types[c]}" for c in gc if c in types and KINDS.get(kinds[c]) != types[c]]
        if gc != wc or gr != wr or off:
            bad += 1
            diff = [(a, b) for a, b in zip(gr, wr) if a != b][:2]
            print(f"DIFF  {name}: cols {gc} / {wc}; rows {len(gr)} / {len(wr)}; types {off}; first {str(diff)[:900]}", flush=True)
        else:
            print(f"ok    {name}: {len(gr)} rows {spent:.2f}s", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
