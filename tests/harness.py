"""Run queries against their SQL twins, the way the correctness gate does."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


DUCK_TYPES = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def compare(spark, con, sf_dir, name, fn, sql):
    """None when equal, else a short account of the difference."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}"
    bad = {c: (t, kinds[c]) for c, t in df.dtypes if DUCK_TYPES.get(kinds[c], kinds[c]) != t}
    if bad:
        return f"types {bad}"
    if not want:
        return "twin has no rows"
    if got != want:
        gs, ws = set(got), set(want)
        only_got = [r for r in got if r not in ws][:3]
        only_want = [r for r in want if r not in gs][:3]
        return f"{len(got)} vs {len(want)} rows; columns {sorted(cols)}\n   spark {only_got}\n   sql   {only_want}"
    return None


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from traceloom.session import build_session

    sf = argv[0]
    want = argv[1:]
    spark = build_session("harness", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                   "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if want and not any(name.startswith(w) for w in want):
            continue
        t = time.time()
        try:
            res = compare(spark, con, sf, name, fn, sqls.get(name))
        except Exception as ex:  # noqa: BLE001 - report and go on
            res = f"{type(ex).__name__}: {str(ex)[:900]}"
        failed += res is not None
        print(f"{'ok  ' if res is None else 'FAIL'} {name} {time.time() - t:.1f}s{'' if name in sqls else ' (rows only)'}"
              f"{'' if res is None else chr(10) + '   ' + res}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
