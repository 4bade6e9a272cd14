"""Runs registered queries beside their SQL in DuckDB: python tests/compare.py [SF_DIR] [NAME...]."""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])

    def plain(x):
        if isinstance(x, float):
            return round(x, 9) if x else 0.0
        return x

    return [names[k] for k in order], sorted(([plain(r[k]) for k in order] for r in rows), key=repr)


def differs(spark, con, run, sql, sf_dir):
    """None if both give the same rows."""
    df = run(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    theirs = rows_of(names, rel.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} {theirs[0]}"
    if mine[1] != theirs[1]:
        apart = [(a, b) for a, b in zip(mine[1], theirs[1], strict=False) if a != b]
        return f"{len(mine[1])} and {len(theirs[1])} rows, {len(apart)} apart: {apart[:3]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as e
    from rowloom.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = local_session(8, 8), connect(sf)
    oracles, bad = e.oracle_sql(), 0
    for name, run in e.queries().items():
        if args and name not in args:
            continue
        t = time.time()
        try:
            out = differs(spark, con, run, oracles[name], sf) if name in oracles else f"no SQL, {run(spark, sf).count()} rows"
        except Exception as x:  # noqa: BLE001
            out = f"ERROR {str(x)[:600]}"
        bad += bool(out) and name in oracles
        print(f"{time.time() - t:6.1f} {name}: {out or 'equal'}", flush=True)
    print("different:", bad)
