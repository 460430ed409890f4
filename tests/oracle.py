"""Compare registered queries with their SQL twins in DuckDB."""

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (2, "nan" if isinstance(value, float) and math.isnan(value) else repr(value))
    return (3, str(value))


def compare(spark, con, build, sql, folder):
    """Return an empty string when rows, column names and values agree, else what differs."""
    df = build(spark, folder)
    names = sorted(df.columns)
    mine = sorted([tuple(_key(r[n]) for n in names) for r in df.collect()])
    rel = con.execute(sql)
    got = [d[0] for d in rel.description]
    if sorted(got) != names:
        return f"columns {names} against {sorted(got)}"
    order = [got.index(n) for n in names]
    theirs = sorted([tuple(_key(r[i]) for i in order) for r in rel.fetchall()])
    if len(mine) != len(theirs):
        return f"rows {len(mine)} against {len(theirs)}"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(mine)} rows differ, columns {names}: {wrong[0][0]} against {wrong[0][1]}"
    if not mine:
        return "no rows"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from spindleflow.session import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("local[8]", 8, **{"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            if name in sqls:
                verdict = compare(spark, con, build, sqls[name], folder) or "ok"
            else:
                verdict = f"rows {build(spark, folder).count()}"
        except Exception as error:  # report and go on
            verdict = "ERROR " + str(error)[:1500]
        bad += verdict != "ok" and not verdict.startswith("rows ") or " against " in verdict
        print(f"{name:32s} {time.time() - began:6.2f}s {verdict}", flush=True)
    print("bad:", bad)
