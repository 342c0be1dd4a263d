"""Run queries beside their SQL: python tests/check_oracle.py [sf dir] [name ...]"""

import math
import os
import signal
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, query, sql):
    frame = query(spark, folder)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return len(got[1]), None, None
    cursor = con.execute(sql)
    want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    kinds = {c[0]: str(c[1]) for c in con.execute(sql).description}
    if got == want:
        return len(got[1]), True, (dict(frame.dtypes), kinds)
    ours, theirs = set(got[1]), set(want[1])
    only = sorted(ours - theirs)[:4], sorted(theirs - ours)[:4]
    return len(got[1]), False, (got[0], want[0], len(want[1]), *only)


LIMIT = 60  # seconds for one query with its SQL


def late(signum, frame):
    raise TimeoutError(f"over {LIMIT} seconds")


SAME = {"boolean": "BOOLEAN", "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP"}

if __name__ == "__main__":
    import __spark_entry__ as entry
    from gleanbase.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{"spark.ui.enabled": "false", "spark.driver.memory": "12g",
                                               "spark.sql.shuffle.partitions": "8",
                                               "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    signal.signal(signal.SIGALRM, late)
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        signal.alarm(LIMIT)
        try:
            n, same, note = compare(spark, con, folder, query, entry.oracle_sql().get(name))
        except Exception as e:
            print(f"ERROR {name}: {str(e)[:1500]}", flush=True)
            continue
        finally:
            signal.alarm(0)
        took = f"{time.time() - start:.1f}s"
        if same:
            off = {c: (k, note[1][c]) for c, k in note[0].items() if SAME.get(k) != note[1][c]}
            print(f"ok    {name} {n} {took} {off or ''}", flush=True)
        else:
            print(f"{'rows ' if same is None else 'DIFF '} {name} {n} {took} {str(note)[:1500] if note else ''}", flush=True)
