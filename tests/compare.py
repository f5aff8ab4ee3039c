"""Run registered queries beside their SQL: python tests/compare.py SF_DIR [NAME...]."""

import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings projects runs findings evidence scanner_results finding_exports cwe_catalog"


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES.split():
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    began = time.time()
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    took = time.time() - began
    if not sql:
        return None, f"{sum(mine.values())} rows, {took:.1f} s, no SQL"
    began = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    sql_took = time.time() - began
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(names)}"
    if mine != theirs:
        return False, f"{sum(mine.values())} rows against {sum(theirs.values())}; only mine {list((mine - theirs).items())[:3]}; only SQL {list((theirs - mine).items())[:3]}"
    return True, f"{sum(mine.values())} rows, {took:.1f} s, SQL {sql_took:.1f} s"


if __name__ == "__main__":
    import __spark_entry__ as entry

    from tracequarry.session import local_session

    spark, con = local_session("8", 8), connect(sys.argv[1])
    sql, queries = entry.oracle_sql(), entry.queries()
    wanted = sys.argv[2:]
    names = [n for n in queries if not wanted or any(n.startswith(w) for w in wanted)]
    for name in names:
        try:
            good, said = compare(spark, con, name, queries[name], sql.get(name), sys.argv[1])
        except Exception as e:
            good, said = False, repr(e)[:600]
        print({True: "ok  ", False: "BAD ", None: "rows"}[good], name, said[:1500], flush=True)
