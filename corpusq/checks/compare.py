"""Run registered queries beside their SQL oracle and report differences.

    python -m corpusq.checks.compare [sf_dir] [name ...]
"""

import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def oracle_connection(sf_dir):
    import duckdb
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def compare(spark, con, sf_dir, query, sql):
    """(status, detail, seconds, rows)"""
    start = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    seconds = time.time() - start
    if sql is None:
        return ("rows", "", seconds, len(got))
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return ("SCHEMA", f"{sorted(df.columns)} vs {sorted(names)}", seconds, len(got))
    a, b = _rows(df.columns, got), _rows(names, want)
    if len(a) != len(b):
        only = [x for x in a if x not in set(b)][:1], [x for x in b if x not in set(a)][:1]
        return ("COUNT", f"{len(a)} vs {len(b)} {str(only)[:1500]}", seconds, len(got))
    for x, y in zip(a, b):
        if x != y or [type(v) for v in x] != [type(v) for v in y]:
            names = sorted(df.columns)
            diff = [(n, str(v)[:300], str(w)[:300]) for n, v, w in zip(names, x, y) if v != w or type(v) is not type(w)]
            return ("VALUE", f"{diff} row {str(x)[:300]}", seconds, len(got))
    return ("ok", "", seconds, len(got))


def main(argv):
    from corpusq.checks import registry
    from corpusq.session import build_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = build_session(**{"spark.master": "local[8]", "spark.ui.enabled": "false",
                             "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                             "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    queries, oracles = registry.queries(), registry.oracle_sql()
    chosen = [n for n in queries if not names or any(n == p or (p.endswith("*") and n.startswith(p[:-1]))
                                                      for p in names)]
    bad = 0
    for name in chosen:
        try:
            status, detail, seconds, rows = compare(spark, con, sf_dir, queries[name], oracles.get(name))
        except Exception as error:  # report and go on with the next query
            status, detail, seconds, rows = "ERROR", str(error)[:1500], 0.0, 0
        bad += status not in ("ok", "rows")
        print(f"{status:7s} {name:32s} {seconds:6.2f}s rows={rows} {detail}", flush=True)
    print(f"{len(chosen)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
