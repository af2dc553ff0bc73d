"""Run a registered query and its SQL side by side and compare rows without regard to order."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    return value


def ordered(columns, rows):
    place = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in place) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((v is not None, str(type(v)), str(v)) for v in r))


KINDS = {
    "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz", "DATE": "date",
}


def differences(df, con, sql) -> list[str]:
    got = df.collect()
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in res.description}
    want = res.fetchall()
    notes = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for field in df.schema.fields:
        if field.dataType.simpleString() != kinds[field.name]:
            notes.append(f"type {field.name}: {field.dataType.simpleString()} != {kinds[field.name]}")
    if len(got) != len(want):
        notes.append(f"rows {len(got)} != {len(want)}")
    if not want:
        notes.append("no rows at all")
    _, a = ordered(df.columns, got)
    _, b = ordered(names, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        notes.append(f"{len(bad)} rows differ, e.g. {str(bad[0][0])[:300]} != {str(bad[0][1])[:300]}")
    return notes


if __name__ == "__main__":
    import __spark_entry__ as entry
    from plumbline.session import local_session

    sf = "/root/testdata/sf" + sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, build in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                notes = differences(build(spark, sf), con, sqls[name])
            else:
                rows = build(spark, sf).count()
                notes = [] if rows else ["no rows"]
        except Exception as error:  # report and go on
            notes = [f"{type(error).__name__}: {str(error)[:900]}"]
        failed += bool(notes)
        print(f"{'ok  ' if not notes else 'FAIL'} {name} {time.time() - start:.2f}s {'' if name in sqls else '(rows only)'}", flush=True)
        for n in notes:
            print("      ", n, flush=True)
    print("failed:", failed)
