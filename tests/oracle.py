"""Compare registered queries with their SQL text on DuckDB."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if hasattr(v, "isoformat"):
        text = v.isoformat()
        return text[:10] if text[10:] in ("", "T00:00:00") else text
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    body = [tuple(canon(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(body, key=repr)


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want = table([d[0] for d in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        g, w = bad[0]
        diff = [(n, a, b) for n, a, b in zip(got[0], g, w) if a != b]
        return f"{len(bad)}/{len(got[1])} rows differ, e.g. {g[:3]} {diff[:4]}"
    types = {type(x).__name__ for r in got[1] for x in r}
    nulls = sum(x is None for r in got[1] for x in r)
    return None if got[1] else f"empty ({types}, {nulls})"


def main():
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from barloom.plans.session import local_session

    sf = next((a[3:] for a in sys.argv[1:] if a.startswith("sf=")), "0.01")
    names = [a for a in sys.argv[1:] if not a.startswith("sf=")]
    spark = local_session()
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    picked = [q for q in queries if not names or any(n in q for n in names)]
    failed = 0
    for name in picked:
        t = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, queries[name], oracles[name], sf_dir)
                kind = "oracle"
            else:
                rows = queries[name](spark, sf_dir).collect()
                problem, kind = (None, f"rows={len(rows)}") if rows else ("no rows", "rows")
        except Exception as e:
            problem, kind = f"{type(e).__name__}: {str(e)[:1500]}", "error"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:34s} {kind:10s} {time.time() - t:6.2f}s {problem or ''}", flush=True)
    print(f"{len(picked) - failed}/{len(picked)} passed")


if __name__ == "__main__":
    main()
