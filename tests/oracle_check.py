"""Run registered queries against their SQL twins: python tests/oracle_check.py [folder] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from callweave.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def show(v):
        if isinstance(v, float):
            return repr(0.0 if v == 0 else v)
        return repr(v)

    return sorted("|".join(show(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = entry.queries()[name](spark, folder)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    text = entry.oracle_sql().get(name)
    if text is None:
        return True, f"rows only: {len(got)} ({took:.1f}s)"
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = canonical(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    plain = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN"}
    odd = {n: (t, types[n]) for n, t in df.dtypes if plain.get(t) != types[n]}
    note = f" types differ: {odd}" if odd else ""
    if got == want:
        return not odd, f"{len(got)} rows ({took:.1f}s){note}"
    missing, extra = sorted(set(want) - set(got)), sorted(set(got) - set(want))
    return False, f"{len(got)} vs {len(want)} rows, {len(missing)} missing {missing[:2]} extra {extra[:2]}{note}"


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session(
        "oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        try:
            good, note = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001
            good, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not good
        print("ok  " if good else "FAIL", name, note, flush=True)
    print(f"{len(names) - bad} of {len(names)} good")


if __name__ == "__main__":
    main()
