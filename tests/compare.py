"""Compare queries with their DuckDB SQL: ``python tests/compare.py FOLDER [NAME...]``, a line for each query."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.10g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(_value(v) for v in x)
    return float(x) if type(x).__name__ == "Decimal" else x


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def difference(query, sql: str, spark, sf_dir: str) -> str:
    """An empty string if the query gives the rows of the SQL, else how they differ."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    base = duckdb.connect()
    for name in TABLES:
        base.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    found = base.sql(sql)
    want = rows_of(found.columns, found.fetchall())
    if sorted(df.columns) != sorted(found.columns):
        return f"columns {df.columns} and {found.columns}"
    if got == want:
        return "" if got else "no rows"
    left, right = set(map(repr, got)) - set(map(repr, want)), set(map(repr, want)) - set(map(repr, got))
    return f"{len(got)} and {len(want)} rows; only here {sorted(left)[:2]}; only there {sorted(right)[:2]}"


def main() -> None:
    import __spark_entry__ as entry
    from lattica.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = [n for n in queries if any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in sys.argv[2:])] if sys.argv[2:] else [n for n in queries if n in oracles]
    for name in wanted:
        start = time.time()
        try:
            if name in oracles:
                said = difference(queries[name], oracles[name], spark, sys.argv[1]) or "agrees"
            else:
                said = f"no SQL, {queries[name](spark, sys.argv[1]).count()} rows"
        except Exception as error:
            said = f"ERROR {str(error)[:600]}"
        print(f"{name}: {said} ({time.time() - start:.1f} s)", flush=True)


if __name__ == "__main__":
    main()
