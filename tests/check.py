"""Compare queries with their SQL: ``python tests/check.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import tempfile
import threading
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def normal(rows, names) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else v + 0.0
        return v

    def place(row):
        return repr([round(v, 4) if isinstance(v, float) else v for v in row])

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=lambda r: (place(r), repr(r)))


def same(x: tuple, y: tuple, slack: float) -> bool:
    return all(
        a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= slack)
        for a, b in zip(x, y)
    )


def differences(spark_rows, spark_names, sql_rows, sql_names, slack: float = 0.0) -> str | None:
    """None when both hold the same rows under the same column names. Values are rounded to
    six places on both sides; ``slack`` admits a value that lies halfway between two."""
    if sorted(spark_names) != sorted(sql_names):
        return f"columns {sorted(spark_names)} and {sorted(sql_names)}"
    a, b = normal(spark_rows, spark_names), normal(sql_rows, sql_names)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    odd = [(x, y) for x, y in zip(a, b) if not same(x, y, slack)]
    return f"{len(odd)} of {len(a)} rows differ, e.g. {odd[0]}" if odd else None


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="cellweave-check-"))
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = contract.queries(), contract.oracle_sql()
    con = database(sf_dir)
    bad = []
    for name in sys.argv[2:] or queries:
        begin = time.time()
        try:
            df = queries[name](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - begin
            verdict = f"{len(rows)} rows"
            if name in oracles:
                begin = time.time()
                timer = threading.Timer(60, con.interrupt)
                timer.start()
                result = con.execute(oracles[name])
                timer.cancel()
                names = [c[0] for c in result.description]
                found = differences(rows, df.columns, result.fetchall(), names)
                verdict = found or f"equal, {len(rows)} rows, sql {time.time() - begin:.1f}s"
                if found:
                    bad.append(name)
        except Exception as error:  # report and go on with the next query
            took, verdict = time.time() - begin, f"{type(error).__name__}: {str(error)[:600]}"
            bad.append(name)
        print(f"{name:28s} {took:6.2f}s  {verdict}", flush=True)
    print("FAILED:", bad)


if __name__ == "__main__":
    main()
