"""Compare every registered query with its SQL in DuckDB on the same files.

    python -m workload.verify [--sf DIR] [--columns] [--explain DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import pathlib
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def local_session(cpus: int = 8, partitions: int = 8):
    from terralake.session import build_session

    spark = build_session(
        master=f"local[{cpus}]",
        **{
            "spark__ui__enabled": "false",
            "spark__sql__shuffle__partitions": str(partitions),
            "spark__driver__memory": "8g",
            "spark__sql__debug__maxToStringFields": "200",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        if pathlib.Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, bool):
        return value
    if hasattr(value, "as_integer_ratio"):
        number = float(value)
        return int(number) if number.is_integer() else number
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda row: tuple((v is None, str(type(v)), v if not isinstance(v, (int, float)) else float(v)) for v in row)
    return sorted((tuple(canonical(row[i]) for i in order) for row in rows), key=lambda r: str(key(r)))


def close(a, b) -> bool:
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b or abs(a - b) <= 2e-6 * max(1.0, abs(a), abs(b))
    return a == b


def compare(spark_rows, duck_rows) -> str:
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} != {len(duck_rows)}"
    if spark_rows == duck_rows:
        return ""
    differing = [(a, b) for a, b in zip(spark_rows, duck_rows) if a != b]
    loose = all(all(close(x, y) for x, y in zip(a, b)) for a, b in differing)
    return f"{'CLOSE' if loose else 'DIFF'} {len(differing)} of {len(spark_rows)}: {differing[0]}"


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--columns", action="store_true")
    parser.add_argument("--explain")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()

    from workload.catalog import CATALOG, oracle_query, spark_query
    from workload.domain import domain_for

    spark = local_session()
    entries = {n: e for n, e in CATALOG.items() if not args.names or any(n.startswith(p) for p in args.names)}
    if args.columns:
        kinds: dict[str, list[str]] = {"double": [], "date": []}
        for name, entry in entries.items():
            fields = entry.run(domain_for(spark, args.sf)).schema.fields
            for kind, lines in kinds.items():
                names = [f.name for f in fields if f.dataType.simpleString() == kind]
                if names:
                    lines.append(f'    "{name}": "{" ".join(names)}",')
        path = pathlib.Path(__file__).with_name("column_kinds.py")
        text = path.read_text().split("FLOAT_COLUMNS")[0]
        for title, kind in (("FLOAT_COLUMNS", "double"), ("DATE_COLUMNS", "date")):
            body = "\n".join(kinds[kind])
            text += f"{title}: dict[str, str] = {{\n{body}\n}}\n\n"
        path.write_text(text.rstrip() + "\n")
        return
    con = duck(args.sf)
    bad = 0
    for name, entry in entries.items():
        start = time.time()
        try:
            df = spark_query(entry)(spark, args.sf)
            if args.explain:
                text = df._jdf.queryExecution().explainString(
                    spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
                )
                pathlib.Path(args.explain).mkdir(parents=True, exist_ok=True)
                pathlib.Path(f"{args.explain}/{name}.txt").write_text(text)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            spent = time.time() - start
            found = con.execute(oracle_query(entry))
            names = [c[0] for c in found.description]
            want = rows_of(names, found.fetchall())
            problem = compare(got, want) if sorted(names) == sorted(df.columns) else (
                f"columns {sorted(set(names) ^ set(df.columns))}"
            )
        except Exception as error:  # noqa: BLE001 - report and go on
            spent, problem, got = time.time() - start, f"ERROR {str(error)[:500]}", []
        bad += bool(problem)
        print(f"{'ok ' if not problem else 'BAD'} {spent:6.2f}s {len(got):7d} {name} {problem}", flush=True)
    print(f"{len(entries) - bad} of {len(entries)} agree")


if __name__ == "__main__":
    main()
