"""Run registered queries beside their SQL in DuckDB and compare columns and rows, order aside."""

import argparse
import math
import time
from collections import Counter
from datetime import date, datetime
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, (str, bytes, date, datetime)):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else int(value) if value.is_integer() else float(f"{value:.10g}")
    return int(value) if isinstance(value, int) else str(value)


def _rows(names: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, build, sql: str | None) -> tuple[bool, str]:
    frame = build(spark, sf_dir)
    collected = frame.collect()
    if sql is None:
        return len(collected) > 0, f"{len(collected)} rows, no SQL"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    ours, theirs = _rows(frame.columns, collected), _rows(names, result.fetchall())
    if ours[0] != theirs[0]:
        return False, f"columns {ours[0]} != {theirs[0]}"
    if ours[1] != theirs[1]:
        extra, missing = ours[1] - theirs[1], theirs[1] - ours[1]
        return False, (
            f"{sum(ours[1].values())} rows against {sum(theirs[1].values())}; only ours {list(extra)[:2]}, "
            f"only SQL {list(missing)[:2]}"
        )
    return bool(collected), f"{len(collected)} rows"


def main() -> None:
    import sys

    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from conftest import session

    import __spark_entry__ as entry

    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.001")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, con, failed = session(), connect(sf_dir), []
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in queries:
        if args.names and not any(name.startswith(wanted) for wanted in args.names):
            continue
        start = time.time()
        try:
            good, note = compare(spark, con, sf_dir, queries[name], oracles.get(name))
        except Exception as error:  # noqa: BLE001 - the report goes on with the next query
            good, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{'ok  ' if good else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
        if not good:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
