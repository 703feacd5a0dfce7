"""python tools/compare.py FOLDER [NAME...]: each query beside its SQL on DuckDB; prints what differs."""

import importlib.util
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from tidemill.session import build_session  # noqa: E402


def rows(frame) -> list[tuple]:
    """Rows in a comparable form: columns by name, floats rounded, NaN and NULL alike."""

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return ""
        if isinstance(v, float):
            return f"{v:.6g}"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        return str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None))


def main(folder: str, names: list[str]) -> int:
    spec = importlib.util.spec_from_file_location("entry", ROOT / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    con.sql("SET TimeZone='UTC'")
    queries, sql, bad = entry.queries(), entry.oracle_sql(), 0
    for name in names or queries:
        if name not in queries:
            name = next(q for q in queries if q.startswith(name))
        began = time.time()
        try:
            mine = queries[name](spark, folder).toPandas()
            took = time.time() - began
            if name not in sql:
                print(f"{name}: {len(mine)} rows, {took:.1f} s, no SQL", flush=True)
                continue
            theirs = con.sql(sql[name]).df()
            a, b = rows(mine), rows(theirs)
            same = sorted(mine.columns) == sorted(theirs.columns) and a == b
            print(f"{name}: {'equal' if same else 'DIFFERENT'}, {len(a)} and {len(b)} rows, {took:.1f} s", flush=True)
            if not same:
                bad += 1
                print("   columns", sorted(mine.columns), sorted(theirs.columns))
                only_a, only_b = set(a) - set(b), set(b) - set(a)
                print("   only Spark:", *list(only_a)[:3], "\n   only SQL:", *list(only_b)[:3], sep="\n      ")
            for (ca, ta), cb in zip(sorted(mine.dtypes.items()), sorted(theirs.dtypes.items())):
                if str(ta)[:5] != str(cb[1])[:5]:
                    print(f"   type of {ca}: {ta} and {cb[1]}")
        except Exception as e:
            bad += 1
            print(f"{name}: FAILED {type(e).__name__} {str(e)[:1500]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
