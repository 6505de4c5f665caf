"""Run queries next to their SQL twins: ``python tools/check.py [sf] [name-regex]``."""

import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb
import numpy as np
import pandas as pd

from tidemark.plans import REGISTRY
from tidemark.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        col = pdf[c]
        if str(col.dtype).startswith("datetime"):
            pdf[c] = col.astype("datetime64[us]").astype(str)
        elif col.dtype == object:
            first = col.dropna().head(1)
            kind = type(first.iloc[0]).__name__ if len(first) else "none"
            if kind == "Decimal":
                pdf[c] = col.astype(float)
            elif kind == "date":
                pdf[c] = pd.to_datetime(col).astype(str)
            else:
                pdf[c] = col.map(lambda v: None if v is None else (str(list(v)) if isinstance(v, (list, np.ndarray)) else v))
    return pdf


def compare(mine: pd.DataFrame, theirs: pd.DataFrame) -> str:
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"COLUMNS {sorted(mine.columns)} vs {sorted(theirs.columns)}"
    if len(mine) != len(theirs):
        return f"ROWS {len(mine)} vs {len(theirs)}"
    a, b = canonical(mine), canonical(theirs)
    kinds = [(c, a[c].dtype.kind, b[c].dtype.kind) for c in a.columns if a[c].dtype.kind != b[c].dtype.kind and a[c].notna().any()]
    order = list(a.columns)
    key = lambda d: d.assign(**{c: d[c].map(lambda v: "~" if v is None or v != v else (f"{v:.6g}" if isinstance(v, float) else str(v))) for c in order}).sort_values(order).index
    a, b = a.loc[key(a)].reset_index(drop=True), b.loc[key(b)].reset_index(drop=True)
    worst, exact = "", True
    for c in order:
        x, y = a[c], b[c]
        if x.dtype.kind in "fiu" and y.dtype.kind in "fiu":
            same = np.isclose(x.astype(float), y.astype(float), rtol=1e-9, atol=1e-9, equal_nan=True)
            exact &= bool(((x.astype(float) == y.astype(float)) | (x.isna() & y.isna())).all())
        else:
            same = ((x.astype(object) == y.astype(object)) | (x.isna() & y.isna())).to_numpy()
        if not same.all():
            i = int(np.argmin(same))
            worst += f" {c}: {len(same) - int(same.sum())} differ, e.g. {x[i]!r} vs {y[i]!r};"
    if worst:
        return "VALUES" + worst
    return ("ok" if exact else "ok~") + (f" KINDS {kinds}" if kinds else "")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    pattern = re.compile(sys.argv[2] if len(sys.argv) > 2 else ".")
    folder = f"/root/testdata/sf{sf}"
    os.environ["PYSPARK_SUBMIT_ARGS"] = "--conf spark.ui.showConsoleProgress=false --driver-memory 12g pyspark-shell"
    spark = build_session("local[8]", partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, q in REGISTRY.items():
        if not (pattern.search(name) or pattern.search(q.family + ":")):
            continue
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        started = time.time()
        try:
            mine = q(spark, folder).toPandas()
            took = time.time() - started
            started = time.time()
            verdict = compare(mine, con.execute(q.sql).df()) if q.sql else "rows-only"
            sql_took = time.time() - started
        except Exception as e:  # noqa: BLE001
            verdict, took, mine, sql_took = "ERROR " + str(e)[:700], time.time() - started, [], 0
        bad += not verdict.startswith(("ok", "rows-only"))
        print(f"{name:36s} {took:6.2f}s sql {sql_took:5.2f}s {len(mine):7d} rows  {verdict}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
