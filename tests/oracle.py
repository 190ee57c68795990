"""Runs a registered query and its SQL on the same tables."""

from collections import Counter
from pathlib import Path

import duckdb

import __spark_entry__

SF_DIR = "/root/testdata/sf0.001"


def _plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


def compare(spark, name, sf_dir=SF_DIR):
    """Same columns, same rows, order aside."""
    frame = __spark_entry__.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = Counter(tuple(_plain(r[c]) for c in columns) for r in frame.collect())
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    told = db.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(told.columns) == columns
    places = [told.columns.index(c) for c in columns]
    expected = Counter(tuple(_plain(row[i]) for i in places) for row in told.fetchall())
    assert got == expected
