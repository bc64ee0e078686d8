import os
import sys

from conftest import ROOT, SF_SMALL

sys.path.insert(0, ROOT)
import __spark_entry__ as entry  # noqa: E402


def test_registry_consistent():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert len(qs) >= 55
    assert set(sql) <= set(qs)
    # The optional training-data queries (op*, pipeline) are tested against brute force instead.
    no_oracle = sorted(set(entry.catalog.QUERIES) - set(sql))
    assert no_oracle == []


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"window_start", "window_end", "item_id", "cnt", "rank"}
    assert max(r["rank"] for r in rows) <= 3


def test_every_query_plans(spark):
    # Building each DataFrame resolves its plan.
    for name, fn in entry.queries().items():
        # Building a stream_* query runs it; tests/test_streaming.py and the oracle check do that.
        if name not in entry.catalog.QUERIES or name.startswith("stream_"):
            continue
        df = fn(spark, SF_SMALL)
        assert df.columns, name
