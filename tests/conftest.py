import datetime as dt
import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import build_session
    s = build_session("local[4]", 4, app_name="tidemark-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tm-ckpt-")})
    yield s
    s.stop()


def epoch(ts: dt.datetime) -> int:
    """Seconds since the epoch of a naive (UTC wall-clock) datetime."""
    return int((ts - dt.datetime(1970, 1, 1)).total_seconds())


def ntz(sec: int) -> dt.datetime:
    return dt.datetime(1970, 1, 1) + dt.timedelta(seconds=sec)


def frame(spark, rows, schema):
    """DataFrame whose epoch-second column ``ts`` becomes timestamp_ntz."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, schema)
    if "ts" in df.columns and dict(df.dtypes)["ts"] in ("bigint", "int"):
        df = df.withColumn("ts", F.timestamp_add("SECOND", F.col("ts"),
                                                 F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")))
    return df
