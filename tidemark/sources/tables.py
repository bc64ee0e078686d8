"""Parquet tables of a data directory.

Only a file scan is declared here; the operators select the columns they need, so
Catalyst prunes the ``ReadSchema`` and pushes filters into the scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    single = os.path.join(sf_dir, f"{name}.parquet")
    return single


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))
