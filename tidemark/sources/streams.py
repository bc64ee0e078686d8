"""Line sources for unbounded input: Kafka topics and sockets.

Both yield a streaming DataFrame with one string column ``value`` that the
``tidemark.sources.text`` parsers accept.  Neither can be exercised in this
repository's tests: the Kafka connector is a separate package that must be on the
cluster's classpath, and sockets need a listening server.  File streams
(``text.read_lines(..., streaming=True)``) are the tested path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_kafka_lines(spark: SparkSession, bootstrap_servers: str, topic: str,
                     starting_offsets: str = "latest", **options: str) -> DataFrame:
    """Kafka topic values as text lines (``value``) plus the record timestamp (``kafka_ts``)."""
    reader = (spark.readStream.format("kafka")
              .option("kafka.bootstrap.servers", bootstrap_servers)
              .option("subscribe", topic)
              .option("startingOffsets", starting_offsets))
    for k, v in options.items():
        reader = reader.option(k, v)
    try:
        df = reader.load()
    except Exception as exc:  # the connector package is missing
        raise RuntimeError("the Kafka source needs the spark-sql-kafka connector on the classpath") from exc
    return df.select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("kafka_ts"))


def read_socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Text lines from a TCP socket (testing only: not fault tolerant)."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()
