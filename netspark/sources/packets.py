"""Packet tables as batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netspark.schemas import PACKETS


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Packets in any Spark file format; only the columns and rows a query needs are read."""
    return spark.read.format(fmt).schema(PACKETS).options(**options).load(path)


def stream_packets(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Packets as files land in a folder, or from a Kafka topic of JSON packets with ``fmt='kafka'``."""
    if fmt == "kafka":
        from pyspark.sql import functions as F

        raw = spark.readStream.format("kafka").option("subscribe", path).options(**options).load()
        return raw.select(F.from_json(F.col("value").cast("string"), PACKETS).alias("p")).select("p.*")
    return spark.readStream.format(fmt).schema(PACKETS).options(**options).load(path)
