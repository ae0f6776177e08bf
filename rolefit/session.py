"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # run-time choice of join strategy, partition sizes and splitting of skewed partitions, also where the split costs
    # another shuffle behind the join
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # text and pair work is heavy for its bytes: smaller splits than the default, and small shuffles keep to all cores
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.files.maxPartitionBytes": str(64 << 20),
    # state of the streaming jobs lives outside the JVM heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
