"""Window detectors over a stream of new flows whose rows may come late and out of order.

Flows wait in Spark's state, dealt by (time bucket, salt): a bucket is one window wide, and the salt comes from the flow,
so a hot source or a burst spreads over all salts. When the watermark passes a bucket's end its timer hands the bucket on to
be checked, and one bucket later a second timer hands it on once more as what the next bucket's windows can see, and
the state is gone. All salts have the same timers, so a bucket comes out of the state whole, in one micro-batch; there
the batch operators run on it, distributed and exact. Every flow is checked once, after all that its window can hold has arrived.

Flows that come after their bucket has closed are dropped by the watermark and counted in the query's progress.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from netspark.session import stage

# detect(new_flows, checks) -> results
Detector = Callable[[DataFrame, DataFrame], DataFrame]

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries that are started inside keep their state in RocksDB, on disk and in changelogs, rather than on the heap."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class Buckets(StatefulProcessor):
    """The flows of one (bucket, salt), handed on when the bucket closes and when the next one does."""

    def __init__(self, schema: StructType, width_us: int):
        self.schema, self.width_us = schema, width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flows = handle.getListState("flows", self.schema)

    def _closes(self, bucket: int, after: int) -> int:
        """When the watermark (ms) has passed the end of the bucket `after` buckets later."""
        return -(-(bucket + 1 + after) * self.width_us // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            plain = frame[self.schema.names].astype(object)
            self.flows.appendList(list(plain.where(plain.notna(), None).itertuples(index=False, name=None)))
        # Registering a timer again changes nothing.
        for after in (0, 1):
            self.handle.registerTimer(self._closes(int(key[0]), after))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bucket = int(key[0])
        check = expiredTimerInfo.getExpiryTimeInMs() == self._closes(bucket, 0)
        frame = pd.DataFrame(list(self.flows.get()), columns=self.schema.names)
        frame["bucket"], frame["check"] = bucket, check
        if not check:
            self.flows.clear()
        if len(frame):
            yield frame

    def close(self) -> None:
        pass


def closed_buckets(new_flows: DataFrame, window_us: int, delay: str = "0 seconds", salts: int = 64) -> DataFrame:
    """The flows with ``bucket`` and ``check``, once when their bucket closes (to be checked) and once when the next one does."""
    width = f"{window_us}L"
    placed = new_flows.withColumn("_at", F.timestamp_micros("ts_us")).withWatermark("_at", delay)
    placed = placed.withColumn("bucket", F.expr(f"(ts_us - pmod(ts_us, {width})) div {width}"))
    placed = placed.withColumn("_salt", F.pmod(F.xxhash64(*(F.col(c) for c in new_flows.columns)), F.lit(salts)))
    out = StructType([*new_flows.schema.fields, StructField("bucket", LongType()), StructField("check", BooleanType())])
    return placed.groupBy("bucket", "_salt").transformWithStateInPandas(Buckets(new_flows.schema, window_us), out, "append", "eventTime")


def start_window_detector(
    new_flows: DataFrame, out: str, checkpoint: str, window_us: int, detect: Detector, delay: str = "0 seconds", salts: int = 64, **trigger
) -> StreamingQuery:
    """Check every flow against the window that ends at its time, when its bucket of one window's width has closed.

    ``detect`` is a batch operator such as ``lambda flows, checks: ddos_windows(flows, checks, params)``. Results go to
    ``out``, a folder per micro-batch; a batch that is tried again writes its folder anew.
    """
    columns = new_flows.columns

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = stage(batch, "closed")  # read by both sides below
        checks = rows.filter("check")
        if checks.isEmpty():
            return
        # A bucket that is checked in this batch is there as a whole already.
        context = rows.filter("not check").join(checks.select("bucket").distinct(), "bucket", "left_anti")
        flows = checks.select(*columns).unionByName(context.select(*columns))
        detect(flows, checks.select(*columns)).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    with rocksdb_state(new_flows.sparkSession):
        closed = closed_buckets(new_flows, window_us, delay, salts)
        return closed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def start_evidence_sink(evidence: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append evidence; ids are deterministic and a batch id is overwritten, so a retry adds nothing."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return evidence.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()
