"""Event-time sessions of a file stream: session windows under a watermark, with keyed state that expires.

A session is a user's events each at most `gap` after the one before; it ends `gap` after its last event. The watermark
trails the latest event time of the batches before by `delay`. A session is returned once, when the watermark has
passed its end; then its state goes. An event is late, and dropped, if the session that it would open alone
has ended by the watermark (its time + gap is not after it); any other joins or merges sessions, however out of
order it comes. Events without a time belong to no session; a null user is a user of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqloom.scratch import shared_folder

#: State on the executors' disks, with its changes in the checkpoint that driver and executors share.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sessions(events: DataFrame, user: str, time: str, gap: str, delay: str, key: str | None = None, **measures: Column) -> DataFrame:
    """user, start, end, n and the measures (aggregates) of each session; events is a stream or a table.

    With key, rows that repeat a key are one event: in a stream as long as the key's state lives, that is until
    the watermark has passed the time of its first row by another delay; an event is then late as soon as its own
    time is before the watermark. Times without a zone are
    read in the session's (a SessionStream's is UTC), and start and end have none either.
    """
    rows, zoned = events.where(F.col(time).isNotNull()), dict(events.dtypes)[time] != "timestamp_ntz"
    if not zoned:
        rows = rows.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, delay)
    if key:
        rows = rows.dropDuplicatesWithinWatermark([key]) if events.isStreaming else rows.dropDuplicates([key])
    out = rows.groupBy(F.session_window(time, gap).alias("_w"), user).agg(F.count(F.lit(1)).alias("n"), *[m.alias(name) for name, m in measures.items()])
    edge = lambda c: F.col(f"_w.{c}") if zoned else F.col(f"_w.{c}").cast("timestamp_ntz")
    return out.select(user, edge("start").alias("start"), edge("end").alias("end"), "n", *measures)


class SessionStream:
    """Sessions of the Parquet files that arrive in a folder (or match a pattern), as many runs as one likes, then one that closes all.

    State, offsets and results are in `folder` (by default a new one of spark.checkpoint.dir): a run that fails
    part of the way is run again from its last batch, and a later SessionStream of the same folder goes on.
    """

    def __init__(self, spark: SparkSession, arrivals: str, schema: StructType, user: str, time: str, gap: str, delay: str, key: str | None = None, files_per_batch: int | None = None, folder: str | None = None, **measures: Column):
        self.folder = folder or shared_folder(spark)
        self.spark, self.arrivals, self.schema, self.time, self.files = spark.newSession(), arrivals, schema, time, files_per_batch
        self.of = {"user": user, "time": time, "gap": gap, "delay": delay, "key": key} | measures
        for k, v in (STATE | {"spark.sql.session.timeZone": "UTC"}).items():
            self.spark.conf.set(k, v)
        self.spark.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
        self.clock(None)

    def clock(self, after: str | None) -> None:
        """A table of one row without a user, `after` the last event; of none before the stream is closed."""
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name != self.time]
        if after is None:
            self.spark.createDataFrame([], self.schema).coalesce(1).write.mode("ignore").parquet(f"{self.folder}/clock/0")
            return
        last = self.spark.read.schema(self.schema).parquet(self.arrivals).agg(F.max(self.time).alias("t"))
        last.select(*nulls, F.expr(f"t + {after}").alias(self.time)).select(self.schema.names).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/clock/1")

    def run(self) -> None:
        """Take in all files that have come; sessions that their events close are added to the results."""
        reader = self.spark.readStream.schema(self.schema)
        arriving = (reader.option("maxFilesPerTrigger", self.files) if self.files else reader).parquet(self.arrivals)
        clock = self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/clock")
        out = sessions(arriving.unionByName(clock), **self.of)
        query = out.writeStream.outputMode("append").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start(path=f"{self.folder}/closed", format="parquet")
        query.awaitTermination()

    def close(self) -> DataFrame:
        """After the last arrivals: move the watermark past the last session, so that none stays open, and all sessions."""
        self.run()
        self.clock(f"(INTERVAL {self.of['gap']} + INTERVAL {self.of['delay']} + INTERVAL 1 SECOND) * 2")
        self.run()
        return self.closed()

    def closed(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/closed")
