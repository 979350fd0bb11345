"""Exact dedup as a stateful stream (operator 8): built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import ascii_lower, saved, shared_folder

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every state partition reserves megabytes of disk
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.maintenanceInterval": "15s",  # executors let go of an ended stream's stores this soon
}


def streaming_session(spark: SparkSession) -> SparkSession:
    """A session of its own for the stream's settings, so that other queries of the session keep theirs."""
    session = spark.newSession()
    for k, v in STATE_STORE.items():
        session.conf.set(k, v)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return session


def dedup_state(arrivals_path: str, schema, spark: SparkSession, folder: str, files_per_batch: int) -> DataFrame:
    """Run the stream over all arrivals; its keyed state, one row per digest: keep_id, locator, group_size.

    The state lives in RocksDB on the executors' disks with its changelog in the shared folder, and has no
    watermark, so no key ever expires. Each micro-batch writes the keys that it changed under its own epoch
    (a replayed batch overwrites the same folder), and the last epoch of a digest is its state.
    """
    state = (
        streaming_session(spark).readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(arrivals_path)
        .groupBy("digest")
        .agg(F.max(F.struct("id", "locator")).alias("kept"), F.count(F.lit(1)).alias("group_size"))
    )
    query = (
        state.writeStream.outputMode("update")
        .foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{folder}/state/epoch={epoch}"))
        .option("checkpointLocation", f"{folder}/stream")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    kept = "kept struct<id: bigint, locator: struct<file: string, place: bigint>>"
    epochs = spark.read.schema(f"digest binary, {kept}, group_size bigint, epoch int").parquet(f"{folder}/state")
    last = epochs.groupBy("digest").agg(F.max_by(F.struct("kept", "group_size"), "epoch").alias("s"))
    last = last.select("digest", F.col("s.kept.id").alias("keep_id"), F.col("s.kept.locator").alias("locator"), F.col("s.group_size").alias("group_size"))
    return saved(last, folder, "last")


def located(docs: DataFrame, id_col: str, text_col: str, folder: str) -> DataFrame:
    """id, text, locator (file and place in it) of rows that come straight from files; others are written first."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")).alias("locator")
    try:
        return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), at)
    except AnalysisException:
        return saved(rows, folder, "contents").select("id", "text", at)


#: Bits of one of Spark's bitmaps, and how many of them are sent to the tasks at most (4 KB each).
BITMAP_BITS, MOST_BITMAPS = 32_768, 2048


def may_be_hit(contents: DataFrame, places: DataFrame) -> DataFrame:
    """The contents whose locators may be among places: hashes of places set bits in at most MOST_BITMAPS bitmaps (8 MB),
    which every task gets, so that texts without a hit go no further than the scan that reads them. Other texts pass
    where hashes meet, by a chance of at most the places' number in 67 million; a join tells them apart.
    """
    maps = min(MOST_BITMAPS, max(1, places.count() * 32 // BITMAP_BITS))
    h = F.xxhash64("locator.file", "locator.place")
    bucket, bit = F.pmod(h, F.lit(maps)).cast("int"), F.pmod(F.shiftright(h, 24), F.lit(BITMAP_BITS)).cast("long")
    set_bits = places.select(bucket.alias("_bucket"), bit.alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    marked = contents.withColumns({"_bucket": bucket, "_bit": bit}).join(F.broadcast(set_bits), "_bucket")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(F.col("_bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.pmod(F.floor(byte / F.pow(F.lit(2), F.col("_bit") % 8)), F.lit(2)) == 1
    return marked.where(is_set).select(*contents.columns)


def by_content(places: DataFrame, contents: DataFrame) -> DataFrame:
    """digest, norm, keep_id, group_size: the whole texts behind places (locator, digest, id).

    Each text is found through its locator, so that a hot digest is as spread as its rows are; equal texts fall
    together, byte by byte, in the task that reads them, before they move by digest.
    """
    found = may_be_hit(contents, places).join(places.hint("merge"), "locator")  # places grow with the input: never broadcast
    return found.groupBy("digest", ascii_lower(F.col("text")).alias("norm")).agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int = 2000, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, locator.

    Texts are equal when identical after lower-casing A-Z; the row with the largest id stays. The arriving
    digests pass through a stream whose disk-backed keyed state holds digest, stable id and the place of the
    content, a file and a row in it. A digest that arrived more than once is a hit: the whole bytes of its rows
    are read again through their locators and compared; texts that only share a digest are told apart by
    their bytes, those of rows without a hit leave the scan no more. digest makes the key of the state from the text.

    Null and empty text are one text. Of repeated rows with one id each is kept or dropped by its text, like
    any other (two equal rows with the largest id both say kept). A null id is smaller than any id.
    An empty table gives no rows; other columns are ignored.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    contents = located(docs, id_col, text_col, folder)
    norm = ascii_lower(F.col("text"))
    arrivals = saved(contents.select(digest(norm).alias("digest"), "id", "locator", sha256(norm).alias("sha")), folder, "arrivals")
    state = dedup_state(f"{folder}/arrivals", arrivals.schema, spark, folder, files_per_batch)

    hits = state.where("group_size > 1").select("digest")
    places = saved(arrivals.join(hits, "digest").select("locator", "digest", "id"), folder, "places")
    texts = by_content(places, contents.select("text", "locator")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    several = saved(texts.where("texts > 1").select("digest"), folder, "several")
    kept = F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull())
    told = [F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "locator"]
    own = arrivals.select("digest", "id", "sha", "locator")
    if several.isEmpty():
        return own.join(state.drop("locator"), "digest").select(told)
    plain = own.join(state.join(several, "digest", "left_anti").drop("locator"), "digest")
    mixed = saved(places.join(several, "digest"), folder, "mixed")
    apart = by_content(mixed, contents.select("text", "locator"))
    rows = may_be_hit(contents, mixed).join(mixed.select("locator", "digest"), "locator").select("id", "digest", norm.alias("norm"), sha256(norm).alias("sha"), "locator")
    return plain.select(told).unionByName(rows.join(apart, ["digest", "norm"]).select(told))
