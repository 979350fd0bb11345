"""WARC archives with boundary-chain verification (operator 4)."""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import saved, shared_folder

MAGIC, END = b"WARC/1.1\r\n", "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
FIELD = re.compile(rb"([A-Za-z-]+): ?([^\r\n]*)\r\n")


def write_archives(pages: DataFrame, path: str, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000, records_per_file: int = 1000) -> None:
    """Write a record per row to gzipped archives; equal payloads of least_bytes or more are stored once.

    Of such payloads the row with the largest id is the response, the others revisit it (a null id is smaller
    than any; repeated rows with the largest id are all responses). Line breaks in URLs are percent-encoded.
    Copies are told by their digests and ids alone; pages then meet that table by digest and id, so that a payload which a
    million pages share is as spread as they are.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"n": F.octet_length("payload"), "key": F.unhex(F.sha2("payload", 256))})
    narrow = rows.where(F.col("n") >= least_bytes).select("key", "id")
    first = narrow.groupBy("key").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = saved(narrow.distinct().join(first.select("key", "first"), "key"), folder, "copies")
    of = copies.select(F.col("key").alias("of_key"), F.col("id").alias("of_id"), "first")
    rows = rows.join(of, (rows["key"] == of["of_key"]) & rows["id"].eqNullSafe(of["of_id"]), "left")
    revisit = (F.col("n") >= least_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit(MAGIC.decode()), field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))),
        F.coalesce(F.when(revisit, field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))), F.lit("")),
        F.coalesce(field("WARC-Target-URI", uri), F.lit("")), field("WARC-Date", F.lit(DATE)),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("payload"))),
        field("Payload-Length", F.col("n").cast("string")), field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n")).cast("string")),
        F.lit("\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )
    out = rows.select(record.alias("value")).write.mode("overwrite").option("lineSep", END)
    out.option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def header(data: bytes, at: int) -> tuple[dict[bytes, bytes], int] | None:
    """Fields of the record header at an offset, and where its block starts; None if there is no header."""
    fields, pos = {}, at + len(MAGIC)
    while m := FIELD.match(data, pos):
        fields[m[1].lower()], pos = m[2], m.end()
    if data[pos : pos + 2] != b"\r\n" or not fields.get(b"content-length", b"x").isdigit():
        return None
    return fields, pos + 2


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every magic with a header, whether a record or inside a payload, and the offset right after its block."""
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
            data, found, at = gzip.decompress(content.as_buffer()), [], -1
            while (at := data.find(MAGIC, at + 1)) >= 0:
                if (h := header(data, at)) and (end := h[1] + int(h[0][b"content-length"]) + len(END)) <= len(data):
                    found.append((at, end))
            yield pa.RecordBatch.from_pydict({"path": [path] * len(found), "at": pa.array([x[0] for x in found], pa.int64()), "jump": pa.array([x[1] for x in found], pa.int64())})


def chained(nodes: DataFrame, folder: str) -> DataFrame:
    """path, at of the records that the chain from offset 0 of each file reaches, by pointer jumping.

    After k rounds a jump spans 2**k records and the first 2**k records of each file are reached, so a file of
    n records takes log2(n) + 1 rounds. Each round is one join and one aggregation by (path, at).
    """
    now = saved(nodes.withColumn("reached", F.col("at") == 0), folder, "chain0")
    before, k = -1, 0
    while (count := now.where("reached").count()) != before:
        before, k = count, k + 1
        to = now.select("path", F.col("at").alias("jump"), F.col("jump").alias("far"), F.lit(True).alias("hit"))
        stepped = now.join(to, ["path", "jump"], "left")
        own = stepped.select("path", "at", F.col("far").alias("jump"), "reached", F.lit(True).alias("real"))
        marks = stepped.where("reached and hit").select("path", F.col("jump").alias("at"), F.lit(None).cast("long").alias("jump"), "reached", F.lit(False).alias("real"))
        both = own.unionByName(marks).groupBy("path", "at").agg(F.max("jump").alias("jump"), F.max("reached").alias("reached"), F.max("real").alias("real"))
        now = saved(both.where("real").drop("real"), folder, f"chain{k}")
    return now.where("reached").select("path", "at")


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fields and payload of the records at the given offsets of each file."""
    page = lambda v: int(v[10:-1]) if v and len(v) > 11 else None
    for batch in batches:
        for content, offsets in zip(batch["content"], batch["offsets"].to_pylist(), strict=True):
            data = gzip.decompress(content.as_buffer())
            out = []
            for at in offsets:
                fields, start = header(data, at)
                block = data[start : start + int(fields[b"content-length"])]
                kind = fields[b"warc-type"].decode()
                digest = fields[b"warc-payload-digest"].decode().removeprefix("sha1:")
                if kind == "response" and hashlib.sha1(block).hexdigest() != digest:
                    raise ValueError(f"payload of {fields[b'warc-record-id']!r} does not match its digest")
                out.append((page(fields[b"warc-record-id"]), int(fields[b"payload-length"]), digest, kind, page(fields.get(b"warc-refers-to")), block.decode("utf-8") if kind == "response" else None))
            for i in range(0, len(out), 500):
                part = list(zip(*out[i : i + 500], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.string()), pa.array(part[3], pa.string()), pa.array(part[4], pa.int64()), pa.array(part[5], pa.large_string()).cast(pa.string())], names=NAMES)


NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def read_archives(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits) of each record.

    Tasks list candidate records of their files with the offsets of their successors, pointer jumping keeps
    those that the chain from each file's start reaches, and a second pass over the files reads only these:
    record magic inside payloads is rejected. A file is one task's work; the writer bounds its records.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    found = files.mapInArrow(candidates, "path string, at long, jump long")
    offsets = chained(found, folder).groupBy("path").agg(F.sort_array(F.collect_list("at")).alias("offsets"))
    return files.join(offsets, "path").select("content", "offsets").mapInArrow(records, SCHEMA)


def through_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000) -> DataFrame:
    """Write pages to WARC archives in the shared folder and read them back, one row per page.

    Null payloads are empty ones; null URLs have no Target-URI; null ids come back null. Equal rows give equal
    records. An empty table gives no rows; other columns are not archived.
    """
    folder = shared_folder(pages.sparkSession)
    write_archives(pages, f"{folder}/archives", folder, id_col, url_col, payload_col, least_bytes)
    return read_archives(pages.sparkSession, f"{folder}/archives", folder)
