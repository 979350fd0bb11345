"""What the operators of this subpackage share: the scratch folder, tokens and id columns."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.scratch import delete, exists, saved, shared_folder

__all__ = ["LOWER", "LOWER_TABLE", "UPPER", "WORD", "ascii_lower", "crc_mod", "delete", "drop_shuffles", "exists", "own_ids", "saved", "shared_folder", "table", "words_of"]

#: The A-Z letters that contracts lower-case, and nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: a word, by the contracts.
WORD = r"[^\x20\x09-\x0D]+"
#: bytes.translate table for the same lower-casing.
LOWER_TABLE = bytes(range(65)) + LOWER.encode() + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n: the contracts' fold of a document (null: fold of the empty text)."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text after lower-casing A-Z; bytes.split() parts at exactly x20 and x09-x0D."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split() if text else []


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs whose results are saved: it does so once nothing refers to them
    and both garbage collections have run. Otherwise they would stay until the driver happens to collect."""
    gc.collect()
    spark._jvm.System.gc()


def own_ids(docs: DataFrame, id_col: str, name: str, folder: str) -> DataFrame:
    """docs with the column `name`, a different long in every row, in the order of id_col (nulls first).

    Where ids are neither null nor repeated it is the id itself. Else rows are numbered by id, then by all
    columns, over range partitions (one count a part is gathered), and written, so that equal rows keep their numbers.
    """
    ids = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    if ids.where(F.col(id_col).isNull() | (F.col("n") > 1)).isEmpty():
        return docs.withColumn(name, F.col(id_col).cast("long"))
    order = [id_col, F.xxhash64(*docs.columns)]
    parts = saved(docs.repartitionByRange(*order).withColumn("_own_part", F.spark_partition_id()), folder, "own-parts")
    below = F.sum("n").over(Window.orderBy("_own_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = parts.groupBy("_own_part").agg(F.count(F.lit(1)).alias("n")).select("_own_part", F.coalesce(below, F.lit(0)).alias("_own_below"))
    at = F.row_number().over(Window.partitionBy("_own_part").orderBy(*order))
    return saved(parts.join(F.broadcast(sizes), "_own_part").withColumn(name, F.col("_own_below") + at).drop("_own_part", "_own_below"), folder, "own-ids")
