"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import bpe, langid, minhash, mixing, stream_dedup
from seqloom.llm.common import crc_mod, own_ids, saved, shared_folder

#: The columns of documents, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(docs: DataFrame) -> DataFrame:
    """The columns of documents and `row`, a number of each row's own: stages decide on rows, not on ids."""
    return own_ids(docs.select(COLUMNS), "doc_id", "row", shared_folder(docs.sparkSession))


def kept_by(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """The decided ones (a column row) of rows, with the columns of documents."""
    return rows.join(decided.select("row"), "row", "left_semi").select(COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without a letter, or in none of them, go.

    A document is in none if its mean probability over its bytes is below 0.35 for every language. The
    network learns from text and lang of the rows whose crc32(doc_id as text) mod 4 is not 2. Repeated rows
    and null ids are each decided on their own; null texts go; an empty table gives no rows.
    """
    rows = rows_of(docs)
    found = langid.identify(rows, rows.where(crc_mod(F.col("doc_id"), 4) != 2), id_col="row")
    return kept_by(rows, found.where("lang_pred <> 'und' and score >= 0.35"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text (A-Z lower-cased, null is empty), the one with the largest doc_id; of equal ids one."""
    rows = rows_of(docs)
    return kept_by(rows, stream_dedup.exact_dedup(rows, id_col="row").where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, 0.8), the one with the smallest doc_id (null
    ids first); of equal ids one. Texts without a word are in no group and stay."""
    rows = rows_of(docs)
    return kept_by(rows, minhash.near_dedup(rows, id_col="row").where("kept"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: not at all, or up to three times as rows of their own."""
    rows = rows_of(docs)
    taken = mixing.mix_sources(rows, id_col="row").where("repeats > 0").select("row", F.col("repeats").cast("int").alias("repeats"))
    return rows.join(taken, "row").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("copy")).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded of every row of the mix."""
    import public_tokenizers

    out = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixed", mixed), ("tokens", tokens)]

#: The network's and the tokenizer's decisions are not SQL's to express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), folder, f"{k}-{name}")
    return docs
