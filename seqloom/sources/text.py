"""Readers and writers of the usual text formats.

Empty files give no rows. Repeated lines are rows of their own, but for FASTA, where the last record of an id stays. Nulls are
written as NA, a dot or nothing, as each format has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqloom.operators.evidence import of_every_sample


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """seq_id (first token of the header), seq (wrapped lines joined). A record starts at a > that begins a line; of
    equal ids the last record by file name and place stays."""
    rows = spark.read.option("lineSep", "\n>").text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"))
    text = F.regexp_replace("value", "^>", "")
    head, body = F.regexp_extract(text, r"^(\S+)", 1), F.regexp_replace(text, r"^[^\n]*\n?", "")
    found = rows.where(F.trim(text) != "").select("at", head.alias("seq_id"), F.regexp_replace(body, r"\s", "").alias("seq"))
    return found.groupBy("seq_id").agg(F.max_by("seq", "at").alias("seq"))


def write_fasta(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit(">"), "seq_id", F.lit("\n"), "seq")).write.mode("overwrite").text(path)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """contig, s, e, extra: further columns; comment lines and broken intervals are left out."""
    cols = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("value not like '#%'").select(cols.alias("c"))
    s, e = (F.expr(f"try_cast(try_element_at(c, {i}) as bigint)") for i in (2, 3))
    return rows.select(F.col("c")[0].alias("contig"), s.alias("s"), e.alias("e"), F.slice(F.col("c"), 4, F.greatest(F.size("c"), F.lit(1))).alias("extra")).where("s is not null and e is not null and s <= e")


def read_fai(spark: SparkSession, path: str, skip: list[str] | None = None, longer_than: int = 0) -> DataFrame:
    cols = F.split("value", "\t")
    rows = spark.read.text(path).where("value not like '#%'").select(cols[0].alias("contig"), cols[1].cast("long").alias("length"))
    return rows.where(~F.col("contig").isin(skip or []) & (F.col("length") > longer_than))


def read_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Tab-separated table with a header, NA for null."""
    return spark.read.csv(path, sep="\t", header=True, nullValue="NA", schema=schema)


def write_table(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="NA", emptyValue="", compression=compression)


#: The columns before the samples, and the version line.
VCF_VERSION, VCF_COLUMNS = "##fileformat=VCFv4.1", "#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split()


def vcf_samples(samples: DataFrame) -> DataFrame:
    """sample, place: distinct names (sample) as text, with their columns in the order of the names."""
    names = samples.select(F.col("sample").cast("string").alias("sample")).where("sample is not null").distinct()
    return names.withColumn("place", F.row_number().over(Window.orderBy("sample")))  # one row a sample file


def vcf_lines(sites: DataFrame, calls: DataFrame, samples: DataFrame, info: Column) -> DataFrame:
    """tid, contig, pos, line: one VCF line per site (tid, contig, pos), GT:DS of each sample in its place.

    calls (tid, sample, gt, dose) hold the genotypes, of several of a sample the greatest text; a sample without one has
    ./.:0.000. samples (see vcf_samples) is a table, of any number of rows: a site meets each of them, and
    its line is put together from the rows in order. Null fields are dots.
    """
    text = F.format_string("%s:%.3f", F.coalesce("gt", F.lit("./.")), F.round(F.coalesce("dose", F.lit(0.0)), 3))
    told = calls.select("tid", F.col("sample").cast("string").alias("sample"), text.alias("_text")).join(samples, "sample").select("tid", "place", "_text")
    none = of_every_sample(sites.select("tid"), samples.select(F.col("place").alias("sample"))).select("tid", F.col("sample").alias("place"), F.lit("").alias("_text"))
    each = none.unionByName(told).groupBy("tid", "place").agg(F.max("_text").alias("_text"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "_text"))), lambda x: F.when(x["_text"] == "", "./.:0.000").otherwise(x["_text"])), "\t")
    of_site = each.groupBy("tid").agg(line.alias("_samples"))
    dot = lambda c: F.coalesce(c.cast("string"), F.lit("."))
    fields = [dot(F.col("contig")), dot(F.col("pos")), *map(F.lit, [".", "REF", "ALT", "100", "PASS"]), dot(info), F.lit("GT:DS")]
    fields += [F.col("_samples")]
    return sites.join(of_site, "tid", "left").select("tid", "contig", "pos", F.concat_ws("\t", *fields).alias("line"))


def write_vcf(lines: DataFrame, samples: DataFrame, path: str) -> None:
    """Part files that are one VCF when read by name: header first, then lines by contig and position. The header is one
    line with a name a sample (see vcf_samples)."""
    names = [r["sample"] for r in samples.orderBy("place").collect()]
    head = lines.sparkSession.createDataFrame([(k, x) for k, x in enumerate([VCF_VERSION, "\t".join([*VCF_COLUMNS, *names])])], "pos long, line string")
    rows = head.select(F.lit(0).alias("kind"), F.lit("").alias("contig"), "pos", "line").unionByName(lines.select(F.lit(1).alias("kind"), "contig", F.col("pos").cast("long").alias("pos"), "line"))
    rows.orderBy("kind", "contig", "pos", "line").select("line").write.mode("overwrite").text(path)


def write_fastq(reads: DataFrame, path: str) -> None:
    """Records of reads (kind, name, seq, qual), a folder per kind such as SR and DR; null qual is the best (I)."""
    qual = F.coalesce("qual", F.expr("repeat('I', char_length(seq))"))
    record = F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), qual)
    reads.select("kind", record.alias("value")).write.mode("overwrite").partitionBy("kind").text(path)
