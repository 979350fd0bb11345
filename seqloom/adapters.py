"""The given tables seen as reads, targets, calls and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The letters a-z as bases, for tests on prose.
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
KINDS = ["click", "error", "purchase", "signup", "view"]
FAMILIES = ["L1", "ALU", "SVA", "NA", "LTR", "SINE"]
EPOCH = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, contig, s, e, strand, sample, mapq, user_id from events."""
    s = F.expr(f"timestampdiff(SECOND, {EPOCH}, ts)")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("contig"), s.alias("s"), (s + 1 + F.floor("value")).alias("e"),
        F.when(F.col("user_id") % 2 == 0, "+").otherwise("-").alias("strand"), (F.col("user_id") % 3).alias("sample"),
        F.get_json_object("props", "$.k").cast("int").alias("mapq"), "user_id")


def mates(reads: DataFrame) -> DataFrame:
    """Reads with contig, start and strand of their mate, the user's next read."""
    order = Window.partitionBy("user_id").orderBy("s", "id")
    return reads.withColumns({f"mate_{c}": F.lead(c).over(order) for c in ("contig", "s", "strand")})


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tid, contig, s, e, class from orders."""
    s = F.col("o_orderkey") * 173 % 2592000
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("o_custkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tid"), kind.alias("contig"), s.alias("s"), (s + 300).alias("e"), F.col("o_orderpriority").alias("class"))


def breakends(reads: DataFrame) -> DataFrame:
    """id, contig, dir (left for even ids), pos, n (evidence)."""
    left = F.col("id") % 2 == 0
    return reads.select("id", "contig", F.when(left, "left").otherwise("right").alias("dir"), F.when(left, F.col("s")).otherwise(F.col("e") - 1).alias("pos"), (F.col("mapq") % 10).alias("n"), "s", "e")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq: the letters of whole texts as bases."""
    low = F.translate(F.coalesce("text", F.lit("")), LETTERS.upper(), LETTERS)
    return table(spark, sf_dir, "documents").select("doc_id", F.translate(F.regexp_replace(low, "[^a-z]", ""), LETTERS, BASES).alias("seq"))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads as alignment records: a user's reads are mates by twos, with name, flag, CIGAR with clips, bases, qualities."""
    i, w = F.col("id"), Window.partitionBy("user_id").orderBy("s", "id")
    rows = reads(spark, sf_dir).withColumn("rank", F.row_number().over(w))
    first = F.col("rank") % 2 == 1
    rows = rows.withColumns({f"mate_{c}": F.when(first, F.lead(c).over(w)).otherwise(F.lag(c).over(w)) for c in ("contig", "s", "strand")})
    left, right = i % 13 * 2, F.col("user_id") % 11 * 3
    soft = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise("")
    bit = lambda holds, n: F.when(holds, n).otherwise(0)
    flag = F.lit(1) + bit(i % 17 == 0, 4) + bit(F.col("mate_s").isNull() | (i % 19 == 0), 8) + bit(F.col("strand") == "-", 16) + F.when(first, 64).otherwise(128)
    flag += bit(i % 23 == 0, 256) + bit(i % 29 == 0, 1024) + bit(i % 31 == 0, 2048)
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("."), F.floor((F.col("rank") - 1) / 2).cast("string"))
    kind = F.when(i % 3 == 0, ".SR/1").when(i % 3 == 1, ".DR/2").otherwise("")
    return rows.withColumns({
        "qname": name, "read_name": F.concat(name, kind), "flag": flag.cast("int"), "nm": (i % 7).cast("long"), "p": F.col("mapq") / F.lit(100.0),
        "cigar": F.concat(soft(left), (F.col("e") - F.col("s")).cast("string"), F.lit("M"), soft(right)),
        "seq": F.translate(F.md5(i.cast("string")), "0123456789abcdef", "ACGTACGTACGTACGN"), "qual": F.md5(F.concat(F.lit("q"), i.cast("string")))}).drop("rank")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final calls as text columns with 'NA' for what is missing, numbers standing in for evidence, from lineitem."""
    text = lambda c: c.cast("string")
    q, o, p, s, n = F.col("l_quantity").cast("int"), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    bases = lambda x: F.translate(F.substring(F.md5(text(x)), 1, (q % 14 + 1).cast("int")), "0123456789abcdef", "ACGTACGTACGTACGT")
    tsd = F.when(q % 9 == 0, "NA").when(q % 11 == 0, F.repeat(F.lit("A"), q)).otherwise(bases(p))
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", text(o), text(n), text(p), text(s)).alias("UUID"), F.concat(F.lit("chr"), text(s % 5)).alias("Chromosome"),
        text(o * 10).alias("Left_Extreme"), text(o * 10 + q * 20).alias("Right_Extreme"), text(o * 10 + q).alias("5_Prime_End"), text(o * 10 + q + n - 4).alias("3_Prime_End"),
        F.element_at(F.array(*map(F.lit, FAMILIES)), (p % 6 + 1).cast("int")).alias("Superfamily"),
        F.element_at(F.array(*map(F.lit, ["L1Ta", "AluYa5", "SVA_E", "NA", "ERVK", "B2"])), (p % 6 + 1).cast("int")).alias("Subfamily"),
        text(q * 3).alias("TE_Align_Start"), text(q * 3 + s * 7).alias("TE_Align_End"), F.when(n % 2 == 0, "+").otherwise("-").alias("Orient_5p"), F.when(p % 2 == 0, "+").otherwise("-").alias("Orient_3p"),
        text(1 - F.col("l_discount")).alias("5p_Elt_Match"), text(1 - F.col("l_tax")).alias("3p_Elt_Match"), text(1 - F.col("l_tax") / 2).alias("5p_Genome_Match"), text(1 - F.col("l_discount") / 2).alias("3p_Genome_Match"),
        text(n).alias("Split_reads_5prime"), text(q % 6).alias("Split_reads_3prime"), text(q).alias("Remapped_Discordant"), text(F.col("l_tax") * 15).alias("Remap_Disc_Fraction"),
        text(s * 5).alias("5p_Cons_Len"), text(p % 400).alias("3p_Cons_Len"), F.when(n % 2 == 0, "Y").otherwise("N").alias("5p_Improved"), F.lit("N").alias("3p_Improved"),
        tsd.alias("TSD_5prime"), F.when(n == 3, bases(p + 1)).otherwise(tsd).alias("TSD_3prime"),
        F.concat(F.lit("a|"), text(n)).alias("Sample_support_5p"), F.concat(F.lit("b|"), text(q % 6)).alias("Sample_support_3p"),
        F.when(q % 7 == 0, "NA").otherwise(F.repeat(F.lit("ACGT"), (q % 8).cast("int"))).alias("Genomic_Consensus_5p"), F.when(q % 5 == 0, "NA").otherwise(F.repeat(F.lit("TTA"), (n + 1).cast("int"))).alias("Genomic_Consensus_3p"),
        F.when(p % 6 == 0, "NA").otherwise("ACGT").alias("Insert_Consensus_5p"), F.when(p % 4 == 0, "NA").otherwise("TTTT").alias("Insert_Consensus_3p"),
        F.when(q % 10 == 0, "NA").otherwise(F.concat(F.lit("a|"), text(n), F.lit("|"), text(q), F.lit("|"), text(F.col("l_tax") * 10), F.lit(",b|1|9|0.1"))).alias("Genotypes"),
        F.array_join(F.array_repeat(F.lit("x"), n), ",").alias("Variants"))
