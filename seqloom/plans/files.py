"""Registered queries of sources and sinks: given tables are written in a format to the shared folder and read back.

Lines that a reader must leave out (broken numbers, comments, short lines) are written among the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom import adapters
from seqloom.operators import evidence
from seqloom.plans.records import query
from seqloom.scratch import shared_folder
from seqloom.sources import genome, text


def written(df: DataFrame, *fields: Column, sep: str = "\t") -> str:
    """The folder of a text file with a line a row."""
    path = f"{shared_folder(df.sparkSession)}/lines"
    df.select(F.concat_ws(sep, *[F.coalesce(f.cast("string"), F.lit("*")) for f in fields]).alias("value")).write.text(path)
    return path


def folder(df: DataFrame) -> str:
    return f"{shared_folder(df.sparkSession)}/table"


col, lit = F.col, F.lit


@query("SELECT 'd' || doc_id AS seq_id, md5(seq) AS seq_md5, len(seq)::BIGINT AS n FROM seqs")
def fasta_read(spark, sf_dir):
    """Wrapped lines of 60 letters, headers with a note."""
    s = adapters.sequences(spark, sf_dir)
    path = written(s, F.concat(lit(">d"), col("doc_id").cast("string"), lit(" a note\n"), F.regexp_replace("seq", "(.{60})", "$1\n")))
    return text.read_fasta(spark, path).select("seq_id", F.md5("seq").alias("seq_md5"), F.length("seq").cast("long").alias("n"))


@query("SELECT doc_id::VARCHAR AS seq_id, md5(seq || repeat('A', 50)) AS seq_md5 FROM seqs")
def transcripts_read(spark, sf_dir):
    s = adapters.sequences(spark, sf_dir)
    text.write_fasta(s.select(col("doc_id").cast("string").alias("seq_id"), "seq"), path := folder(s))
    return genome.read_transcripts(spark, path).select("seq_id", F.md5("seq").alias("seq_md5"))


@query("SELECT tid, contig || '|' || s || '|' || e || '|' || replace(class, ' ', '|') || '|' || tid AS payload FROM targets WHERE tid % 11 > 0")
def bed_payloads(spark, sf_dir):
    t, odd = adapters.targets(spark, sf_dir), col("tid") % 11 == 0
    path = written(t, F.when(odd & (col("tid") % 2 == 0), F.concat(lit("#"), "contig")).otherwise(col("contig")), F.when(odd, col("e") + 1).otherwise(col("s")), col("e"), col("class"), col("tid"))
    return text.read_bed(spark, path).select(F.element_at("extra", -1).cast("long").alias("tid"), genome.payload().alias("payload"))


@query("SELECT contig, max(e) AS length FROM reads WHERE contig <> 'view' GROUP BY contig HAVING max(e) > 1000")
def index_of_contigs(spark, sf_dir):
    lengths = adapters.reads(spark, sf_dir).groupBy("contig").agg(F.max("e").alias("n"))
    return text.read_fai(spark, written(lengths, col("contig"), col("n"), lit(7), lit(60), lit(61)), ["view"], 1000)


NAS = "CASE WHEN q % 9 = 0 THEN NULL ELSE q END"


@query(f"SELECT uuid, {NAS} AS q, CASE WHEN n % 2 = 0 THEN nullif(super, 'NA') END AS family FROM calls")
def tables_read(spark, sf_dir):
    q = col("Remapped_Discordant").cast("int")
    rows = adapters.calls(spark, sf_dir).select(col("UUID").alias("uuid"), F.when(q % 9 > 0, q).alias("q"), F.when(col("Split_reads_5prime").cast("int") % 2 == 0, col("Superfamily")).alias("family"))
    text.write_table(rows, path := folder(rows))
    return text.read_table(spark, path, "uuid string, q int, family string")


@query("SELECT tid, CASE WHEN tid % 9 > 0 THEN (tid % 50)::VARCHAR END AS as_null, CASE WHEN tid % 9 = 0 THEN 'NA' ELSE (tid % 50)::VARCHAR END AS as_word FROM targets")
def two_readings_of_na(spark, sf_dir):
    t = col("tid")
    rows = adapters.targets(spark, sf_dir).select("tid", F.when(t % 9 > 0, t % 50).alias("v"))
    text.write_table(rows, path := folder(rows))
    nulls, words = genome.read_table_twice(spark, path)
    back = nulls.select("tid", col("v").alias("as_null")).join(words.select("tid", col("v").alias("as_word")), "tid")
    return back.withColumn("tid", col("tid").cast("long"))


@query("""SELECT id, qname, 1 + CASE WHEN unmapped THEN 4 ELSE 0 END + CASE WHEN mate_unmapped THEN 8 ELSE 0 END + CASE WHEN strand = '-' THEN 16 ELSE 0 END + CASE WHEN is_first THEN 64 ELSE 128 END
  + CASE WHEN secondary THEN 256 ELSE 0 END + CASE WHEN duplicate THEN 1024 ELSE 0 END + CASE WHEN supplementary THEN 2048 ELSE 0 END AS flag, contig, s, e, mapq, mate_contig, mate_s, seq, qual, nm::VARCHAR AS nm FROM alns""")
def sam_read(spark, sf_dir):
    a = adapters.alignments(spark, sf_dir)
    mate = F.when(col("mate_contig") == col("contig"), "=").otherwise(F.coalesce("mate_contig", lit("*")))
    path = written(a, col("qname"), col("flag"), col("contig"), col("s") + 1, col("mapq"), col("cigar"), mate, F.coalesce(col("mate_s") + 1, lit(0)), lit(0), col("seq"), col("qual"), F.concat(lit("NM:i:"), col("nm").cast("string")), F.concat(lit("XI:i:"), col("id").cast("string")), lit("broken"))
    t = lambda k: F.element_at("tags", k)
    return genome.read_sam(spark, path).select(t("XI").cast("long").alias("id"), "qname", "flag", "contig", "s", "e", "mapq", "mate_contig", "mate_s", "seq", "qual", t("NM").alias("nm"))


@query("SELECT tid, contig, s AS pos, (tid % 50)::INT AS depth FROM targets WHERE tid % 13 > 0")
def pileup_read(spark, sf_dir):
    path = written(adapters.targets(spark, sf_dir), col("contig"), col("s"), col("tid"), F.when(col("tid") % 13 > 0, (col("tid") % 50).cast("string")).otherwise("x"), sep="  ")
    return genome.read_pileup(spark, path).select(col("base").cast("long").alias("tid"), "contig", "pos", "depth")


@query("SELECT tid, contig, s || ':' || CASE WHEN tid % 2 = 0 THEN 'AC' ELSE 'A' END || '>' || CASE WHEN tid % 3 = 0 THEN 'GT' ELSE 'G' END AS variant FROM targets WHERE (tid % 2 = 0) = (tid % 3 = 0)")
def variants_read(spark, sf_dir):
    t = col("tid")
    path = written(adapters.targets(spark, sf_dir), col("contig"), col("s"), t, F.when(t % 2 == 0, "AC").otherwise("A"), F.when(t % 3 == 0, "GT").otherwise("G"))
    return genome.read_variants(spark, path, single=True).select(col("name").cast("long").alias("tid"), "contig", "variant")


@query("""SELECT 'L' || tid % 6 AS type, contig, s, e, CASE WHEN tid % 2 = 0 THEN '-' ELSE '+' END AS strand, tid % 40 / 2.0::DOUBLE AS divergence FROM targets
WHERE tid % 6 < 3 AND contig IN ('click', 'error') AND tid % 300 + tid % 50 < 150 AND tid % 40 / 2.0 <= 15""")
def repeats_read(spark, sf_dir):
    t = col("tid")
    minus, start, left = t % 2 == 0, (t % 300).cast("string"), F.concat(lit("("), (t % 50).cast("string"), lit(")"))
    rows = adapters.targets(spark, sf_dir)
    path = written(rows, lit(9), t % 40 / 2.0, lit(0), lit(0), F.concat(F.when(t % 3 == 0, "chr").otherwise(""), "contig"), col("s") + 1, col("e"), lit("(5)"), F.when(minus, "C").otherwise("+"), F.concat(lit("L"), (t % 6).cast("string")), lit("LINE/L1"), F.when(minus, left).otherwise(start), lit(5), F.when(minus, start).otherwise(left), sep=" ")
    out = genome.read_repeats(spark, path, ["L0", "L1", "L2"], ["click", "error"], most_divergence=15.0)
    return out.select("type", "contig", "s", "e", "strand", "divergence")


@query("""SELECT tid, 'n' || tid AS name, 'G' || (tid % 9) AS gene, contig, CASE WHEN tid % 2 = 0 THEN '+' ELSE '-' END AS strand, greatest(s - 1000, 0) AS s, e + 1000 AS e, s AS exon, 2 AS exons FROM targets""")
def genes_read(spark, sf_dir):
    t = adapters.targets(spark, sf_dir)
    i, two = col("tid"), lambda a, b: F.concat(a.cast("string"), lit(","), b.cast("string"), lit(","))
    path = written(t, lit(0), F.concat(lit("n"), i.cast("string")), col("contig"), F.when(i % 2 == 0, "+").otherwise("-"), col("s"), col("e"), lit(0), lit(0), lit(2), two(col("s"), col("s") + 200), two(col("s") + 50, col("e")), lit(0), F.concat(lit("G"), (i % 9).cast("string")), lit("c"), lit("c"), lit("0,0,"))
    genome.write_sorted_genes(genome.read_genes(spark, path, 1000), out := folder(t))
    return spark.read.parquet(out).select(F.substring("name", 2, 30).cast("long").alias("tid"), "name", "gene", "contig", "strand", "s", "e", F.get("exon_starts", lit(0)).alias("exon"), F.size("exon_ends").alias("exons"))


@query("SELECT 'c' || tid AS chunk, CASE WHEN tid % 3 > 0 THEN (tid % 100)::VARCHAR ELSE 'UNFINISHED' END AS took FROM targets")
def run_log_times(spark, sf_dir):
    t = adapters.targets(spark, sf_dir)
    at = lambda n: F.concat(F.date_format(F.timestamp_seconds(lit(1_700_000_000) + n), "yyyy-MM-dd HH:mm:ss"), lit(",123 INFO "))
    line = F.explode(F.array(F.concat(at(lit(0)), lit("Processing chunk: c"), col("tid").cast("string")), F.when(col("tid") % 3 > 0, F.concat(at(col("tid") % 100), lit("Finished chunk: c"), col("tid").cast("string"))).otherwise(lit("nothing"))))
    return genome.chunk_times(genome.read_run_log(spark, written(t.select(line.alias("line")), col("line"))))


@query("SELECT lpad((tid % 1000000)::VARCHAR, 8, '0') || '-' || tid AS uuid FROM targets WHERE tid % 2 = 0")
def uuids_read(spark, sf_dir):
    t = col("tid")
    name = F.when(t % 2 == 0, F.concat(F.lpad((t % 1_000_000).cast("string"), 8, "0"), lit("-"), t.cast("string"))).otherwise(F.concat(lit("no-"), t.cast("string")))
    return genome.read_uuids(spark, written(adapters.targets(spark, sf_dir), name, lit("rest"), sep=" "))


@query("SELECT '/data/' || tid || '.bam' AS path, 's' || tid AS name FROM targets")
def sample_names_read(spark, sf_dir):
    t = col("tid").cast("string")
    return genome.read_sample_names(spark, written(adapters.targets(spark, sf_dir), F.concat(lit("s"), t), F.concat(lit("/data/"), t, lit(".bam"))), name_first=True)


@query("SELECT contig, s, e, CASE WHEN tid % 2 = 0 THEN '+' ELSE '-' END AS strand, 'x' || tid AS name FROM targets WHERE tid % 17 > 0")
def elements_read(spark, sf_dir):
    """Written as a table (rows that are null throughout are left out) and as a list, whose short lines are left out."""
    t, odd = adapters.targets(spark, sf_dir), col("tid") % 17 == 0
    kept = lambda c: F.when(~odd, c)
    genome.write_elements(t.select(kept(col("contig")).alias("contig"), kept(col("s")).alias("s"), kept(col("e")).alias("e"), kept(F.when(col("tid") % 2 == 0, "+").otherwise("-")).alias("strand"), kept(F.concat(lit("x"), col("tid").cast("string"))).alias("name")), path := folder(t))
    back = text.read_table(spark, path, "contig string, s bigint, e bigint, strand string, name string")
    return genome.read_elements(spark, written(back, *[col(c) for c in back.columns]))


@query("SELECT uuid, 'chr' || (s % 5) AS chrom, o * 10 AS lo, tsd5, super FROM calls")
def final_table_read(spark, sf_dir):
    calls = adapters.calls(spark, sf_dir)
    genome.write_calls(calls, path := folder(calls), calls.columns, "lz4")
    return genome.read_table_twice(spark, path)[1].select(col("UUID").alias("uuid"), col("Chromosome").alias("chrom"), col("Left_Extreme").cast("long").alias("lo"), col("TSD_5prime").alias("tsd5"), col("Superfamily").alias("super"))


@query("SELECT kind, count(*) AS records, sum(len(seq))::BIGINT AS bases, min(id) AS first FROM alns WHERE kind IS NOT NULL GROUP BY kind")
def fastq_written(spark, sf_dir):
    a = adapters.alignments(spark, sf_dir).where("id % 3 < 2")
    text.write_fastq(a.select(F.when(col("id") % 3 == 0, "SR").otherwise("DR").alias("kind"), col("id").cast("string").alias("name"), "seq", "qual"), path := folder(a))
    rows = spark.read.option("lineSep", "\n@").text(path).withColumn("c", F.split(F.regexp_replace("value", "^@", ""), "\n"))
    return rows.groupBy("kind").agg(F.count(lit(1)).alias("records"), F.sum(F.length(F.get("c", lit(1)))).cast("long").alias("bases"), F.min(F.get("c", lit(0)).cast("long")).alias("first"))


@query("SELECT tid, s, class FROM targets")
def details_written(spark, sf_dir):
    t = adapters.targets(spark, sf_dir)
    genome.write_details(t, path := folder(t), "run", "tid")
    rows = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    got = lambda c: F.regexp_extract("value", rf"(?m)^{c}: (.*)$", 1)
    return rows.where(F.col("value").rlike(r"(?s)^##CMD: run\n#BEGIN (\d+)\n.*#END \1$")).select(got("tid").cast("long").alias("tid"), got("s").cast("long").alias("s"), got("class").alias("class"))


@query("SELECT contig, count(*) AS n, sum(s)::BIGINT AS total FROM reads GROUP BY contig")
def folders_by_contig(spark, sf_dir):
    r = adapters.reads(spark, sf_dir).select("id", "contig", "s", "e")
    genome.write_by_contig(r, path := folder(r))
    return spark.read.parquet(path).groupBy("contig").agg(F.count(lit(1)).alias("n"), F.sum("s").alias("total"))


@query("""x0 AS (SELECT * FROM reads WHERE mapq > 10), x1 AS (SELECT contig, max(e) AS len FROM reads GROUP BY contig), x2 AS (SELECT contig, unnest(range(0, len // 3600 + 1)) AS bin FROM x1),
x3 AS (SELECT contig, unnest(range(s // 3600, (e - 1) // 3600 + 1)) AS bin FROM x0), x4 AS (SELECT contig, bin, count(*) AS n FROM x3 GROUP BY contig, bin)
SELECT contig, bin * 3600 AS "Start", (bin + 1) * 3600 AS "End", coalesce(n, 0) AS n FROM x2 LEFT JOIN x4 USING (contig, bin)""")
def masks_written(spark, sf_dir):
    reads = adapters.reads(spark, sf_dir)
    bins = evidence.bin_rates(reads, reads.groupBy("contig").agg(F.max("e").alias("length")), 3600, 10)
    genome.write_mask(bins.select("contig", "bin", col("n").alias("cpm"), lit(0).alias("z")), path := folder(reads), 3600)
    back = genome.read_table_twice(spark, path)[1]
    return back.select(col("`#Chrom`").alias("contig"), col("Start").cast("long").alias("Start"), col("End").cast("long").alias("End"), col("CPM").cast("long").alias("n"))


@query("SELECT tid, class, (CASE WHEN tid % 5 = 0 THEN -1 WHEN tid % 7 > 0 THEN 1 END)::INT AS pred FROM targets")
def outliers_written(spark, sf_dir):
    t = adapters.targets(spark, sf_dir)
    told = t.where("tid % 5 = 0 or tid % 7 > 0").select("tid", F.when(col("tid") % 5 == 0, -1).otherwise(1).alias("pred"))
    genome.write_outliers(t, told, ["tid"], path := folder(t))
    return text.read_table(spark, path, "tid bigint, contig string, s bigint, e bigint, class string, pred int").select("tid", "class", "pred")


@query("SELECT id, qname, s FROM alns WHERE qname IN (SELECT qname FROM alns WHERE id % 10 = 0)")
def matching_written(spark, sf_dir):
    a = adapters.alignments(spark, sf_dir)
    genome.write_matching(a, a.where("id % 10 = 0").select("qname"), path := folder(a))
    return spark.read.parquet(path).select("id", "qname", "s")


@query("SELECT contig || ':' || s || '-' || e AS region FROM targets")
def stages_resumed(spark, sf_dir):
    """A stage that an earlier run finished is read, not built again."""
    t = adapters.targets(spark, sf_dir)
    at = shared_folder(spark)
    genome.resumed(spark, at, "stage", lambda: t)
    again = genome.resumed(spark, at, "stage", lambda: t.where("false"))
    return genome.regions_of(again)


@query("""x1 AS (SELECT regexp_replace(contig, '^chr', '') AS contig, s, e, mapq FROM reads WHERE s > 0), x2 AS (SELECT tid, greatest(0, least(x1.e, t.e) - greatest(x1.s + 1, t.s) + 1) AS k, mapq FROM targets t JOIN x1 ON x1.contig = t.contig AND x1.s < t.e AND t.s < x1.e),
x3 AS (SELECT tid, sum(k * mapq)::DOUBLE / nullif(sum(k), 0) AS m FROM x2 GROUP BY tid) SELECT tid, round(coalesce(m, 0.0), 6)::DOUBLE AS mean FROM targets LEFT JOIN x3 USING (tid)""")
def track_tables(spark, sf_dir):
    """A score track as a table by contig, and its mean over intervals."""
    from seqloom.operators.sweeps import track_mean

    r = adapters.reads(spark, sf_dir)
    genome.track_table(r.select(F.concat(lit("chr"), "contig").alias("contig"), "s", "e", col("mapq").alias("score")), path := folder(r))
    return track_mean(adapters.targets(spark, sf_dir), spark.read.parquet(path), "tid", "score").select("tid", F.round("mean", 6).alias("mean"))
