"""Readers and writers there and back, and the limits of rules on single records."""

import pytest
from pyspark.sql import functions as F

from seqloom.functions import sequences as seqs
from seqloom.operators import alignments as aln
from seqloom.operators import breakends as brk
from seqloom.operators import callset
from seqloom.sources import genome, text


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_fasta_there_and_back(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">A:B x > y\nACG\nT\n>C\nGG\n>C again\nTT\n")
    read = text.read_fasta(spark, str(tmp_path / "a.fa"))
    assert rows(read, "seq_id") == [("A:B", "ACGT"), ("C", "TT")]
    text.write_fasta(read, str(tmp_path / "b"))
    assert rows(text.read_fasta(spark, str(tmp_path / "b")), "seq_id") == rows(read, "seq_id")
    assert rows(genome.read_transcripts(spark, str(tmp_path / "a.fa"), 2), "seq_id")[1] == ("C", "TTAA")


def test_sam_and_pileup_and_variants(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1\nq1\t99\tx\t11\t60\t3S5M2D1M\t=\t101\t90\tACGTACGTA\tIIIIIIIII\tNM:i:2\tRG:Z:a:b\nq2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\nbroken\n")
    got = genome.read_sam(spark, str(tmp_path / "a.sam")).orderBy("qname").collect()
    assert (got[0].contig, got[0].s, got[0].e, got[0].mate_contig, got[0].mate_s, got[0].tags) == ("x", 10, 18, "x", 100, {"NM": "2", "RG": "a:b"})
    assert (got[1].contig, got[1].s, got[1].e, got[1].seq) == (None, None, None, None) and len(got) == 2
    (tmp_path / "p").write_text("x 5 A 3\nx bad A 3\n")
    assert rows(genome.read_pileup(spark, str(tmp_path / "p"))) == [("x", 5, "A", 3)]
    (tmp_path / "v").write_text("#CHROM\nx\t5\t.\tA\tG\nx\t7\t.\tAC\tA\n")
    assert [r.variant for r in genome.read_variants(spark, str(tmp_path / "v"), True).collect()] == ["5:A>G"]
    assert genome.read_variants(spark, str(tmp_path / "v")).count() == 2


def test_lists_and_logs(spark, tmp_path):
    put = lambda name, body: ((tmp_path / name).write_text(body), str(tmp_path / name))[1]
    assert rows(genome.read_uuids(spark, put("u", "12345678-a b\n1-2\n\n"))) == [("12345678-a",)]
    assert rows(genome.read_names(spark, put("n", "x y\nz\n")), "name") == [("x",), ("z",)]
    names = put("s", "f.bam one\n")
    assert rows(genome.read_sample_names(spark, names)) == [("f.bam", "one")] and rows(genome.read_sample_names(spark, names, True)) == [("one", "f.bam")]
    assert rows(genome.read_elements(spark, put("e", "x\t1\t5\t+\tL1\n"))) == [("x", 1, 5, "+", "L1")]
    with pytest.raises(Exception, match="no strand"):
        genome.read_elements(spark, put("e2", "x\t1\t5\t?\tL1\n")).collect()
    log = put("l", "2016-01-01 10:00:00,001 INFO Processing chunk: 1:5-9\n2016-01-01 10:00:07,5 INFO Finished chunk: 1:5-9\n2016-01-01 10:00:08,5 INFO Processing chunk: 2:1-2\nother\n")
    assert rows(genome.chunk_times(genome.read_run_log(spark, log)), "chunk") == [("1:5-9", "7"), ("2:1-2", "UNFINISHED")]
    a, b = genome.read_table_twice(spark, put("t", "a\tb\nNA\t1\n"))
    assert rows(a) == [(None, "1")] and rows(b) == [("NA", "1")]
    listed = put("many.txt", put("x.bed", "c 1 2\n") + "\n")
    assert [(r["value"], r["sample"]) for r in genome.read_samples(spark, listed, form="text").collect()] == [("c 1 2", "x")]


def test_repeats_and_genes(spark, tmp_path):
    (tmp_path / "r").write_text("SW perc\nscore div\n\n100 5.0 0 0 chr1 11 20 (5) + L1HS LINE/L1 6 100 (10)\n100 5.0 0 0 1 11 20 (5) C L1HS LINE/L1 (10) 100 6\n100 30.0 0 0 1 11 20 (5) + L1HS LINE/L1 6 100 (10)\n")
    got = rows(genome.read_repeats(spark, str(tmp_path / "r"), ["L1HS"], ["1"]), "strand")
    assert got == [("1", 10, 20, "+", "L1HS", 5.0), ("1", 10, 20, "-", "L1HS", 5.0)]
    (tmp_path / "g").write_text("0\tNM_1\tchr1\t-\t100\t200\t0\t0\t2\t100,150,\t120,200,\t0\tGENE\tc\tc\t0,0,\n")
    g = genome.read_genes(spark, str(tmp_path / "g"), 1000).collect()[0]
    assert (g.gene, g.s, g.e, g.exon_starts, g.exon_ends) == ("GENE", 0, 1200, [100, 150], [120, 200])
    genome.write_sorted_genes(genome.read_genes(spark, str(tmp_path / "g")), str(tmp_path / "gs"))
    assert spark.read.parquet(str(tmp_path / "gs")).count() == 1
    mask = spark.createDataFrame([("chr1", 1, 9, "C", "SVA_E", "Other", "Other", 50)], "genoName string, genoStart long, genoEnd long, strand string, repName string, repClass string, repFamily string, milliDiv int")
    assert rows(genome.repeat_targets(mask, {"SVA": "SVA", "L1": "L1"})) == [("1", 1, 9, "SVA", "SVA", "SVA_E", "-")]
    assert genome.repeat_targets(mask, {"SVA": "SVA"}, False, 5.0).count() == 0


def test_tiles_and_tracks(spark, tmp_path):
    whole = "ACGTT" * 50
    tiled = genome.tiles(spark.createDataFrame([("x", whole)], "contig string, seq string"), 16)
    ask = [(1, "x", 0, 10), (2, "x", 10, 40), (3, "x", 245, 400), (4, "y", 0, 5), (5, "x", 7, 7), (6, "x", -5, 3)]
    got = dict(rows(genome.fetched(spark.createDataFrame(ask, "id int, contig string, s long, e long"), tiled, "id", 16)))
    assert got == {i: whole[max(0, s) : max(0, e)] if c == "x" else "" for i, c, s, e in ask}
    track = spark.createDataFrame([("chr1", 5, 9, 0.5), ("chr1", 0, 5, 1.0)], "contig string, s long, e long, score double")
    genome.track_table(track, str(tmp_path / "t"))
    assert rows(spark.read.parquet(str(tmp_path / "t")).select("contig", "s"), "s") == [(1, 0), (1, 5)]
    assert {r.track for r in genome.tracks({"a": track, "b": track}).collect()} == {"a", "b"}
    bed = spark.createDataFrame([("x", 1, 2, ["n", "+"])], "contig string, s long, e long, extra array<string>")
    assert bed.select(genome.payload()).first()[0] == "x|1|2|n|+"


def test_sinks(spark, tmp_path):
    calls = spark.createDataFrame([("u2", "x", "7", None), ("u1", "x", "5", "PASS")], "UUID string, Chromosome string, Left_Extreme string, Filter string")
    genome.write_details(calls, str(tmp_path / "d"), "run", "UUID")
    body = "".join(r.value for r in spark.read.option("wholetext", True).text(str(tmp_path / "d")).collect())
    assert body.count("#BEGIN u") == 2 and "Filter: NA" in body and "##CMD: run" in body
    genome.write_calls(calls.coalesce(1), str(tmp_path / "c"), calls.columns)
    assert rows(spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "c")), "UUID") == [("u1", "x", "5", "PASS"), ("u2", "x", "7", "NA")]
    clusters = spark.createDataFrame([("x", 100, 900, "+", 2, 5)], "contig string, start long, end long, strand string, samples long, n long")
    assert clusters.select(genome.cluster_line()).first()[0] == "x\t0\t1400\t+\t2\t5"
    genome.write_by_contig(clusters, str(tmp_path / "by"))
    assert (tmp_path / "by" / "contig=x").exists()
    genome.write_mask(spark.createDataFrame([("x", 2, 0.5, 3.0)], "contig string, bin long, cpm double, z double"), str(tmp_path / "m"), 100)
    assert rows(spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "m"))) == [("x", "200", "300", "0.5", "3.0")]
    genome.write_elements(spark.createDataFrame([("x", 1), (None, None)], "a string, b int"), str(tmp_path / "el"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "el")).count() == 1
    genome.write_outliers(calls, spark.createDataFrame([("u1", -1)], "UUID string, pred int"), ["UUID"], str(tmp_path / "o"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "o")).columns[-1] == "pred"
    made = []
    build = lambda: made.append(1) or calls
    for _ in range(2):
        assert genome.resumed(spark, f"file://{tmp_path}/stages", "one", build).count() == 2
    assert len(made) == 1


def reads(spark, *given):
    kind = "id int, flag int, contig string, s long, e long, mapq int, cigar string, seq string, qname string, sample string, mate_contig string, mate_s long, p double"
    return spark.createDataFrame(given, kind)


def test_distances_of_mates(spark):
    r = reads(spark, *[(i, f, "x", 100, 150, 20, "50M", "A" * 50, "q", "a", c, s, 1.0) for i, f, c, s in [(1, 1, "x", 10_100), (2, 1, "x", 10_101), (3, 1, "y", 100), (4, 1 | 8, None, None), (5, None, "y", 1), (6, 1 | 1024, "y", 1)]])
    assert rows(aln.discordant(r).select("id", "kind"), "id") == [(2, "mapped"), (3, "mapped"), (4, "unmapped")]
    assert [x.id for x in aln.anchored(r).orderBy("id").collect()] == [1, 2, 3]


def test_genotypes_count_clips_at_the_limits(spark):
    def read(i, s, e, cigar, mapq=10):
        return (i, 1, "x", s, e, mapq, cigar, "A", "q", "a", None, None, 1.0)

    site = spark.createDataFrame([(1, "x", 100, 108)], "tid int, contig string, s long, e long")
    for given, want in [(read(1, 101, 200, "9S99M"), (1, 0)), (read(1, 102, 200, "9S98M"), (0, 0)), (read(1, 101, 200, "8S99M"), (0, 0)), (read(1, 50, 200, "150M"), (0, 1)), (read(1, 50, 200, "150M", 9), (0, 0)), (read(1, 50, 109, "59M20S"), (1, 0))]:
        got = brk.break_counts(reads(spark, given), site).collect()
        assert [(x.alt, x.ref) for x in got] == [want], given
    assert rows(brk.break_counts(reads(spark, read(1, 5, 9, "4M")), site)) == [(1, "a", 0, 0)]


def test_rules_on_missing_values(spark):
    df = spark.createDataFrame([("NA", "NA", "30", "20"), ("A" * 12, "A" * 12, "300", "NA"), ("ACGT", "ACGA", "200", "100"), ("ACGT", "TTTT", "200", "100")], "TSD_5prime string, TSD_3prime string, `5p_Cons_Len` string, `3p_Cons_Len` string")
    for c in "Insert_Consensus_5p Insert_Consensus_3p Genotypes Variants Genomic_Consensus_3p TE_Align_Start TE_Align_End Remapped_Discordant Split_reads_5prime Split_reads_3prime".split():
        df = df.withColumn(c, F.lit("9"))
    for c in "5p_Elt_Match 3p_Elt_Match 5p_Genome_Match 3p_Genome_Match".split():
        df = df.withColumn(c, F.lit("1.0"))
    df = df.withColumns({"Superfamily": F.lit("L1"), "Subfamily": F.lit("a")})
    known = spark.createDataFrame([("L1:a", 6000)], "element string, length int")
    got = [r.Filter for r in callset.final_filter(df.coalesce(1), known).collect()]
    assert got == ["TotalConsLen", "LongHomopolTSD", "PASS", "MismatchTSD"]
    assert {r.Filter for r in callset.final_filter(df, known.where("length = 0")).collect()} == {"UnknownInsType"}


def test_runs_of_21_and_22(spark):
    base = spark.createDataFrame([(n,) for n in (21, 22)], "n int").withColumn("seq", F.concat(F.lit("C"), F.expr("repeat('A', n)"), F.lit("G")))
    assert [r.x for r in base.orderBy("n").select((seqs.homopolymer(F.col("seq"), "A") > 20).alias("x")).collect()] == [False, True]
    assert base.select(seqs.homopolymer_start(F.col("seq"), "A").alias("x")).first().x == 1
    row = spark.range(1).select(seqs.match_fraction(F.lit(1), F.lit(0)).alias("a"), seqs.region_parts(F.lit("HLA:1:5-9")).alias("b"), seqs.quality_trimmed(F.lit("ACGTACGT"), F.lit("III#####"), 35).alias("c"), seqs.columns_matched(F.lit("AC-g"), F.lit("Ac-T")).alias("d")).first()
    assert row.a is None and tuple(row.b) == ("HLA:1", 5, 9) and row.c == "ACG" and row.d == 2


def test_cascade_of_duplicates(spark):
    kind = "uuid string, chrom string, be1_breakpos long, be2_breakpos long, be1_sr_count int, be2_sr_count int, dr_count int"
    calls = [("a", "x", 10, 10, 5, 0, 9), ("b", "x", 10, 17, 1, 1, 1), ("c", "x", 10, 17, 1, 0, 3), ("d", "x", 50, 50, 1, 0, 1), ("e", "y", 10, 10, 1, 0, 1)]
    got = callset.cascaded(spark.createDataFrame(calls, kind), "uuid").collect()
    assert sorted(r.uuid for r in got) == ["c", "d", "e"]
    best = callset.duplicates_resolved(spark.createDataFrame(calls, kind), ["uuid"]).collect()
    assert sorted(r.uuid for r in best) == ["b", "d", "e"]
