"""Readers and writers of alignments, tracks, gene and repeat tables, lists and logs. Lines that lack what a reader needs
are left out; numbers that are none become null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.sequences import region_text
from seqloom.scratch import saved
from seqloom.sources.text import read_fasta, write_table

#: Formats whose rows bring their file.
INDEXED = {"bam", "tabix", "fasta", "bigwig"}
#: Fixed value: a separator that texts seldom hold.
BETWEEN = "\x1f"
#: Columns of the gene table in order.
GENE = "bin name chrom strand tx_start tx_end cds_start cds_end exon_count exon_starts exon_ends score name2 cds_start_stat cds_end_stat exon_frames".split()
#: What the four kinds of lines of a run log look like.
LOG = {
    "started": r"^(\S+ \S+?)[,.]?\d* .*Processing chunk: (\S+)", "finished": r"^(\S+ \S+?)[,.]?\d* .*Finished chunk: (\S+)",
    "skipped": r"^(\S+ \S+?)[,.]?\d* .*Skipped chunk: (\S+)", "failed": r"^(\S+ \S+?)[,.]?\d* .*Error in chunk: (\S+)",
}


def fields(spark: SparkSession, path: str, sep: str = r"\t", comment: str = "#") -> DataFrame:
    """c: the fields of each line that is neither empty nor a comment."""
    return fields_of(spark.read.text(path), sep, comment)


def fields_of(lines: DataFrame, sep: str = r"\t", comment: str = "#") -> DataFrame:
    rows = lines.where((F.trim("value") != "") & ~F.startswith("value", F.lit(comment)))
    return rows.withColumn("c", F.split(F.trim("value") if sep == r"\s+" else F.col("value"), sep)).drop("value")


def at(i: int, kind: str = "string") -> Column:
    got = F.get("c", F.lit(i))
    return got if kind == "string" else got.try_cast(kind)


def listed(spark: SparkSession, spec: str) -> list[tuple[str, str]]:
    """(path, sample) of what spec names: paths joined by commas, or a .txt file with a path a line. The sample is the
    file's name without its ending. The list is all that the driver reads; a path that is named twice counts once."""
    paths = [r.value for r in spark.read.text(spec).collect()] if spec.endswith(".txt") else spec.split(",")
    return [(p, p.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]) for p in dict.fromkeys(x.strip() for x in paths) if p]


def read_samples(spark: SparkSession, spec: str, read: Callable[[DataFrame], DataFrame] | None = None, form: str = "parquet", **options: str) -> DataFrame:
    """The rows of all files that spec names (see listed), each with its sample: one scan of any number of files, whose
    paths meet the list of names.

    form is that of spark.read; a path is a file, or a folder of files. read makes rows of what is read (with its column sample); rows of
    one of the indexed sources bring their file, as it was named. Empty files give no rows.
    """
    named = listed(spark, spec)
    if not named:
        raise ValueError(f"{spec} names no file")
    reader = spark.read.format(form).options(**options)
    if form in INDEXED:
        rows, here = reader.load(",".join(p for p, _ in named)), [F.col("file")]
        names = spark.createDataFrame(named, "_path string, sample string")
    else:
        rows, at = reader.load([p for p, _ in named]), plain(F.col("_metadata.file_path"))
        rows = rows.select("*", at.alias("_file"))
        here = [F.col("_file"), F.regexp_replace("_file", "/[^/]*$", "")]
        path = spark._jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        full = [(path(p).getFileSystem(conf).makeQualified(path(p)).toUri().toString(), sample) for p, sample in named]
        names = spark.createDataFrame(full, "_path string, sample string").select(plain(F.col("_path")).alias("_path"), "sample")
    for k, key in enumerate(here):
        rows = rows.join(names.select(F.col("_path").alias(f"_path{k}"), F.col("sample").alias(f"_sample{k}")), key == F.col(f"_path{k}"), "left")
    rows = rows.withColumn("sample", F.coalesce(*[f"_sample{k}" for k in range(len(here))])).drop("_file", *[f"{c}{k}" for k in range(len(here)) for c in ("_path", "_sample")])
    return read(rows) if read else rows


def plain(path: Column) -> Column:
    """A path as file systems write it, whether with one slash behind its scheme or three; a trailing one goes."""
    return F.regexp_replace(F.regexp_replace(path, "^file:/+", "file:/"), "/+$", "")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return sam_rows(spark.read.text(path))


def sam_rows(lines: DataFrame) -> DataFrame:
    """Alignments of lines (value) of SAM text, with their sample if they have one: qname, flag, contig, s, e (half-open, 0-based; null where unmapped), mapq, cigar, mate_contig,
    mate_s, tlen, seq, qual, tags (map)."""
    rows = fields_of(lines, comment="@").where(F.size("c") >= 11)
    star = lambda c: F.nullif(c, F.lit("*"))
    span = F.aggregate(F.transform(F.regexp_extract_all(at(5), F.lit(r"(\d+)[MDN=X]")), lambda v: v.cast("bigint")), F.lit(0).cast("bigint"), lambda a, v: a + v)
    s = F.nullif(at(3, "bigint"), F.lit(0)) - 1
    tags = F.transform(F.filter(F.slice(F.col("c"), 12, F.greatest(F.size("c"), F.lit(1))), lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:.:")), lambda x: F.struct(F.substring(x, 1, 2), F.substring(x, F.lit(6), F.length(x))))
    mate = F.when(at(6) == "=", star(at(2))).otherwise(star(at(6)))
    return rows.select(
        at(0).alias("qname"), at(1, "int").alias("flag"), star(at(2)).alias("contig"), s.alias("s"), (s + F.when(at(5) != "*", span)).alias("e"), at(4, "int").alias("mapq"), star(at(5)).alias("cigar"),
        mate.alias("mate_contig"), (F.nullif(at(7, "bigint"), F.lit(0)) - 1).alias("mate_s"), at(8, "bigint").alias("tlen"), star(at(9)).alias("seq"), star(at(10)).alias("qual"), F.map_from_entries(tags).alias("tags"), *[c for c in rows.columns if c == "sample"])


def read_pileup(spark: SparkSession, path: str) -> DataFrame:
    rows = fields(spark, path, r"\s+").select(at(0).alias("contig"), at(1, "bigint").alias("pos"), at(2).alias("base"), at(3, "int").alias("depth"))
    return rows.where("pos is not null and depth is not null")


def read_variants(spark: SparkSession, path: str, single: bool = False) -> DataFrame:
    """contig, pos, name, ref, alt, variant (pos:ref>alt) of VCF lines; single: only where ref and alt are of one length."""
    rows = fields(spark, path).where(F.size("c") >= 5).select(at(0).alias("contig"), at(1, "bigint").alias("pos"), at(2).alias("name"), at(3).alias("ref"), at(4).alias("alt"))
    rows = rows.where("pos is not null").withColumn("variant", F.concat(F.col("pos").cast("string"), F.lit(":"), "ref", F.lit(">"), "alt"))
    return rows.where("length(ref) = length(alt)") if single else rows


def read_table_twice(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A tab-separated table with a header: with NA as null, and word for word."""
    read = lambda: spark.read.option("sep", "\t").option("header", True)
    return read().option("nullValue", "NA").csv(path), read().csv(path)


def read_repeats(spark: SparkSession, path: str, types: list[str], contigs: list[str], most_left: int = 150, most_divergence: float = 20.0) -> DataFrame:
    """contig, s, e, strand, type, divergence of repeat-mask lines near the end of their element (start in it plus what is
    left under most_left), on contigs that are there with or without a leading chr; heading lines are left out."""
    rows = fields(spark, path, r"\s+").where(at(0, "int").isNotNull() & (F.size("c") >= 14))
    inner = lambda i: F.regexp_replace(at(i), "[()]", "").try_cast("int")
    minus = at(8) == "C"
    start, left = F.when(minus, inner(13)).otherwise(inner(11)), F.when(minus, inner(11)).otherwise(inner(13))
    bare = F.regexp_replace(at(4), "^chr", "")
    known = F.when(at(4).isin(contigs), at(4)).when(bare.isin(contigs), bare).when(F.concat(F.lit("chr"), bare).isin(contigs), F.concat(F.lit("chr"), bare))
    out = rows.select(known.alias("contig"), (at(5, "bigint") - 1).alias("s"), at(6, "bigint").alias("e"), F.when(minus, "-").otherwise("+").alias("strand"), at(9).alias("type"), at(1, "double").alias("divergence"), start.alias("_start"), left.alias("_left"))
    return out.where(F.col("contig").isNotNull() & (F.col("_start") + F.col("_left") < most_left) & (F.col("divergence") <= most_divergence) & F.col("type").isin(types)).drop("_start", "_left")


def repeat_targets(repeats: DataFrame, families: dict[str, str], human: bool = True, most_divergence: float | None = None) -> DataFrame:
    """contig, s, e, class, family, name, strand of repeat lines (genoName, genoStart, genoEnd, strand, repName, repClass,
    repFamily, milliDiv) for each family whose pattern their name, class or family matches; one row for each that does.
    Human tables lose a leading chr, C is the - strand, and class Other of the SVA family is SVA."""
    text = F.concat_ws(" ", "repName", "repClass", "repFamily")
    contig = F.regexp_replace("genoName", "^chr", "") if human else F.col("genoName")
    rows = repeats if most_divergence is None else repeats.where(F.col("milliDiv") / 10 < most_divergence)
    out = None
    for family, pattern in families.items():
        kind = F.when(F.lit(human and family == "SVA") & (F.col("repClass") == "Other"), "SVA").otherwise(F.col("repClass"))
        one = rows.where(text.contains(pattern)).select(contig.alias("contig"), F.col("genoStart").alias("s"), F.col("genoEnd").alias("e"), kind.alias("class"), F.lit(family).alias("family"), F.col("repName").alias("name"), F.when(F.col("strand") == "C", "-").otherwise(F.col("strand")).alias("strand"))
        out = one if out is None else out.unionByName(one)
    return out


def read_genes(spark: SparkSession, path: str, pad: int = 0) -> DataFrame:
    """name, gene, contig, strand, s, e (padded, from 0), exon_starts, exon_ends (arrays) of gene tables."""
    rows = fields(spark, path).where(F.size("c") >= 13)
    col = {name: i for i, name in enumerate(GENE)}
    numbers = lambda name: F.transform(F.filter(F.split(at(col[name]), ","), lambda x: x != ""), lambda x: x.try_cast("bigint"))
    s, e = at(col["tx_start"], "bigint"), at(col["tx_end"], "bigint")
    return rows.select(at(col["name"]).alias("name"), at(col["name2"]).alias("gene"), at(col["chrom"]).alias("contig"), at(col["strand"]).alias("strand"),
        F.greatest(s - pad, F.lit(0)).alias("s"), (e + pad).alias("e"), numbers("exon_starts").alias("exon_starts"), numbers("exon_ends").alias("exon_ends")).where("s is not null and e is not null")


def write_sorted_genes(genes: DataFrame, path: str) -> None:
    """Genes by contig and start, parts in that order."""
    genes.repartitionByRange("contig", "s").sortWithinPartitions("contig", "s", "name").write.mode("overwrite").parquet(path)


def read_transcripts(spark: SparkSession, path: str, tail: int = 50) -> DataFrame:
    """seq_id, seq of a FASTA of transcripts, with a poly-A tail put on."""
    return read_fasta(spark, path).withColumn("seq", F.concat("seq", F.repeat(F.lit("A"), tail)))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """name: the first token of every line."""
    return fields(spark, path, r"\s+", comment="\0").select(at(0).alias("name"))


def read_uuids(spark: SparkSession, path: str) -> DataFrame:
    """uuid: the first token of the lines whose first dash is its ninth character."""
    return read_names(spark, path).where(F.instr("name", "-") == 9).withColumnRenamed("name", "uuid")


def read_sample_names(spark: SparkSession, path: str, name_first: bool = False) -> DataFrame:
    """path, name of two-column lists, in either order."""
    a, b = at(0), at(1)
    return fields(spark, path, r"\s+").where(F.size("c") >= 2).select((b if name_first else a).alias("path"), (a if name_first else b).alias("name"))


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """contig, s, e, strand, name of five-column lists; another strand than + or - is an error."""
    rows = fields(spark, path, r"\s+").where(F.size("c") >= 5)
    strand = F.when(at(3).isin("+", "-"), at(3)).otherwise(F.raise_error(F.concat(F.lit("no strand: "), F.array_join("c", " "))))
    return rows.select(at(0).alias("contig"), at(1, "bigint").alias("s"), at(2, "bigint").alias("e"), strand.alias("strand"), at(4).alias("name"))


def read_run_log(spark: SparkSession, path: str, patterns: dict[str, str] = LOG) -> DataFrame:
    """kind, time, chunk of the lines of a run log that match one of the patterns (groups: time, chunk)."""
    kind = F.coalesce(*[F.when(F.col("value").rlike(p), k) for k, p in patterns.items()])
    group = lambda i: F.coalesce(*[F.nullif(F.regexp_extract("value", p, i), F.lit("")) for p in patterns.values()])
    rows = spark.read.text(path).select(kind.alias("kind"), F.try_to_timestamp(group(1), F.lit("yyyy-MM-dd HH:mm:ss")).alias("time"), group(2).alias("chunk"))
    return rows.where("kind is not null and time is not null")


def chunk_times(log: DataFrame) -> DataFrame:
    """chunk, took: seconds from first start to last finish as text, UNFINISHED without one."""
    first = log.where("kind = 'started'").groupBy("chunk").agg(F.min("time").alias("_from"))
    last = log.where("kind = 'finished'").groupBy("chunk").agg(F.max("time").alias("_to"))
    took = F.timestamp_diff("SECOND", F.col("_from"), F.col("_to")).cast("string")
    return first.join(last, "chunk", "left").select("chunk", F.coalesce(took, F.lit("UNFINISHED")).alias("took"))


def payload() -> Column:
    """All columns of a BED row (see read_bed) joined by |."""
    return F.concat_ws("|", "contig", F.col("s").cast("string"), F.col("e").cast("string"), "extra")


def tracks(named: dict[str, DataFrame]) -> DataFrame:
    """Union of tracks with their name as track."""
    out = None
    for name, df in named.items():
        one = df.withColumn("track", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def track_table(bed: DataFrame, path: str) -> None:
    """A score track (contig, s, e, score; a leading chr is dropped) as a table by contig, sorted by s: scans prune."""
    rows = bed.withColumn("contig", F.regexp_replace("contig", "^chr", ""))
    rows.repartitionByRange("contig", "s").sortWithinPartitions("contig", "s").write.mode("overwrite").partitionBy("contig").parquet(path)


def tiles(sequences: DataFrame, size: int = 65_536) -> DataFrame:
    """contig, tile, seq: sequences (contig, seq) cut into tiles of one size."""
    last = F.floor((F.length("seq") - 1) / size)
    cut = sequences.where(F.length("seq") > 0).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return cut.select("contig", "tile", F.substring(F.col("seq"), (F.col("tile") * size + 1).cast("int"), F.lit(size)).alias("seq"))


def fetched(regions: DataFrame, tiled: DataFrame, key: str, size: int = 65_536) -> DataFrame:
    """key, seq of regions (key, contig, s, e), cut off at the contig's ends; an empty text for what lies outside."""
    s, e = F.greatest("s", F.lit(0)), F.greatest("e", F.lit(0))
    asked = regions.select(key, "contig", s.alias("s"), e.alias("e")).withColumn("tile", F.explode(F.sequence(F.floor(F.col("s") / size), F.floor((F.greatest(F.col("e"), F.col("s") + 1) - 1) / size))))
    start = F.greatest(F.col("s") - F.col("tile") * size, F.lit(0))
    end = F.least(F.col("e") - F.col("tile") * size, F.lit(size))
    piece = F.substring(F.col("seq"), (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))
    got = asked.join(tiled, ["contig", "tile"]).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", piece.alias("p")))), lambda x: x["p"]), "").alias("seq"))
    return regions.select(key).join(got, key, "left").select(key, F.coalesce("seq", F.lit("")).alias("seq"))


def resumed(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stage's table if an earlier run finished it, else what build makes, written."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return spark.read.parquet(f"{folder}/{name}")
    return saved(build(), folder, name)


def write_details(calls: DataFrame, path: str, command: str, key: str) -> None:
    """A block a call, #BEGIN key, name: value lines in order of name, #END key; the command heads every part."""
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NA"))) for c in sorted(calls.columns)]
    text = F.concat_ws("\n", F.lit(f"##CMD: {command}"), F.concat(F.lit("#BEGIN "), F.col(key).cast("string")), *lines, F.concat(F.lit("#END "), F.col(key).cast("string")))
    calls.select(text.alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def write_calls(records: DataFrame, path: str, columns: list[str], compression: str = "none") -> None:
    """The final table: columns in order, NA for null, parts in the order of contig and start. Rows are dealt as one text each, which is
    shorter than a row of texts; those with the separator in a value as a list."""
    order = {"_contig": F.col("Chromosome"), "_start": F.col("Left_Extreme").cast("bigint"), "_key": F.col("UUID")}
    values = {f"_v{i}": F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NA")) for i, c in enumerate(columns)}
    rows = records.select(*[c.alias(k) for k, c in (order | values).items()]).withColumn("_line", F.concat_ws(BETWEEN, *values))
    plain = F.length("_line") - F.length(F.replace("_line", F.lit(BETWEEN), F.lit(""))) == len(columns) - 1
    dealt = rows.select(*order, F.when(plain, F.col("_line")).alias("_line"), F.when(~plain, F.array(*values)).alias("_list")).repartitionByRange(*order).sortWithinPartitions(*order)
    whole = dealt.select(F.coalesce("_list", F.split("_line", BETWEEN, -1)).alias("_list"))
    write_table(whole.select(*[F.col("_list")[i].alias(c) for i, c in enumerate(columns)]), path, compression)


def cluster_line(pad: int = 500) -> Column:
    """contig, start, end (padded, from 0), strand, samples, members, tab-separated, of cluster summaries."""
    return F.concat_ws("\t", "contig", F.greatest(F.col("start") - pad, F.lit(0)).cast("string"), (F.col("end") + pad).cast("string"), "strand", F.col("samples").cast("string"), F.col("n").cast("string"))


def write_by_contig(df: DataFrame, path: str, column: str = "contig") -> None:
    """A folder per contig; each task writes the contigs that it has, a hot one from many tasks."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def write_mask(bins: DataFrame, path: str, size: int) -> None:
    """#Chrom, Start, End, CPM, z of bins (contig, bin, cpm, z), tab-separated."""
    write_table(bins.orderBy("contig", "bin").select(F.col("contig").alias("#Chrom"), (F.col("bin") * size).alias("Start"), ((F.col("bin") + 1) * size).alias("End"), F.col("cpm").alias("CPM"), "z"), path)


def write_outliers(rows: DataFrame, predictions: DataFrame, key: list[str], path: str) -> None:
    """rows word for word with their pred (of key columns) as the last column."""
    write_table(rows.join(predictions.select(*key, "pred"), key, "left").select(*[F.col(f"`{c}`") for c in rows.columns], "pred"), path)


def write_elements(rows: DataFrame, path: str) -> None:
    """Reference elements as a table, rows that are null throughout left out."""
    write_table(rows.dropna("all"), path)


def regions_of(df: DataFrame) -> DataFrame:
    """region: contig:start-end of rows (contig, s, e)."""
    return df.select(region_text(F.col("contig"), F.col("s"), F.col("e")).alias("region"))


def write_matching(alignments: DataFrame, names: DataFrame, path: str) -> None:
    """All records of alignments whose name is among names (qname), with the same columns; names are few or many."""
    alignments.join(names.select("qname").distinct(), "qname", "left_semi").select(alignments.columns).write.mode("overwrite").parquet(path)
