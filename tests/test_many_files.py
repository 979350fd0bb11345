"""Thousands of files as one scan, with the names that a list gives them."""

from seqloom.sources import genome


def test_a_thousand_files_are_one_scan(spark, tmp_path):
    paths = []
    for k in range(1000):
        (tmp_path / f"s{k}.sam").write_text(f"@HD\n" + "".join(f"q{k}.{i}\t0\tc1\t{i + 1}\t9\t5M\t*\t0\t0\tACGTA\tIIIII\n" for i in range(k % 3)))
        paths.append(str(tmp_path / f"s{k}.sam"))
    (tmp_path / "list.txt").write_text("\n".join([*paths, "", paths[0]]) + "\n")
    df = genome.read_samples(spark, str(tmp_path / "list.txt"), genome.sam_rows, form="text")
    got = df.select("qname", "sample", "e").collect()
    assert sorted((r.qname, r["sample"], r.e) for r in got) == sorted((f"q{k}.{i}", f"s{k}", i + 5) for k in range(1000) for i in range(k % 3))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Union" not in plan


def test_folders_and_odd_names(spark, tmp_path):
    for name in ("a b", "ü", "c.d"):
        spark.range(3).repartition(2).write.parquet(str(tmp_path / f"{name}.parquet"))
    spec = ",".join(f"{'file://' if name == 'ü' else ''}{tmp_path}/{name}.parquet" for name in ("a b", "ü", "c.d")).replace("a b.parquet", "a b.parquet/")
    got = genome.read_samples(spark, spec).groupBy("sample").count().collect()
    assert sorted((r["sample"], r["count"]) for r in got) == [("a b", 3), ("c.d", 3), ("ü", 3)]


def test_samples_of_an_indexed_source(spark, tmp_path):
    from seqloom.sources import indexed

    indexed.register(spark)
    for name in ("x", "y"):
        (tmp_path / f"{name}.fa").write_text(">c\nACGT\n")
        (tmp_path / f"{name}.fa.fai").write_text("c\t4\t3\t4\t5\n")
    got = genome.read_samples(spark, f"{tmp_path}/x.fa,{tmp_path}/y.fa", form="fasta").collect()
    assert sorted((r["sample"], r.seq) for r in got) == [("x", "ACGT"), ("y", "ACGT")]
