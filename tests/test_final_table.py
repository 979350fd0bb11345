"""The final table is dealt as one text a row."""

from seqloom.sources import genome


def test_rows_of_the_table_are_dealt_as_texts(spark, tmp_path, monkeypatch):
    odd = ["a", "a\x1fb", "x\x1f\x1fy", "", None, "NA", 'q"t', "tab\there", "é", "two words"]
    rows = [(f"u{i:03}", f"chr{i % 3}", str(500 - i), odd[i % 10], odd[(i * 7 + 3) % 10]) for i in range(300)]
    calls = spark.createDataFrame(rows, "UUID string, Chromosome string, Left_Extreme string, `5_Prime.End` string, Last string").repartition(7)
    dealt, write = [], genome.write_table

    def noted(df, *args):
        dealt.append(df._jdf.queryExecution().optimizedPlan().toString())
        write(df, *args)

    monkeypatch.setattr(genome, "write_table", noted)
    told = []
    for codec in ("none", "lz4"):
        genome.write_calls(calls, path := str(tmp_path / codec), calls.columns, codec)
        told.append(genome.read_table_twice(spark, path)[1])
    assert "_line" in dealt[0] and list((tmp_path / "lz4").glob("part-*.lz4"))
    want = sorted(tuple("NA" if c is None else c for c in x) for x in rows)
    assert sorted(tuple(c or "" for c in x) for x in told[0].collect()) == sorted(tuple(c or "" for c in x) for x in told[1].collect()) == want
    files = sorted((tmp_path / "none").glob("part-*"))
    lines = [x for f in files for x in f.read_text().splitlines()[1:]]
    places = [(x.split("\t")[1], int(x.split("\t")[2])) for x in lines]
    assert places == sorted(places) and len(places) == 300
