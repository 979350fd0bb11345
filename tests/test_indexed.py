"""Sources that plan by an index: fixtures written here, read whole and by region, with the blocks that were opened."""

import random
import struct
import zlib

import pytest

from seqloom.sources import genome, indexed

REFS = [("c1", 400_000), ("c2", 90_000), ("c3", 1000)]


def bgzf(pieces, most=2000):
    """A BGZF file of pieces of data, none of which is split; the virtual offsets of their beginnings, and of the end."""
    out, offsets, held, places = b"", [], b"", []

    def flush():
        nonlocal out, held
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = packer.compress(held) + packer.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(data) + 25) + data + struct.pack("<II", zlib.crc32(held), len(held))
        held = b""

    for p in pieces:
        if held and len(held) + len(p) > most:
            flush()
        offsets.append(len(out) << 16 | len(held))
        held += p
    flush()
    end = len(out) << 16
    flush()  # the empty block at the end
    return out, [*offsets, end]


def bin_of(s, e):
    e -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if s >> shift == e >> shift:
            return first + (s >> shift)
    return 0


def binned_index(rows, n_refs):
    """Bins and linear index of (ref, s, e, begin, end) in order."""
    out = b""
    for ref in range(n_refs):
        bins, linear = {}, {}
        for r, s, e, begin, end in rows:
            if r == ref:
                chunks = bins.setdefault(bin_of(s, e), [])
                if chunks and chunks[-1][1] == begin:
                    chunks[-1] = (chunks[-1][0], end)
                else:
                    chunks.append((begin, end))
                for w in range(s >> 14, ((e - 1) >> 14) + 1):
                    linear.setdefault(w, begin)
        out += struct.pack("<i", len(bins)) + b"".join(struct.pack("<Ii", b, len(c)) + b"".join(struct.pack("<QQ", *x) for x in c) for b, c in sorted(bins.items()))
        n = max(linear, default=-1) + 1
        filled, last = [], 0
        for w in range(n):
            last = linear.get(w, last)
            filled.append(last)
        out += struct.pack("<i", n) + struct.pack(f"<{n}Q", *filled)
    return out


def alignment(i, r):
    ref = r.choices([0, 1, 2, -1], [8, 4, 0, 1])[0]
    pos = r.randrange(REFS[ref][1] - 400) if ref >= 0 else -1
    cigar = [] if ref < 0 else r.choice([[(30, "M")], [(5, "S"), (20, "M"), (300, "N"), (5, "M")], [(10, "M"), (2, "I"), (3, "D"), (18, "M")]])
    n = sum(k for k, o in cigar if o in "MIS") or 25
    return {"name": f"r{i}", "flag": 0 if ref >= 0 else 4, "ref": ref, "pos": pos, "cigar": cigar, "seq": "".join(r.choice("ACGTN") for _ in range(n)), "qual": [r.randrange(40) for _ in range(n)] if i % 5 else None, "mapq": r.randrange(60), "mate": (ref, pos), "tlen": r.randrange(-500, 500), "nm": i % 300}


def record(x):
    seq = x["seq"] + "=" * (len(x["seq"]) % 2)
    packed = bytes(indexed.BASES.index(a) << 4 | indexed.BASES.index(b) for a, b in zip(seq[::2], seq[1::2], strict=True))
    cigar = b"".join(struct.pack("<I", n << 4 | indexed.OPERATIONS.index(o)) for n, o in x["cigar"])
    tags = b"NMi" + struct.pack("<i", x["nm"]) + b"RGZg1\0" + b"XAAq" + b"XBBs" + struct.pack("<i2h", 2, -3, 7) + b"XFf" + struct.pack("<f", 0.5)
    name = x["name"].encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", x["ref"], x["pos"], len(name), x["mapq"], 0, len(x["cigar"]), x["flag"], len(x["seq"]), *x["mate"], x["tlen"])
    body += name + cigar + packed + (bytes(x["qual"]) if x["qual"] else b"\xff" * len(x["seq"])) + tags
    return struct.pack("<i", len(body)) + body


def span(x):
    return sum(k for k, o in x["cigar"] if o in "MDN=X")


@pytest.fixture(scope="module")
def bam(tmp_path_factory):
    r, path = random.Random(7), str(tmp_path_factory.mktemp("bam") / "a.bam")
    rows = sorted((alignment(i, r) for i in range(3000)), key=lambda x: (x["ref"] % 4, x["pos"]))
    header = b"BAM\x01" + struct.pack("<i", 900) + b"@CO\t" + b"x" * 896 + struct.pack("<i", 3) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in REFS)
    data, at = bgzf([header[:500], header[500:], *map(record, rows)])
    places = [(x["ref"], x["pos"], x["pos"] + max(1, span(x)), at[i + 2], at[i + 3]) for i, x in enumerate(rows) if x["ref"] >= 0]
    open(path, "wb").write(data)
    open(f"{path}.bai", "wb").write(b"BAI\x01" + struct.pack("<i", 3) + binned_index(places, 3) + struct.pack("<Q", 5))
    return path, rows


def names(df):
    return sorted(r.qname for r in df.select("qname").collect())


def test_bam_whole(spark, bam):
    indexed.register(spark)
    path, rows = bam
    df = spark.read.format("bam").option("part_bytes", 10_000).load(path)
    assert df.rdd.getNumPartitions() > 5
    got = {r.qname: r for r in df.collect()}
    assert len(got) == df.count() == len(rows)
    for x in rows:
        g, mapped = got[x["name"]], x["ref"] >= 0
        assert (g.flag, g.contig, g.s, g.mapq, g.tlen) == (x["flag"], REFS[x["ref"]][0] if mapped else None, x["pos"] if mapped else None, x["mapq"], x["tlen"])
        assert g.e == (x["pos"] + span(x) if mapped else None) and g.cigar == ("".join(f"{n}{o}" for n, o in x["cigar"]) or None)
        assert g.seq == x["seq"] and g.qual == (None if not x["qual"] else "".join(chr(q + 33) for q in x["qual"]))
        assert g.tags == {"NM": str(x["nm"]), "RG": "g1", "XA": "q", "XB": "s,-3,7", "XF": "0.5"} and g.mate_contig == g.contig and g.file == path
    assert set(genome.read_sam(spark, __file__).columns) == set(df.columns) - {"file"}


@pytest.mark.parametrize("regions", [[("c1", 100_000, 130_000)], [("c2", 0, 90_000), ("c1", 16_384, 16_385)], [("c3", 0, 1000)], [("nowhere", 0, 9)], [("c1", 5000, 5200), ("c1", 5100, 70_000)]])
def test_bam_regions(spark, bam, regions):
    indexed.register(spark)
    path, rows = bam
    want = sorted(x["name"] for x in rows if x["ref"] >= 0 and any(REFS[x["ref"]][0] == c and x["pos"] < e and s < x["pos"] + max(1, span(x)) for c, s, e in regions))
    df = spark.read.format("bam").option("regions", ",".join(f"{c}:{s}-{e}" for c, s, e in regions)).option("part_bytes", 20_000).load(path)
    assert names(df) == want


def test_bam_opens_only_the_blocks_of_its_region(bam):
    path, rows = bam
    counts = []
    blocks_of = indexed.Blocks.data

    def counted(self, *args):
        for at, block in blocks_of(self, *args):
            counts.append(at)
            yield at, block

    indexed.Blocks.data = counted
    try:
        for regions in (None, "c1:200000-201000"):
            reader = indexed.BamReader({"path": path} | ({"regions": regions} if regions else {}))
            parts = reader.partitions()
            counts.clear()
            n = sum(len(b) for p in parts for b in reader.read(p))
            if regions is None:
                whole = len(set(counts))
                assert n == len(rows)
            else:
                assert 0 < n < 60 and len(set(counts)) < whole / 8
    finally:
        indexed.Blocks.data = blocks_of


def test_bam_conditions_choose_blocks(spark, bam):
    indexed.register(spark)
    path, rows = bam
    df = spark.read.format("bam").load(path).where("contig = 'c1' and s < 130000 and e > 100000")
    assert names(df) == sorted(x["name"] for x in rows if x["ref"] == 0 and x["pos"] < 130_000 and 100_000 < x["pos"] + span(x))
    reader = indexed.BamReader({"path": path})
    reader.pushFilters([indexed.EqualTo(("contig",), "c1"), indexed.LessThan(("s",), 130_000), indexed.GreaterThanOrEqual(("e",), 100_001)])
    assert reader.regions == [("c1", 100_000, 130_000)]


@pytest.fixture(scope="module")
def bed(tmp_path_factory):
    r, path = random.Random(8), str(tmp_path_factory.mktemp("bed") / "a.bed.gz")
    rows = sorted((r.randrange(2), s := r.randrange(300_000), s + 1 + r.randrange(900), i) for i in range(2500))
    lines = [f"{REFS[c][0]}\t{s}\t{e}\tn{i}\n".encode() for c, s, e, i in rows]
    data, at = bgzf([b"#head\n", *lines], 1500)
    open(path, "wb").write(data)
    index = struct.pack("<8i", 2, 0x10000, 1, 2, 3, ord("#"), 0, 6) + b"c1\0c2\0" + binned_index([(c, s, e, at[k + 1], at[k + 2]) for k, (c, s, e, i) in enumerate(rows)], 2)
    open(f"{path}.tbi", "wb").write(bgzf([b"TBI\x01" + index], 1 << 15)[0])
    return path, rows


def test_tabix(spark, bed):
    indexed.register(spark)
    path, rows = bed
    lines = lambda df: sorted(int(r.line.split("\tn")[1]) for r in df.collect())
    whole = spark.read.format("tabix").option("part_bytes", 5000).load(path)
    assert whole.rdd.getNumPartitions() > 3 and lines(whole) == list(range(2500))
    some = spark.read.format("tabix").option("regions", "c2:1000-2000,c1:299000-310000").load(path)
    assert lines(some) == sorted(i for c, s, e, i in rows if (c == 1 and s < 2000 and 1000 < e) or (c == 0 and s < 310_000 and 299_000 < e))
    assert spark.read.format("tabix").option("regions", "c9").load(path).count() == 0


def test_fasta_tiles(spark, tmp_path):
    indexed.register(spark)
    r, path, text, fai = random.Random(9), str(tmp_path / "g.fa"), "", ""
    seqs = {"a": 1003, "b": 60, "c": 0, "d": 241}
    seqs = {k: "".join(r.choice("ACGTacgtN") for _ in range(n)) for k, n in seqs.items()}
    for name, seq in seqs.items():
        text += f">{name} x\n"
        fai += f"{name}\t{len(seq)}\t{len(text)}\t60\t61\n"
        text += "".join(seq[i : i + 60] + "\n" for i in range(0, len(seq), 60))
    open(path, "w").write(text)
    open(f"{path}.fai", "w").write(fai)
    df = spark.read.format("fasta").option("tile", 100).option("part_bytes", 300).load(path)
    assert df.rdd.getNumPartitions() > 2
    for name, seq in seqs.items():
        assert "".join(x.seq for x in df.where(df.contig == name).orderBy("tile").collect()) == seq
    some = spark.read.format("fasta").option("tile", 100).option("regions", "a:150-201,d").load(path).select("contig", "tile").collect()
    assert sorted(map(tuple, some)) == [("a", 1), ("a", 2), ("d", 0), ("d", 1), ("d", 2)]
    got = genome.fetched(spark.createDataFrame([(1, "a", 95, 310)], "id long, contig string, s long, e long"), df.select("contig", "tile", "seq"), "id", 100).first()
    assert got.seq == seqs["a"][95:310]


def write_bigwig(path, order, packed, blocks, names):
    """blocks: (chromosome, kind, step, span, items), in order."""
    o, body, leaves = order, b"", []
    chroms = struct.pack(f"{o}IIIIQQ", 0x78CA8C91, 8, 4, 8, len(names), 0) + struct.pack(f"{o}BBH", 1, 0, len(names))
    chroms += b"".join(n.encode().ljust(4, b"\0") + struct.pack(f"{o}II", i, 1 << 20) for i, n in enumerate(names))
    first = 64 + len(chroms)
    for c, kind, step, width, items in blocks:
        s, e = items[0][0], items[-1][1]
        data = struct.pack(f"{o}IIIIIBBH", c, s, e, step, width, kind, 0, len(items))
        data += b"".join(struct.pack(f"{o}IIf", a, b, v) if kind == 1 else struct.pack(f"{o}If", a, v) if kind == 2 else struct.pack(f"{o}f", v) for a, b, v in items)
        data = zlib.compress(data) if packed else data
        leaves.append((c, s, c, e, first + len(body), len(data)))
        body += data
    root = first + len(body)
    node = lambda some: struct.pack(f"{o}BBH", 1, 0, len(some)) + b"".join(struct.pack(f"{o}IIIIQQ", *x) for x in some)
    groups = [leaves[i : i + 3] for i in range(0, len(leaves), 3)]
    inner_size = 4 + 24 * len(groups)
    tree, below = struct.pack(f"{o}BBH", 0, 0, len(groups)), b""
    for g in groups:
        tree += struct.pack(f"{o}IIIIQ", *g[0][:2], *g[-1][2:4], root + 48 + inner_size + len(below))
        below += node(g)
    index = struct.pack(f"{o}IIQIIIIQII", 0x2468ACE0, 3, len(leaves), 0, 0, 0, 0, root, 3, 0) + tree + below
    head = struct.pack(f"{o}IHHQQQHHQQIQ", 0x888FFC26, 4, 0, 64, first, root, 0, 0, 0, 0, 1 << 15 if packed else 0, 0)
    open(path, "wb").write(head + chroms + body + index)


@pytest.mark.parametrize("order,packed", [("<", True), (">", False)])
def test_bigwig(spark, tmp_path, order, packed):
    indexed.register(spark)
    r, path, blocks = random.Random(10), str(tmp_path / "m.bw"), []
    for c in range(2):
        for k in range(10):
            kind, at, items = k % 3 + 1, k * 1000, []
            for i in range(20):
                s = at + 40 * i + (0 if kind == 3 else r.randrange(10))
                items.append((s, s + (r.randrange(1, 25) if kind == 1 else 15), r.randrange(100) / 4))
            blocks.append((c, kind, 40 if kind == 3 else 0, 15 if kind > 1 else 0, items))
    write_bigwig(path, order, packed, blocks, ["chr1", "chrX"])
    want = sorted((["chr1", "chrX"][c], *x) for c, _, _, _, items in blocks for x in items)
    rows = lambda df: sorted((x.contig, x.s, x.e, x.score) for x in df.collect())
    whole = spark.read.format("bigwig").option("part_bytes", 500).load(path)
    assert whole.rdd.getNumPartitions() > 3 and rows(whole) == want
    some = spark.read.format("bigwig").option("regions", "chrX:2500-4010,chr1:0-10").load(path)
    assert rows(some) == [x for x in want if (x[0] == "chrX" and x[1] < 4010 and 2500 < x[2]) or (x[0] == "chr1" and x[1] < 10)]
    reader = indexed.BigWigReader({"path": path, "regions": "chrX:2500-2600"})
    assert sum(len(p.ranges) for p in reader.partitions()) == 1  # one block of twenty is opened
    genome.track_table(whole.select("contig", "s", "e", "score"), str(tmp_path / "track"))
    back = spark.read.parquet(str(tmp_path / "track"))
    assert sorted((x.contig, x.s, x.e, x.score) for x in back.collect()) == sorted((c[3:], *x) for c, *x in want)
