"""Data sources that plan their partitions from an index: BAM by BAI, bgzipped tables by tabix, FASTA by .fai, bigWig by
its R-tree. A region opens only the blocks that the index names for it; without one the whole file is dealt out.

    indexed.register(spark)
    spark.read.format("bam").option("regions", "chr1:1000-2000,chrM").load("/data/a.bam")

Options: path (several joined by commas; each row says which file it is from), regions (contig or contig:s-e, half-open,
0-based), index (where it is not beside the file; one file only), part_bytes (about how many bytes of the file a task
reads). Conditions on contig, s and e choose blocks as well. Files are read at offsets through pyarrow's file systems, so their store must be one that these know (local, HDFS, S3, GCS).
The driver reads indexes alone, tasks a few blocks at a time. A region without rows, or of an unknown contig, gives none.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

END = 1 << 62
#: Codes of BAM's bases and CIGAR operations, struct's codes of its tag types and their sizes in bytes.
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
TAG_TYPES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
#: The operations that advance on the reference.
ON_REFERENCE = np.array([c in "MDN=X" for c in OPERATIONS] + [False] * 7)
FIXED = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("mate_ref", "<i4"), ("mate_pos", "<i4"), ("tlen", "<i4")])


def opened(path: str) -> pa.NativeFile:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    files, at = pyarrow.fs.FileSystem.from_uri(path)
    return files.open_input_file(at)


class Blocks:
    """Random access to a BGZF file: a virtual offset is that of a block in the file and a place in its data."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.opened = file, file.size(), []

    def data(self, begin: int, end: int = END, step: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
        """The offset of each block of [begin, end) and its part of that range, read about `step` bytes at a time."""
        at, raw, first = begin >> 16, b"", begin >> 16
        while at < self.size and (at << 16) < end:
            if at - first + 18 > len(raw) or at - first + 1 + int.from_bytes(raw[at - first + 16 : at - first + 18], "little") > len(raw):
                first = at
                self.file.seek(at)
                raw = self.file.read(min(step, max(1 << 16, (end >> 16) - at + (1 << 16))))
            here = at - first
            if raw[here : here + 4] != b"\x1f\x8b\x08\x04" or raw[here + 12 : here + 14] != b"BC":
                raise ValueError(f"no BGZF block at {at}")
            size = 1 + int.from_bytes(raw[here + 16 : here + 18], "little")
            self.opened.append(at)
            block = zlib.decompress(raw[here + 18 : here + size - 8], -15)
            yield at, block[begin & 0xFFFF if at == begin >> 16 else 0 : end & 0xFFFF if at == end >> 16 else len(block)]
            at += size


@dataclass
class BinIndex:
    """Bins and linear index of each reference, as BAI and tabix hold them."""

    refs: list[tuple[dict[int, list[tuple[int, int]]], list[int]]]
    names: list[str] = field(default_factory=list)

    @staticmethod
    def parsed(data: bytes, at: int, n: int, names: list[str]) -> BinIndex:
        refs = []
        for _ in range(n):
            bins, (n_bins,) = {}, struct.unpack_from("<i", data, at)
            at += 4
            for _ in range(n_bins):
                number, n_chunks = struct.unpack_from("<Ii", data, at)
                flat = struct.unpack_from(f"<{2 * n_chunks}Q", data, at + 8)
                at += 8 + 16 * n_chunks
                if number < 37449:  # the one above holds counts
                    bins[number] = list(zip(flat[::2], flat[1::2], strict=True))
            (n_linear,) = struct.unpack_from("<i", data, at)
            linear = list(struct.unpack_from(f"<{n_linear}Q", data, at + 4))
            at += 4 + 8 * n_linear
            refs.append((bins, linear))
        return BinIndex(refs, names)

    def chunks(self, ref: int, s: int, e: int) -> list[tuple[int, int]]:
        """Ranges of virtual offsets that hold all records of a reference that overlap [s, e), merged and in order."""
        bins, linear = self.refs[ref]
        s, e = max(0, s), min(e, 1 << 29)
        if s >= e:
            return []
        numbers = [0, *(k for first, shift in ((1, 26), (9, 23), (73, 20), (585, 17), (4681, 14)) for k in range(first + (s >> shift), first + ((e - 1) >> shift) + 1))]
        least = linear[min(s >> 14, len(linear) - 1)] if linear else 0
        out: list[tuple[int, int]] = []
        for begin, end in sorted(c for k in numbers for c in bins.get(k, ()) if c[1] > least):
            begin = max(begin, least)
            if out and begin <= out[-1][1]:
                out[-1] = (out[-1][0], max(end, out[-1][1]))
            else:
                out.append((begin, end))
        return out

    def starts(self) -> list[int]:
        """Virtual offsets at which a record is known to begin."""
        return sorted({b for bins, linear in self.refs for chunks in bins.values() for b, _ in chunks} | {v for _, linear in self.refs for v in linear if v})


@dataclass
class Part(InputPartition):
    path: str
    ranges: list  # of offsets in the file
    regions: list  # (contig, s, e) that rows must overlap; empty for all


def dealt(path: str, ranges: list[tuple[int, int]], cuts: list[int], regions: list, size: int, shift: int = 16) -> list[Part]:
    """Ranges of (virtual) offsets cut at record starts and packed into partitions of about `size` bytes of the file."""
    parts: list[Part] = []
    held, bytes_held = [], 0
    for begin, end in ranges:
        inner = cuts[bisect.bisect_right(cuts, begin) : bisect.bisect_left(cuts, end)]
        for b, e in zip([begin, *inner], [*inner, end], strict=True):
            if held and held[-1][1] == b:
                held[-1] = (held[-1][0], e)
            else:
                held.append((b, e))
            bytes_held += max(1, (min(e, END) >> shift) - (b >> shift)) if e < END else 1
            if bytes_held >= size:
                parts.append(Part(path, held, regions))
                held, bytes_held = [], 0
    return parts + ([Part(path, held, regions)] if held else [])


class RegionReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p.strip() for p in options["path"].split(",") if p.strip()]
        self.index, self.size = options.get("index"), int(options.get("part_bytes", 16 << 20))
        self.regions = merged([parsed(r) for r in options.get("regions", "").split(",") if r.strip()]) if options.get("regions") else None

    def pushFilters(self, filters):
        """Conditions on contig, s and e narrow the regions; Spark evaluates all of them again."""
        contigs, low, high = None, 0, END
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "contig" and isinstance(f, EqualTo | In):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                contigs = named if contigs is None else contigs & named
            if column == "s" and isinstance(f, LessThan | LessThanOrEqual):
                high = min(high, f.value + isinstance(f, LessThanOrEqual))
            if column == "e" and isinstance(f, GreaterThan | GreaterThanOrEqual):
                low = max(low, f.value - isinstance(f, GreaterThanOrEqual))
        if contigs is not None:
            asked = [(c, low, high) for c in contigs]
            self.regions = asked if self.regions is None else merged([(c, max(s, low), min(e, high)) for c, s, e in self.regions if c in contigs and max(s, low) < min(e, high)])
        return filters

    def partitions(self) -> list[Part]:
        return [p for path in self.paths for p in self.planned(path)] or [Part("", [], [])]  # Spark reads at least one

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        return self.rows_of(part) if part.path else iter(())


def parsed(region: str) -> tuple[str, int, int]:
    contig, _, span = region.strip().rpartition(":")
    s, dash, e = span.partition("-")
    return (contig, int(s), int(e)) if contig and dash and s.isdigit() and e.isdigit() else (region.strip(), 0, END)


def merged(regions: list) -> list:
    out: list = []
    for c, s, e in sorted(regions):
        if out and out[-1][0] == c and s <= out[-1][2]:
            out[-1] = (c, out[-1][1], max(e, out[-1][2]))
        else:
            out.append((c, s, e))
    return out


def overlapping(regions: list, contig, s, e) -> bool:
    return not regions or any(c == contig and s < y and x < e for c, x, y in regions)


class BamReader(RegionReader):
    KIND = pa.schema([
        ("qname", pa.string()), ("flag", pa.int32()), ("contig", pa.string()), ("s", pa.int64()), ("e", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("mate_contig", pa.string()),
        ("mate_s", pa.int64()), ("tlen", pa.int64()), ("seq", pa.string()), ("qual", pa.string()), ("tags", pa.map_(pa.string(), pa.string())), ("file", pa.string())])

    @staticmethod
    def header(blocks: Blocks) -> tuple[list[str], int]:
        """Names of the references and the virtual offset of the first record."""
        data, places = b"", []
        for at, block in blocks.data(0):
            places.append((len(data), at))
            data += block
            try:
                (l_text,) = struct.unpack_from("<i", data, 4)
                (n,) = struct.unpack_from("<i", data, 8 + l_text)
                names, pos = [], 12 + l_text
                for _ in range(n):
                    (l_name,) = struct.unpack_from("<i", data, pos)
                    names.append(data[pos + 4 : pos + 3 + l_name].decode())
                    struct.unpack_from("<i", data, pos + 4 + l_name)
                    pos += 8 + l_name
            except struct.error:
                continue  # the header goes on in the next block
            if data[:4] != b"BAM\x01":
                raise ValueError("not a BAM file")
            first, at = places[bisect.bisect_right(places, (pos, END)) - 1]
            return names, at << 16 | pos - first
        raise ValueError("the BAM header ends early")

    def planned(self, path: str) -> list[Part]:
        names, first = self.header(Blocks(opened(path)))
        data = opened(self.index or f"{path}.bai").read()
        if data[:4] != b"BAI\x01":
            raise ValueError("not a BAI index")
        index = BinIndex.parsed(data, 8, struct.unpack_from("<i", data, 4)[0], names)
        if self.regions is None:
            return dealt(path, [(first, END)], [v for v in index.starts() if v > first], [], self.size)
        out = []
        for contig in sorted({r[0] for r in self.regions} & set(names)):
            own = [r for r in self.regions if r[0] == contig]
            ranges = merged([("", b, e) for _, s, e in own for b, e in index.chunks(names.index(contig), s, e)])
            out += dealt(path, [(b, e) for _, b, e in ranges], index.starts(), own, self.size)
        return out

    def rows_of(self, part: Part) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(opened(part.path))
        names = self.header(blocks)[0]
        for begin, end in part.ranges:
            rest = b""
            for _, data in blocks.data(begin, end):
                rest += data
                if len(rest) >= 1 << 20:
                    batch, used = self.decoded(rest, names, part)
                    rest = rest[used:]
                    yield batch
            batch, used = self.decoded(rest, names, part)
            if used != len(rest):
                raise ValueError("a record ends early")
            yield batch

    def decoded(self, data: bytes, names: list[str], part: Part) -> tuple[pa.RecordBatch, int]:
        """The whole records at the beginning of data, and their bytes."""
        starts, at = [], 0
        while at + 4 <= len(data) and at + 4 + (size := int.from_bytes(data[at : at + 4], "little")) <= len(data):
            starts.append(at)
            at += 4 + size
        buffer, first = np.frombuffer(data, np.uint8), np.array(starts, np.int64)
        fixed = buffer[first[:, None] + np.arange(36)].copy().view(FIXED).ravel() if starts else np.empty(0, FIXED)
        name_of = np.array([*names, None], object)
        rows: list[list] = [[] for _ in range(7)]
        keep, ends = [], []
        for i, (begin, x) in enumerate(zip(starts, fixed.tolist(), strict=True)):
            size, ref, pos, l_name, _, _, n_cigar, _, l_seq, *_ = x
            place = begin + 36 + l_name
            cigar = np.frombuffer(data, "<u4", n_cigar, place)
            seq_at = place + 4 * n_cigar
            tags = read_tags(data, seq_at + (l_seq + 1) // 2 + l_seq, begin + 4 + size)
            if n_cigar == 2 and "CG" in tags and cigar[0] == l_seq << 4 | 4:  # too many operations for the record's own field
                cigar = np.array(tags.pop("CG").split(",")[1:], np.uint32)
            span = int((cigar >> 4)[ON_REFERENCE[cigar & 15]].sum())
            if not overlapping(part.regions, name_of[ref], pos, pos + max(1, span)):
                continue
            keep.append(i)
            ends.append(pos + span if len(cigar) and pos >= 0 else None)
            packed = buffer[seq_at : seq_at + (l_seq + 1) // 2]
            letters = np.frombuffer(BASES.encode(), np.uint8)[np.stack([packed >> 4, packed & 15], 1).ravel()[:l_seq]]
            quality = buffer[seq_at + (l_seq + 1) // 2 : seq_at + (l_seq + 1) // 2 + l_seq]
            values = (
                data[begin + 36 : place - 1].decode(), "".join(f"{c >> 4}{OPERATIONS[c & 15]}" for c in cigar.tolist()) or None, letters.tobytes().decode() or None,
                (quality + 33).astype(np.uint8).tobytes().decode() if l_seq and quality[0] != 255 else None, list(tags.items()))
            for column, v in zip(rows, values, strict=False):
                column.append(v)
        f = fixed[keep]
        place = lambda x: pa.array(x.astype(np.int64), mask=x < 0)
        columns = [
            pa.array(rows[0], pa.string()), pa.array(f["flag"].astype(np.int32)), pa.array(name_of[f["ref"]], pa.string()), place(f["pos"]), pa.array(ends, pa.int64()), pa.array(f["mapq"].astype(np.int32)), pa.array(rows[1], pa.string()),
            pa.array(name_of[f["mate_ref"]], pa.string()), place(f["mate_pos"]), pa.array(f["tlen"].astype(np.int64)), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.string()), pa.array(rows[4], self.KIND.field("tags").type), pa.array([part.path] * len(keep), pa.string())]
        return pa.RecordBatch.from_arrays(columns, schema=self.KIND), at


def read_tags(data: bytes, at: int, end: int) -> dict[str, str]:
    """Optional fields of a BAM record as text, arrays as SAM writes them (type,value,...)."""
    out = {}
    while at < end:
        name, kind, at = data[at : at + 2].decode(), chr(data[at + 2]), at + 3
        if kind in "ZH":
            stop = data.index(b"\0", at)
            out[name], at = data[at:stop].decode(), stop + 1
        elif kind == "A":
            out[name], at = chr(data[at]), at + 1
        elif kind == "B":
            of, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{TAG_TYPES[of]}", data, at + 5)
            out[name], at = ",".join([of, *map(number, values)]), at + 5 + n * struct.calcsize(TAG_TYPES[of])
        else:
            out[name], at = number(struct.unpack_from(f"<{TAG_TYPES[kind]}", data, at)[0]), at + struct.calcsize(TAG_TYPES[kind])
    return out


def number(x) -> str:
    return f"{x:g}" if isinstance(x, float) else str(x)


class TabixReader(RegionReader):
    KIND = pa.schema([("contig", pa.string()), ("s", pa.int64()), ("e", pa.int64()), ("line", pa.string()), ("file", pa.string())])

    def planned(self, path: str) -> list[Part]:
        data = b"".join(block for _, block in Blocks(opened(self.index or f"{path}.tbi")).data(0))
        if data[:4] != b"TBI\x01":
            raise ValueError("not a tabix index")
        n, kind, c, s, e, meta, skip, l_names = struct.unpack_from("<8i", data, 4)
        names = data[36 : 36 + l_names].decode().split("\0")[:n]
        index = BinIndex.parsed(data, 36 + l_names, n, names)
        form = [kind, c, s, e, chr(meta), skip]
        if self.regions is None:
            parts = dealt(path, [(0, END)], [v for v in index.starts() if v], [], self.size)
        else:
            parts = []
            for contig in sorted({r[0] for r in self.regions} & set(names)):
                own = [r for r in self.regions if r[0] == contig]
                ranges = merged([("", b, x) for _, lo, hi in own for b, x in index.chunks(names.index(contig), lo, hi)])
                parts += dealt(path, [(b, x) for _, b, x in ranges], index.starts(), own, self.size)
        return [FormedPart(p.path, p.ranges, p.regions, form) for p in parts]

    def rows_of(self, part: FormedPart) -> Iterator[pa.RecordBatch]:
        skip, blocks = part.form[-1], Blocks(opened(part.path))
        for begin, end in part.ranges:
            rest, first = b"", begin == 0
            for _, block in blocks.data(begin, end):
                rest += block
                cut = rest.rfind(b"\n") + 1
                if cut and len(rest) >= 1 << 20:
                    yield self.rows(rest[:cut].decode(), part, skip if first else 0)
                    rest, first = rest[cut:], False
            yield self.rows(rest.decode(), part, skip if first else 0)

    def rows(self, text: str, part: FormedPart, skip: int) -> pa.RecordBatch:
        kind, c, s, e, meta, _ = part.form
        out = []
        for line in text.split("\n")[skip:]:
            if not line or line.startswith(meta):
                continue
            f = line.split("\t")
            lo = int(f[s - 1]) - (0 if kind & 0x10000 else 1)
            if kind & 0xFFFF == 2:  # VCF: as long as the reference allele
                hi = lo + len(f[3])
            elif e:
                hi = int(f[e - 1])
            else:
                hi = lo + 1
            if overlapping(part.regions, f[c - 1], lo, max(hi, lo + 1)):
                out.append((f[c - 1], lo, hi, line, part.path))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, self.KIND.types, strict=True)], schema=self.KIND)


@dataclass
class FormedPart(Part):
    form: list


class FastaReader(RegionReader):
    """Tiles of a FASTA file by its .fai: rows contig, tile, s, e, seq. Tiles are read where they lie, newlines left out."""

    KIND = pa.schema([("contig", pa.string()), ("tile", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("seq", pa.string()), ("file", pa.string())])

    def __init__(self, options: dict):
        super().__init__(options)
        self.tile = int(options.get("tile", 65_536))

    def planned(self, path: str) -> list[Part]:
        lines = opened(self.index or f"{path}.fai").read().decode().splitlines()
        entries = [(f[0], *map(int, f[1:5])) for f in (x.split("\t") for x in lines) if len(f) >= 5]
        parts, held, size = [], [], 0
        for contig, length, offset, bases, width in entries:
            wanted = [(0, length)] if self.regions is None else [(max(0, s), min(e, length)) for c, s, e in self.regions if c == contig]
            tiles = sorted({t for s, e in wanted if s < e for t in range(s // self.tile, (e - 1) // self.tile + 1)})
            for t in tiles:
                s, e = t * self.tile, min((t + 1) * self.tile, length)
                held.append((contig, t, s, e, offset, bases, width))
                size += e - s
                if size >= self.size:
                    parts.append(Part(path, held, []))
                    held, size = [], 0
        return parts + ([Part(path, held, [])] if held else [])

    def rows_of(self, part: Part) -> Iterator[pa.RecordBatch]:
        file = opened(part.path)
        for contig, tile, s, e, offset, bases, width in part.ranges:
            at = lambda i: offset + i // bases * width + i % bases  # noqa: E731, B023
            file.seek(at(s))
            seq = file.read(at(e - 1) + 1 - at(s)).replace(b"\n", b"").replace(b"\r", b"").decode()
            yield pa.RecordBatch.from_pylist([{"contig": contig, "tile": tile, "s": s, "e": e, "seq": seq, "file": part.path}], self.KIND)


class BigWigReader(RegionReader):
    KIND = pa.schema([("contig", pa.string()), ("s", pa.int64()), ("e", pa.int64()), ("score", pa.float64()), ("file", pa.string())])

    @staticmethod
    def layout(file: pa.NativeFile) -> tuple[str, dict[int, str], int, bool]:
        """Byte order, names of the chromosomes by number, where the R-tree is, whether blocks are compressed."""
        head = file.read(64)
        order = next((o for o in "<>" if struct.unpack(f"{o}I", head[:4])[0] == 0x888FFC26), None)
        if not order:
            raise ValueError("not a bigWig file")
        _, _, _, chroms, _, index, _, _, _, _, buffer, _ = struct.unpack(f"{order}IHHQQQHHQQIQ", head)
        file.seek(chroms)
        _, _, key, value, _, _ = struct.unpack(f"{order}IIIIQQ", file.read(32))
        names, waiting = {}, [chroms + 32]
        while waiting:
            file.seek(waiting.pop())
            leaf, _, n = struct.unpack(f"{order}BBH", file.read(4))
            for _ in range(n):
                item = file.read(key + 8)
                if leaf:
                    names[struct.unpack(f"{order}I", item[key : key + 4])[0]] = item[:key].rstrip(b"\0").decode()
                else:
                    here = file.tell()
                    waiting.append(struct.unpack(f"{order}Q", item[key:])[0])
                    file.seek(here)
        return order, names, index, buffer > 0

    def planned(self, path: str) -> list[Part]:
        """Leaves of the R-tree that a region meets; a subtree outside is not opened."""
        file = opened(path)
        order, names, index, packed = self.layout(file)
        number_of = {v: k for k, v in names.items()}
        wanted = None if self.regions is None else [(number_of[c], s, e) for c, s, e in self.regions if c in number_of]
        meets = lambda c1, s, c2, e: wanted is None or any((c1, s) < (c, y) and (c, x) < (c2, e) for c, x, y in wanted)
        found, waiting = [], [index + 48] if wanted is None or wanted else []
        while waiting:
            file.seek(waiting.pop())
            leaf, _, n = struct.unpack(f"{order}BBH", file.read(4))
            items = file.read(n * (32 if leaf else 24))
            for i in range(n):
                if leaf:
                    c1, s, c2, e, at, size = struct.unpack_from(f"{order}IIIIQQ", items, 32 * i)
                    if meets(c1, s, c2, e):
                        found.append((at, at + size))
                else:
                    c1, s, c2, e, at = struct.unpack_from(f"{order}IIIIQ", items, 24 * i)
                    if meets(c1, s, c2, e):
                        waiting.append(at)
        parts, held = [], []
        for block in sorted(found):
            held.append(block)
            if sum(e - b for b, e in held) >= self.size:
                parts.append(held)
                held = []
        form = [order, names, packed]
        return [FormedPart(path, blocks, self.regions or [], form) for blocks in [*parts, *([held] if held else [])]]

    def rows_of(self, part: FormedPart) -> Iterator[pa.RecordBatch]:
        file, (order, names, packed) = opened(part.path), part.form
        for begin, end in part.ranges:
            file.seek(begin)
            data = file.read(end - begin)
            data = zlib.decompress(data) if packed else data
            chrom, start, _, step, span, kind, _, n = struct.unpack_from(f"{order}IIIIIBBH", data)
            if kind == 1:
                x = np.frombuffer(data, np.dtype([("s", f"{order}u4"), ("e", f"{order}u4"), ("v", f"{order}f4")]), n, 24)
                s, e = x["s"].astype(np.int64), x["e"].astype(np.int64)
            elif kind == 2:
                x = np.frombuffer(data, np.dtype([("s", f"{order}u4"), ("v", f"{order}f4")]), n, 24)
                s = x["s"].astype(np.int64)
                e = s + span
            else:
                x = np.frombuffer(data, np.dtype([("v", f"{order}f4")]), n, 24)
                s = start + step * np.arange(n, dtype=np.int64)
                e = s + span
            contig, values = names[chrom], x["v"].astype(np.float64)
            if part.regions:
                inside = np.zeros(n, bool)
                for c, lo, hi in part.regions:
                    inside |= (c == contig) & (s < hi) & (lo < e)
                s, e, values = s[inside], e[inside], values[inside]
            yield pa.RecordBatch.from_arrays([pa.array([contig] * len(s), pa.string()), pa.array(s), pa.array(e), pa.array(values), pa.array([part.path] * len(s), pa.string())], schema=self.KIND)


class Indexed(DataSource):
    READER, NAME, SCHEMA = RegionReader, "", ""

    @classmethod
    def name(cls) -> str:
        return cls.NAME

    def schema(self) -> str:
        return self.SCHEMA

    def reader(self, schema) -> RegionReader:
        return self.READER(self.options)


class Bam(Indexed):
    READER, NAME = BamReader, "bam"
    SCHEMA = "qname string, flag int, contig string, s long, e long, mapq int, cigar string, mate_contig string, mate_s long, tlen long, seq string, qual string, tags map<string, string>, file string"


class Tabix(Indexed):
    READER, NAME, SCHEMA = TabixReader, "tabix", "contig string, s long, e long, line string, file string"


class Fasta(Indexed):
    READER, NAME, SCHEMA = FastaReader, "fasta", "contig string, tile long, s long, e long, seq string, file string"


class BigWig(Indexed):
    READER, NAME, SCHEMA = BigWigReader, "bigwig", "contig string, s long, e long, score double, file string"


def register(spark) -> None:
    """Make formats bam, tabix, fasta and bigwig known to a session, and let conditions reach Python sources (readers
    that take conditions are an error without that setting)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Bam, Tabix, Fasta, BigWig):
        spark.dataSource.register(source)
