"""Rules on calls: which to keep and why not, and what an output record says.

Calls hold numbers as text, 'NA' for what is missing. A rule whose input is missing or no number does not hold,
unless it says otherwise; reasons are kept in the order of the rules. Repeated rows are judged each on their own, joins
by key give a row for each pair of equal keys, null keys meet nothing. Empty tables give no rows. Other columns pass
through filters; names that begin with an underscore are taken by these operators.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.sequences import homopolymer
from seqloom.operators.clustering import folded, ranged
from seqloom.operators.evidence import SHORT, all_reasons, first_reason
from seqloom.operators.intervals import many_pairs, overlap_pairs
from seqloom.operators.sweeps import any_overlap, running
from seqloom.scratch import saved, shared_folder

#: Columns that change places when a call's ends do.
ENDS = [
    ("5_Prime_End", "3_Prime_End"), ("Orient_5p", "Orient_3p"), ("5p_Elt_Match", "3p_Elt_Match"), ("5p_Genome_Match", "3p_Genome_Match"),
    ("Split_reads_5prime", "Split_reads_3prime"), ("5p_Cons_Len", "3p_Cons_Len"), ("5p_Improved", "3p_Improved"), ("TSD_5prime", "TSD_3prime"),
    ("Genomic_Consensus_5p", "Genomic_Consensus_3p"), ("Insert_Consensus_5p", "Insert_Consensus_3p"),
]
#: The output table's columns in order.
OUTPUT = """UUID Chromosome Left_Extreme Right_Extreme 5_Prime_End 3_Prime_End Superfamily Subfamily TE_Align_Start TE_Align_End
Orient_5p Orient_3p Inversion 5p_Elt_Match 3p_Elt_Match 5p_Genome_Match 3p_Genome_Match Split_reads_5prime Split_reads_3prime
Remapped_Discordant Remap_Disc_Fraction Remapped_Splitreads Remap_Split_Fraction 5p_Cons_Len 3p_Cons_Len 5p_Improved 3p_Improved
TSD_5prime TSD_3prime Sample_support_5p Sample_support_3p Sample_count Genomic_Consensus_5p Genomic_Consensus_3p
Insert_Consensus_5p Insert_Consensus_3p Genotypes Filter""".split()


@dataclass(frozen=True)
class Limits:
    """What calls have to reach; None switches a rule off."""

    elt_match: float = 0.95
    ref_match: float = 0.98
    disc_reads: int = 4
    disc_fetch: int = 50
    split_reads: int = 4
    cons_len: int = 250
    te_length: int | None = None
    vaf: float | None = None
    frac_end: float | None = None
    variants: int | None = None
    mappability: float = 0.5
    homopolymer: int = 20
    disc_fraction: float = 0.5


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def number(name: str) -> Column:
    return col(name).try_cast("double")


def missing(*names: str) -> Column:
    """All of these are NA or null."""
    out = F.lit(True)
    for name in names:
        out &= F.coalesce(col(name), F.lit("NA")) == "NA"
    return out


def sure(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(False))


def prefilter(limits: Limits = Limits(), unmapped: bool = False, uuids: Column | None = None) -> Column:
    """First reason against a raw call (be1_avgmatch, be2_avgmatch, dr_count, be1_sr_count, be2_sr_count, be1_dist_seq,
    be2_dist_seq), null if there is none: minmatch, mindisc, minsplit, mapends, uuidlist (uuids: whether listed).
    Missing matches and counts are 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rules = [
        ("minmatch", F.greatest(zero("be1_avgmatch"), zero("be2_avgmatch"), F.lit(0.0)) < limits.ref_match),
        ("mindisc", zero("dr_count") < min(limits.disc_reads, limits.disc_fetch)),
        ("minsplit", zero("be1_sr_count") + zero("be2_sr_count") < limits.split_reads),
    ]
    if not unmapped:
        rules.append(("mapends", F.col("be1_dist_seq").isNull() & F.col("be2_dist_seq").isNull()))
    if uuids is not None:
        rules.append(("uuidlist", ~F.coalesce(uuids, F.lit(False))))
    return first_reason(rules)


def ends_flush(locations: Column, length: Column, tolerance: int = 2) -> Column:
    """Whether any segment (array of arrays of two places) touches an end of the consensus."""
    return F.exists(locations, lambda x: (F.least(x[0], x[1]) <= tolerance) | (F.greatest(x[0], x[1]) >= length - tolerance))


def record_reasons(limits: Limits = Limits()) -> Column:
    """Reasons against an output record with prox_len (the longest proximal sequence) and flush (see ends_flush)."""
    rules = [("no_ends", missing("5_Prime_End", "3_Prime_End"))]
    if limits.disc_fetch > 0:
        rules.append(("insert_consensus", missing("Insert_Consensus_5p", "Insert_Consensus_3p")))
    rules += [
        ("min_cons_len", sure(number("3p_Cons_Len") + number("5p_Cons_Len") < limits.cons_len)),
        ("prox_len", sure(F.col("prox_len") < 20)), ("end_align_flush", ~F.coalesce(F.col("flush"), F.lit(False))),
    ]
    return all_reasons(rules)


def one_letter(name: str) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(col(name), ""), lambda c: c != ""))) == 1


def greatest_vaf(genotypes: Column) -> Column:
    """Greatest fourth field of sample|alt|ref|vaf,...; 0 without a number."""
    return F.coalesce(F.array_max(F.transform(F.split(genotypes, ","), lambda g: F.get(F.split(g, r"\|"), F.lit(3)).try_cast("double"))), F.lit(0.0))


def evidence_rules(limits: Limits, element_length: Column) -> list[tuple[str, Column]]:
    """The rules that hold independently of each other: (reason, column that is true where the call fails)."""
    mismatch = (col("TSD_3prime") != col("TSD_5prime")) & (F.levenshtein(col("TSD_3prime"), col("TSD_5prime")) > 1)
    rules = [
        ("NoConsMapRef", missing("Insert_Consensus_5p", "Insert_Consensus_3p")),
        ("TotalConsLen", number("3p_Cons_Len") + number("5p_Cons_Len") < limits.cons_len),
        ("MinEltMatch", F.greatest(number("5p_Elt_Match"), number("3p_Elt_Match")) < limits.elt_match),
        ("MinRefMatch", F.greatest(number("5p_Genome_Match"), number("3p_Genome_Match")) < limits.ref_match),
        ("MinDiscord", number("Remapped_Discordant") < limits.disc_reads),
        ("MinSplit", number("Split_reads_5prime") + number("Split_reads_3prime") < limits.split_reads),
        ("MismatchTSD", mismatch),
        ("LongHomopolTSD", (F.length(col("TSD_3prime")) > 10) & ~mismatch & (one_letter("TSD_3prime") | one_letter("TSD_5prime"))),
    ]
    if limits.te_length:
        rules.append(("MinTELength", number("TE_Align_End") - number("TE_Align_Start") < limits.te_length))
    if limits.vaf:
        rules += [("MissingVAF", missing("Genotypes")), ("MinVAF", F.when(missing("Genotypes"), F.lit(0.0)).otherwise(greatest_vaf(col("Genotypes"))) < limits.vaf)]
    if limits.frac_end is not None:
        rules.append(("FracEnd", ~missing("Genomic_Consensus_3p") & ((element_length - number("TE_Align_End")) / element_length > limits.frac_end)))
    if limits.variants is not None:
        rules.append(("MaxVars", F.size(F.split(col("Variants"), ",")) > limits.variants))
    return [(name, sure(rule)) for name, rule in rules]


def weighed(calls: DataFrame, elements: DataFrame, limits: Limits = Limits(), mappability: Column | None = None, site: Column | None = None) -> DataFrame:
    """Adds what final_filter's verdict needs of the call's own columns: _failed, the independent rules that fail, joined by commas (null for
    an unknown family), and _later, the reason that counts if nothing else fails. The other columns need not go where tracks are asked."""
    known = elements.select(F.col("element").alias("_element"), F.col("length").alias("_length")).dropDuplicates(["_element"])
    rows = calls.join(F.broadcast(known), F.concat_ws(":", col("Superfamily"), col("Subfamily")) == F.col("_element"), "left")
    listed = lambda rules: F.array_join(F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules])), ",")
    rows = rows.withColumn("_failed", F.when(F.col("_element").isNotNull(), listed(evidence_rules(limits, F.col("_length")))))
    later = F.lit("")
    if site is not None:
        later = listed([("HomopolSite", homopolymer(F.upper(site), b) > limits.homopolymer) for b in "ATCG"])
    if mappability is not None:
        later = F.when(F.coalesce(mappability, F.lit(0.0)) < limits.mappability, "LowMap").otherwise(later)
    return rows.withColumn("_later", F.when(F.col("_failed") == "", later)).drop("_element", "_length")


def verdict(extra: list[tuple[str, Column]] = []) -> Column:
    """The Filter of weighed calls; `extra` are further rules."""
    text = F.concat_ws(",", F.nullif(F.col("_failed"), F.lit("")), *[F.when(sure(bad), name) for name, bad in extra])
    return F.when(F.col("_failed").isNull(), "UnknownInsType").when(text != "", text).when(F.col("_later") != "", F.col("_later")).otherwise("PASS")


def final_filter(calls: DataFrame, elements: DataFrame, limits: Limits = Limits(), mappability: Column | None = None, site: Column | None = None, extra: list[tuple[str, Column]] = []) -> DataFrame:
    """Adds Filter to calls: UnknownInsType for a family that elements (element 'super:sub', length; few rows) does
    not have, else all reasons of the independent rules and of `extra`; only where none holds, in turn, LowMap, then
    HomopolSite once for each letter of which the site's sequence has a run of over limits.homopolymer + 1; else PASS.
    """
    return weighed(calls, elements, limits, mappability, site).withColumn("Filter", verdict(extra)).drop("_failed", "_later")


def table_rules(elt: float, genome: float, disc_fraction: float, mappable: float, cons_len: int = 120, disc: int = 4) -> list[tuple[str, Column]]:
    """Rules of the table filters of either species: they differ in these limits only."""
    return [(name, sure(rule)) for name, rule in [
        ("ShortConsensus", (number("5p_Cons_Len") < cons_len) & (number("3p_Cons_Len") < cons_len)),
        ("NoCoords", number("TE_Align_Start").isNull() | number("TE_Align_End").isNull()),
        ("EltMatch", F.greatest(number("5p_Elt_Match"), number("3p_Elt_Match")) < elt),
        ("GenomeMatch", F.greatest(number("5p_Genome_Match"), number("3p_Genome_Match")) < genome),
        ("Mappability", F.col("mappability") < mappable), ("Discordant", number("Remapped_Discordant") < disc),
        ("DiscordantFraction", number("Remap_Disc_Fraction") < disc_fraction), ("NoInsertConsensus", missing("Insert_Consensus_5p", "Insert_Consensus_3p")),
    ]]


HUMAN = {"elt": 0.95, "genome": 0.98, "disc_fraction": 0.5, "mappable": 0.1}
MOUSE = {"elt": 0.90, "genome": 0.98, "disc_fraction": 0.25, "mappable": 0.1}


def length_fails(species: str) -> Column:
    """Whether an element is too short for its family, or an L1 ends too early, by species (human, mouse)."""
    end, n, family = number("TE_Align_End"), number("TE_Align_End") - number("TE_Align_Start"), F.upper(col("Superfamily"))
    if species == "human":
        return sure(F.when(family == "ALU", n < 250).when(family == "SVA", n < 1000).when(family == "L1", end < 5950))
    return sure(F.when(family == "LTR", n < 500).when(family == "SINE", (n < 100) | (n > 200)).when(family == "L1", end < 6500))


def gene_copy_passes() -> Column:
    """Rules for copies of genes: all must hold (column mappability)."""
    low, high = (lambda a, b: F.least(number(a), number(b))), (lambda a, b: F.greatest(number(a), number(b)))
    rules = [
        (number("5p_Cons_Len") >= 120) | (number("3p_Cons_Len") >= 120), number("TE_Align_End") - number("TE_Align_Start") >= 400, col("TSD_5prime") == col("TSD_3prime"),
        low("Split_reads_5prime", "Split_reads_3prime") >= 1, number("Remap_Disc_Fraction") >= 0.5, high("5p_Elt_Match", "3p_Elt_Match") >= 0.95, low("5p_Elt_Match", "3p_Elt_Match") >= 0.90,
        high("5p_Genome_Match", "3p_Genome_Match") >= 0.98, low("5p_Genome_Match", "3p_Genome_Match") >= 0.95, number("Remapped_Discordant") >= 4, F.col("mappability") >= 0.9,
    ]
    out = F.lit(True)
    for rule in rules:
        out &= rule
    return sure(out)


def insertion_passes(least_mapq: int = 10, least_sr: int = 4, least_sr_of_sample: int | None = None, excluded: list[str] | None = None, most_samples: int = 0, least_mappability: float | None = None, excluded_groups: list[str] | None = None) -> Column:
    """Whether an insertion (mapqs array, num_sr, most_sr_of_sample, samples array, mappability) is kept. The best sample
    needs least_sr reads too, unless it has a limit of its own. excluded_groups: read groups (array groups), whose
    names end at the first |; nulls exclude nothing."""
    ok = (F.array_max("mapqs") >= least_mapq) & (F.col("num_sr") >= least_sr) & (F.col("most_sr_of_sample") >= (least_sr if least_sr_of_sample is None else least_sr_of_sample))
    if excluded:
        ok &= ~F.coalesce(F.arrays_overlap("samples", F.array(*map(F.lit, excluded))), F.lit(False))
    if excluded_groups:
        names = F.transform("groups", lambda x: F.substring_index(x, "|", 1))
        ok &= ~F.coalesce(F.arrays_overlap(names, F.array(*map(F.lit, excluded_groups))), F.lit(False))
    if most_samples:
        ok &= F.size(F.array_distinct("samples")) <= most_samples
    if least_mappability is not None:
        ok &= F.coalesce(F.col("mappability"), F.lit(0.0)) >= least_mappability
    return sure(ok)


def flipped(calls: DataFrame, flip: Column, support: bool = False) -> DataFrame:
    """calls with both ends' columns exchanged where flip holds; support: those of sample support as well."""
    pairs = [*ENDS, ("Sample_support_5p", "Sample_support_3p")] if support else ENDS
    swap = sure(flip)
    new = {}
    for a, b in pairs:
        if a in calls.columns and b in calls.columns:
            new |= {a: F.when(swap, col(b)).otherwise(col(a)), b: F.when(swap, col(a)).otherwise(col(b))}
    return calls.withColumns(new)


def poly_a_orientation(calls: DataFrame) -> DataFrame:
    """Orientations that are NA, from a run of 20 A (+) or T (-) in the end's genomic consensus."""
    told = lambda c: F.when(col(c).contains("A" * 20), "+").when(col(c).contains("T" * 20), "-")
    return calls.withColumns({o: F.coalesce(F.nullif(col(o), F.lit("NA")), told(c), F.lit("NA")) for o, c in (("Orient_5p", "Genomic_Consensus_5p"), ("Orient_3p", "Genomic_Consensus_3p"))})


# --- from both breakends to an output record -------------------------------------------------------------------


def part(be: str, field: str) -> Column:
    return F.col(f"{be}.{field}")


def near_end(be: str, close: int = 10, tail: str = "A" * 10) -> Column:
    """Whether a match (target_start, target_alnsize, target_seqsize, query_align, target_align) is at the 3' end."""
    left = part(be, "target_seqsize") - part(be, "target_start") - part(be, "target_alnsize")
    return sure((left < close) | part(be, "query_align").endswith(tail) | part(be, "target_align").endswith(tail))


def first_is_3prime(one: str = "be1", two: str = "be2") -> Column:
    """Whether the first end is the 3' end: that of the later target start, or what the only match says; null
    without a match. Matches are structs."""
    a, b = F.col(one).isNotNull(), F.col(two).isNotNull()
    return F.when(a & b, part(one, "target_start") > part(two, "target_start")).when(a, near_end(one)).when(b, ~near_end(two))


def match_end(be: str) -> Column:
    return part(be, "target_start") + part(be, "target_alnsize")


def inserted_length(is_3prime: Column, one: str = "be1", two: str = "be2") -> Column:
    """Span of both matches; with a 5' match only, from its start to the target's end; else null."""
    ends = [x for be in (one, two) for x in (part(be, "target_start"), match_end(be))]
    a, b = F.col(one).isNotNull(), F.col(two).isNotNull()
    rest = lambda be: part(be, "target_seqsize") - F.least(part(be, "target_start"), match_end(be))
    return F.when(a & b, F.greatest(*ends) - F.least(*ends)).when(a & ~is_3prime, rest(one)).when(b & is_3prime, rest(two))


def end_orientation(is_3prime: Column, low: Column, high: Column, length: Column, strand: Column) -> Column:
    """+ or - of one end: its proximal segment covers low..high of a consensus of this length, on this strand."""
    distal_left = low > length - high
    plus = (is_3prime == distal_left) != (strand == "-")
    return F.when(is_3prime.isNotNull() & low.isNotNull(), F.when(plus, "+").otherwise("-"))


def best_target(one: str = "be1", two: str = "be2") -> Column:
    """Target of both matches if it is one; else of the one that is not only poly-A, then of the better score; null
    for equal scores. Of a single match its own."""
    a, b, same = F.col(one).isNotNull(), F.col(two).isNotNull(), part(one, "target_id") == part(two, "target_id")
    pick = F.when(same | part(two, "only_poly_a") & ~part(one, "only_poly_a"), part(one, "target_id")).when(part(one, "only_poly_a"), part(two, "target_id"))
    pick = pick.when(part(one, "score") > part(two, "score"), part(one, "target_id")).when(part(one, "score") < part(two, "score"), part(two, "target_id"))
    return F.when(a & b, pick).otherwise(F.coalesce(part(one, "target_id"), part(two, "target_id")))


def best_matches(matches: DataFrame, key: list[str], least: float = 0.9) -> DataFrame:
    """Each key's best match (score, pct, ordinal): the greatest score of those over least, the first of equals."""
    rank = F.struct(F.col("score"), -F.col("ordinal"))
    rest = [c for c in matches.columns if c not in key]
    return matches.where(F.col("pct") > least).groupBy(*key).agg(F.max_by(F.struct(*rest), rank).alias("_m")).select(*key, "_m.*")


def reconciled(pairs: DataFrame, matches: DataFrame, most: int = 5, most_poly_a: int = 20, poly_a: float = 0.75) -> DataFrame:
    """uuid, target_1, score_1, target_2, score_2 of calls whose ends match different targets.

    pairs: uuid, be1, be2 (structs of the best matches with target_id, score, only_poly_a) and poly_a_1, poly_a_2, the ends'
    A/T shares. The end of the lower score (the first of equals) takes its best match (uuid, be, target_id, score) to the
    other's target if that is less than `most` worse, or most_poly_a for a poly-A end. Where targets still differ, ends that
    are only poly-A lose theirs; where both are left the weaker end takes whatever match it has to the other's target.
    """
    weaker = F.when(part("be1", "score") > part("be2", "score"), 2).otherwise(1)
    rows = pairs.where(F.col("be1").isNotNull() & F.col("be2").isNotNull()).withColumn("_weak", weaker)
    rows = rows.withColumn("_want", F.when(F.col("_weak") == 2, part("be1", "target_id")).otherwise(part("be2", "target_id")))
    other = matches.groupBy("uuid", "be", "target_id").agg(F.max("score").alias("_new")).withColumnsRenamed({"be": "_weak", "target_id": "_want"})
    rows = rows.join(other, ["uuid", "_weak", "_want"], "left")
    old = F.when(F.col("_weak") == 2, part("be2", "score")).otherwise(part("be1", "score"))
    allowed = F.when(F.when(F.col("_weak") == 2, F.col("poly_a_2")).otherwise(F.col("poly_a_1")) > poly_a, most_poly_a).otherwise(most)
    same = part("be1", "target_id") == part("be2", "target_id")
    took = ~same & sure(old - F.col("_new") < allowed)
    drop1, drop2 = (~same & ~took & part(be, "only_poly_a") for be in ("be1", "be2"))
    last = ~same & ~took & ~drop1 & ~drop2

    def end(k: int, be: str, drop: Column) -> list[Column]:
        mine = F.col("_weak") == k
        target = F.when(drop, F.lit(None)).when(mine & (took | last & F.col("_new").isNotNull()), F.col("_want")).when(mine & last, F.lit(None)).otherwise(part(be, "target_id"))
        score = F.when(drop, F.lit(None)).when(mine & (took | last), F.col("_new")).otherwise(part(be, "score"))
        return [target.alias(f"target_{k}"), score.alias(f"score_{k}")]

    return rows.select("uuid", *end(1, "be1", drop1), *end(2, "be2", drop2))


def output_records(calls: DataFrame) -> DataFrame:
    """The output table of calls with be1_/be2_ columns (breakpos, orient, target_start, target_end, pct_match, avgmatch,
    sr_count, cons_seq, te_cons_seq, end_over, improved, support array of sample|count), best_ref, be1_is_3prime, inversion,
    remap_min_pos, remap_max_pos, remap_dr_count, remap_sr_count, dr_count, genotypes: all of OUTPUT in order, NA for null.
    """

    def ends(field: str) -> tuple[Column, Column]:
        a, b, three = F.col(f"be1_{field}"), F.col(f"be2_{field}"), F.col("be1_is_3prime")
        return F.when(three, b).when(~three, a), F.when(three, a).when(~three, b)

    text = lambda c: F.coalesce(c.cast("string"), F.lit("NA"))
    zero = lambda c, kind="double": F.coalesce(c, F.lit(0)).cast(kind)
    of = {f: ends(f) for f in ("breakpos", "orient", "target_start", "target_end", "pct_match", "avgmatch", "sr_count", "cons_seq", "te_cons_seq", "end_over", "improved", "support")}
    yes = lambda c: F.when(c, "Y").otherwise("N")
    fraction = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    both = F.array_distinct(F.transform(F.concat(F.coalesce("be1_support", F.array().cast("array<string>")), F.coalesce("be2_support", F.array().cast("array<string>"))), lambda x: F.substring_index(x, "|", 1)))
    dr, sr = F.col("remap_dr_count"), F.col("remap_sr_count")
    out = {
        "UUID": F.col("uuid"), "Chromosome": F.col("chrom"), "Left_Extreme": F.col("min_supporting_base"), "Right_Extreme": F.col("max_supporting_base"),
        "5_Prime_End": text(of["breakpos"][0]), "3_Prime_End": text(of["breakpos"][1]), "Superfamily": text(F.get(F.split("best_ref", ":"), F.lit(0))), "Subfamily": text(F.get(F.split("best_ref", ":"), F.lit(1))),
        "TE_Align_Start": text(F.least(of["target_start"][0], F.col("remap_min_pos"))), "TE_Align_End": text(F.greatest(of["target_end"][1], F.col("remap_max_pos"))),
        "Orient_5p": text(of["orient"][0]), "Orient_3p": text(of["orient"][1]), "Inversion": F.when(F.col("inversion"), "Y").when(~F.col("inversion"), "N").otherwise("NA"),
        "5p_Elt_Match": zero(of["pct_match"][0]), "3p_Elt_Match": zero(of["pct_match"][1]), "5p_Genome_Match": zero(of["avgmatch"][0]), "3p_Genome_Match": zero(of["avgmatch"][1]),
        "Split_reads_5prime": zero(of["sr_count"][0], "long"), "Split_reads_3prime": zero(of["sr_count"][1], "long"), "Remapped_Discordant": zero(dr, "long"), "Remap_Disc_Fraction": fraction(dr, F.col("dr_count")),
        "Remapped_Splitreads": zero(sr, "long"), "Remap_Split_Fraction": fraction(sr, zero(F.col("be1_sr_count"), "long") + zero(F.col("be2_sr_count"), "long")),
        "5p_Cons_Len": zero(F.length(of["cons_seq"][0]), "long"), "3p_Cons_Len": zero(F.length(of["cons_seq"][1]), "long"), "5p_Improved": yes(of["improved"][0]), "3p_Improved": yes(of["improved"][1]),
        "TSD_5prime": text(of["end_over"][0]), "TSD_3prime": text(of["end_over"][1]), "Sample_support_5p": text(F.array_join(of["support"][0], ",")), "Sample_support_3p": text(F.array_join(of["support"][1], ",")),
        "Sample_count": F.size(both).cast("long"), "Genomic_Consensus_5p": text(of["cons_seq"][0]), "Genomic_Consensus_3p": text(of["cons_seq"][1]),
        "Insert_Consensus_5p": text(of["te_cons_seq"][0]), "Insert_Consensus_3p": text(of["te_cons_seq"][1]), "Genotypes": text(F.nullif(F.col("genotypes"), F.lit(""))), "Filter": F.lit("NA"),
    }
    return calls.select(*[out[name].alias(name) for name in OUTPUT])


# --- joins and duplicates --------------------------------------------------------------------------------------


def duplicates_resolved(calls: DataFrame, order: list[str]) -> DataFrame:
    """Calls (chrom, be1_breakpos, be2_breakpos, be1_sr_count, be2_sr_count, dr_count) of which no preferred one shares
    chrom and be1_breakpos: two-ended before one-ended, then more split, then more discordant reads, then the first
    in `order`. A lexicographic choice, where a cascade of pairwise preferences would depend on the order of rows."""
    two_ended = (F.col("be1_breakpos") != F.col("be2_breakpos")).cast("int")
    best = [two_ended.desc(), (F.col("be1_sr_count") + F.col("be2_sr_count")).desc(), F.desc("dr_count"), *order]
    return calls.withColumn("_rank", F.row_number().over(Window.partitionBy("chrom", "be1_breakpos").orderBy(*best))).where("_rank = 1").drop("_rank")


def cascaded(calls: DataFrame, key: str, near: int = 1000) -> DataFrame:
    """key of the calls that a scan by chrom, be1_breakpos and key is left with: a call replaces the one held for its
    be1_breakpos if it has two ends and that one has not, or more split reads, or more discordant reads, any of the
    three. It is then held for its be2_breakpos as well, whatever was held there. A call held for either place stays.

    The scan is a fold over range partitions that holds open places only: a place is closed, and what it holds is returned, behind the
    be1_breakpos of the last call that touches it. That is the place itself at most, but for places that some be2_breakpos before its
    be1_breakpos or over `near` behind it touches: theirs is looked up. Calls with a
    null place or key take no part, null counts are 0, a null chrom is one of its own. key is a text; of calls with one key, those that
    repeat at a place are scanned by their ends and counts, and the key is returned once.
    """
    count = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    rows = calls.select(
        F.col("chrom").cast("string").alias("contig"), F.col("be1_breakpos").cast("long").alias("be1"), F.col(key).cast("string").alias("key"), F.col("be2_breakpos").cast("long").alias("be2"),
        (count("be1_sr_count") + count("be2_sr_count")).alias("sr"), count("dr_count").alias("dr")).where("be1 is not null and be2 is not null and key is not null")
    ends, rows = ("be1", "be2"), saved(rows, shared_folder(calls.sparkSession), "calls")
    far = rows.where((F.col("be2") < F.col("be1")) | (F.col("be2") - F.col("be1") > near)).select("contig", F.col("be2").alias("_place")).distinct()
    if far.isEmpty():
        rows = rows.withColumns({f"{end}_last": F.col(end) for end in ends})
    else:
        far = far.withColumnRenamed("contig", "_contig").withColumnRenamed("_place", "_far")
        touch = rows.select("contig", "be1", F.explode(F.array(*ends)).alias("_place"))
        last = touch.join(far, touch["contig"].eqNullSafe(far["_contig"]) & (touch["_place"] == far["_far"]), "left_semi").groupBy("contig", "_place").agg(F.max("be1").alias("_last"))
        for end in ends:
            of = last.select(F.col("contig").alias("_contig"), "_place", F.col("_last").alias(f"_{end}"))
            rows = rows.join(of, rows["contig"].eqNullSafe(of["_contig"]) & (rows[end] == of["_place"]), "left").drop("_contig", "_place")
            rows = rows.withColumn(f"{end}_last", F.coalesce(f"_{end}", end)).drop(f"_{end}")

    def closed(held: list, upto: int | None) -> tuple[list, list]:
        """Places that stay open and the calls of those whose last touch lies before upto (None: all)."""
        gone = [h for h in held if upto is None or h[1] < upto]
        return [h for h in held if not (upto is None or h[1] < upto)], [(h[2],) for h in gone]

    def step(state, row):
        contig, be1, k, be2, sr, dr, last1, last2 = row
        out = None
        if state is None:
            state = [contig, be1, []]
        elif state[1] != be1 or state[0] != contig:
            held, out = closed(state[2], be1 if state[0] == contig else None)
            state = [contig, be1, held]
        two = be1 != be2
        for old in state[2]:
            if old[0] == be1:
                if sr <= old[4] and dr <= old[5] and (old[3] or not two):
                    return state, out
                break
        state[2] = [h for h in state[2] if h[0] != be1 and h[0] != be2]
        state[2] += [[p, last, k, two, sr, dr] for p, last in {be1: last1, be2: last2}.items()]
        return state, out

    columns = ["contig", "be1", "key", "be2", "sr", "dr", "be1_last", "be2_last"]
    schema = pa.schema([("key", pa.string())])
    left = folded(ranged(rows.select(columns), columns), columns, step, schema, lambda state: closed(state[2], None)[1])
    return left.distinct().withColumnRenamed("key", key)


def renamed(calls: DataFrame, names: DataFrame, key: str, label: str) -> DataFrame:
    """One row of calls (contig, s, e) per overlapping row of names, with its label in place of the key; rows without vanish.

    Where pairs would be very many and labels are few, the names of each label are counted by a sweep and the rows
    are written out from the counts, so that no pairs are joined; empty and reversed rows are still joined.
    """
    track = names.select("contig", "s", "e", F.col(label).alias("_label"))
    labels = [r[0] for r in track.select("_label").distinct().limit(MOST_LABELS + 1).collect()] if many_pairs(calls, track, ["contig"], DEEP) else []
    if not 0 < len(labels) <= MOST_LABELS:
        met = overlap_pairs(calls, track, SHORT)
        return met.withColumn(key, F.col("_label")).drop("_label", "r_s", "r_e")
    rest, proper = [c for c in calls.columns if c != key], F.coalesce(F.col("s") < F.col("e"), F.lit(False))
    counts = label_counts(calls.where(proper).groupBy(*rest).agg(F.count(F.lit(1)).alias("_m")), track.where(proper), labels)
    each = counts.select(*rest, "_m", F.explode(F.array(*[F.struct(F.lit(x).alias("_label"), F.col(f"_n{i}").alias("_n")) for i, x in enumerate(labels)])).alias("_x"))
    each = each.select(*rest, "_x._label", (F.col("_x._n") * F.col("_m")).alias("_n")).where("_n > 0")
    each = each.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(AT_ONCE).cast("long"))))  # so that no array is long
    out = each.select(*rest, F.explode(F.array_repeat("_label", F.least(F.col("_n") - F.col("_from"), F.lit(AT_ONCE)).cast("int"))).alias(key))
    odd = overlap_pairs(calls.where(~proper), track, SHORT).unionByName(overlap_pairs(calls.where(proper), track.where(~proper), SHORT))
    return out.select(*calls.columns).unionByName(odd.withColumn(key, F.col("_label")).select(*calls.columns))


#: Pairs a row up to which joining them costs less than a sweep, labels that are counted side by side, and rows that
#: are written out from one array.
DEEP, MOST_LABELS, AT_ONCE = 512, 32, 4096


def label_counts(calls: DataFrame, names: DataFrame, labels: list) -> DataFrame:
    """Distinct calls (contig, s, e, ...) with _n0, _n1, ...: how many names (contig, s, e, _label) of each label overlap.
    Those that start before the call's end, less those that end at its start or before: a running sum each."""
    edge = lambda side, at, kind: F.struct(F.lit(side).alias("_side"), F.col(at).cast("long").alias("_at"), F.lit(kind).alias("_kind"))
    held = names.where("contig is not null").select("contig", "_label", F.explode(F.array(edge(0, "e", 0), edge(1, "s", 2))).alias("_x"))
    sums = {f"_n{i}": F.count_if(F.col("_label").eqNullSafe(F.lit(x))) for i, x in enumerate(labels)}
    held = held.groupBy("contig", "_x").agg(*[v.alias(f"_w{n}") for n, v in sums.items()]).select("contig", "_x.*", *[f"_w{n}" for n in sums], F.lit(0).cast("long").alias("_tie"))
    asked = calls.where("contig is not null").select("contig", F.explode(F.array(edge(0, "s", 1), edge(1, "e", 1))).alias("_x"), F.struct(*calls.columns).alias("_row"))
    asked = asked.select("contig", "_x.*", "_row").withColumn("_tie", F.xxhash64("_row"))
    swept = running(asked.unionByName(held, allowMissingColumns=True), ["contig", "_side"], ["_at", "_kind", "_tie"], {n: f"_w{n}" for n in sums}, "sum").where("_kind = 1")
    sign = F.when(F.col("_side") == 1, 1).otherwise(-1)
    return swept.groupBy("_row").agg(*[F.sum(sign * F.col(n)).alias(n) for n in sums]).select("_row.*", *sums)


def repaired_ids(calls: DataFrame, library: DataFrame) -> DataFrame:
    """Superfamily of calls from the library (ordinal, superfamily, subfamily) by subfamily alone, the last of equals;
    calls of unknown subfamily keep theirs."""
    last = library.groupBy(F.col("subfamily").alias("_sub")).agg(F.max_by("superfamily", "ordinal").alias("_super"))
    joined = calls.join(last, col("Subfamily") == F.col("_sub"), "left")
    return joined.withColumn("Superfamily", F.coalesce("_super", col("Superfamily"))).select(*map(col, calls.columns))


def isoform_choice(calls: DataFrame, library: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """key, element: of the library's elements (element) with the call's prefix before the last '.', that of the best
    score (key, element, score; ties: the first by name). Calls without one are left out."""
    prefix = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    met = calls.select(key, prefix(F.col("element")).alias("_prefix")).join(library.select(F.col("element").alias("element"), prefix(F.col("element")).alias("_prefix")), "_prefix")
    best = met.join(scores, [key, "element"]).groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "element")).alias("_b"))
    return best.select(key, F.col("_b.element").alias("element"))


def without_last_part(name: Column) -> Column:
    """A name without its last '.' part."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def overlapping_genes(calls: DataFrame, genes: DataFrame, key: str, family: str) -> DataFrame:
    """key of calls (contig, s, e) that overlap the gene (contig, s, e, gene) which their family is a copy of: the family
    less its last '.' part."""
    left = calls.select(key, "contig", "s", "e", without_last_part(F.col(family)).alias("_name"))
    hit = any_overlap(left, genes.withColumn("_name", F.col("gene")), ("contig", "_name"), name="_hit")
    return hit.where("_hit").select(key).distinct()


def near_family(calls: DataFrame, known: DataFrame, key: str, families: str, pad: int = 0, most_divergence: float | None = None) -> DataFrame:
    """key, near: whether a known element (contig, s, e, family, divergence) of one of the call's families (joined by
    commas) lies within pad of it; true as well on contigs that the table does not have."""
    rows = known if most_divergence is None else known.where(F.col("divergence") < most_divergence)
    left = calls.select(key, "contig", "s", "e", families)
    each = left.withColumn("_family", F.explode(F.split(families, ",")))
    hit = any_overlap(each.select(key, "contig", "s", "e", "_family"), rows.withColumn("_family", F.col("family")), ("contig", "_family"), pad, "_hit")
    hit = hit.where("_hit").select(key).distinct().withColumn("_hit", F.lit(True))
    seen = known.select(F.col("contig").alias("_contig")).distinct().withColumn("_seen", F.lit(True))
    out = left.join(hit, key, "left").join(seen, left["contig"].eqNullSafe(seen["_contig"]), "left")
    return out.select(key, (F.col("_hit").isNotNull() | F.col("_seen").isNull()).alias("near"))


def near_reference(calls: DataFrame, known: DataFrame, key: str, families: list[str], pad: int = 0, most_divergence: float | None = None) -> DataFrame:
    """A row a key: key, near: whether for one of the call's superfamilies (Superfamily, joined by commas; those among `families` alone)
    a known element (contig, s, e, family, divergence) lies within pad of it, or that family's track lacks the contig."""
    rows = known if most_divergence is None else known.where(F.col("divergence") < most_divergence)
    each = calls.select(key, "contig", "s", "e", F.explode(F.split(col("Superfamily"), ",")).alias("_family")).where(F.col("_family").isin(families))
    hit = any_overlap(each, rows.withColumn("_family", F.col("family")), ("contig", "_family"), pad, "_hit")
    seen = known.select("contig", F.col("family").alias("_family")).distinct().withColumn("_seen", F.lit(True))
    near = hit.join(seen, ["contig", "_family"], "left").groupBy(F.col(key).alias("_of")).agg(F.bool_or(F.col("_hit") | F.col("_seen").isNull()).alias("_near"))
    keys = calls.select(key).distinct()
    return keys.join(near, keys[key] == near["_of"], "left").select(key, F.coalesce("_near", F.lit(False)).alias("near"))


def screened(calls: DataFrame, mappings: DataFrame, key: str, least: float = 0.9, invert: bool = False) -> DataFrame:
    """Calls of which some mapping (key, mismatches, aligned) matches in more than `least`; with invert the others."""
    good = mappings.where(1 - F.try_divide(F.col("mismatches").cast("double"), F.col("aligned")) > least).select(key).distinct()
    return calls.join(good, key, "left_anti" if invert else "left_semi")


def outlier_features() -> dict[str, Column]:
    """Numbers that the outlier model reads off a call: lengths, the distance of both duplications, distinct bases, the
    element's span and the count of known calls (text joined by commas), 0 where one is NA."""
    here = lambda c: F.nullif(col(c), F.lit("NA"))
    size = lambda c: F.coalesce(F.length(here(c)), F.lit(0))
    bases = lambda c: F.coalesce(F.size(F.array_distinct(F.filter(F.split(here(c), ""), lambda x: x != ""))), F.lit(0))
    return {
        "tsd_len": F.greatest(size("TSD_5prime"), size("TSD_3prime")), "tsd_dist": F.coalesce(F.levenshtein(here("TSD_5prime"), here("TSD_3prime")), F.lit(0)), "tsd_bases": F.greatest(bases("TSD_5prime"), bases("TSD_3prime")),
        "elt_len": F.coalesce(number("TE_Align_End") - number("TE_Align_Start"), F.lit(0.0)), "nr_count": F.coalesce(F.size(F.split(here("NonRef"), ",")), F.lit(0)),
    }


def per_sample(name: str) -> Column:
    """A support count for each sample of a call; 0 without samples."""
    return F.coalesce(F.try_divide(number(name), number("Sample_count")), F.lit(0.0))


def break_stands(direction: Column, left: bool, identity: Column, start: Column, at: Column, window: int = 10, least: float = 0.9) -> Column:
    """Whether a breakend of the wanted side has a blocked alignment of identity over `least` that starts within the window."""
    return F.coalesce((direction == ("left" if left else "right")) & (identity > least) & (F.abs(start - at) <= window), F.lit(False))
