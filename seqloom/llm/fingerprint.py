"""Document fingerprints by one-permutation MinHash (operator 5): built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import saved, shared_folder

#: A shingle's hash has its bin in the highest bits, and the bits that a fingerprint keeps in the lowest.
BINS, BIN_BITS, KEPT_BITS = 128, 7, 8


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once a row, however often a function inside `then` runs."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def bin_of(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS)


def shingles(text: Column, size: int) -> Column:
    """Hashes of the text's shingles of `size` words (parted by x20, x09-x0D); fewer words are one shingle."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def hashed(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - size + 1)), lambda i: F.xxhash64(F.slice(w, i, size)))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(every)

    return let(F.transform(words, lambda w: F.xxhash64(w)), hashed)


def bin_minima(hashes: Column) -> Column:
    """The least hash of each bin that has one: sorted, a bin's hashes follow each other."""
    return let(F.sort_array(hashes), lambda s: F.filter(s, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(s, i - 1)))))


def densified(minima: Column) -> Column:
    """array<int> of every bin's kept bits; an empty bin takes those of the filled bin that comes first in an
    order of bins of its own, the same for all documents (a hash of both bins), which is optimal
    densification: the first filled bin of a random probe sequence. Empty without shingles."""
    low = 2**KEPT_BITS - 1

    def filled(m: Column, bins: Column) -> Column:
        def value(k: Column) -> Column:
            at = F.array_position(bins, k)
            own = F.get(m, (at - 1).cast("int"))
            probed = F.array_min(F.transform(m, lambda h: F.xxhash64(k, bin_of(h)).bitwiseAND(F.lit(~low)).bitwiseOR(h.bitwiseAND(F.lit(low)))))
            return F.when(at > 0, own).otherwise(probed).bitwiseAND(F.lit(low)).cast("int")

        return F.when(F.size(m) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), value))

    return let(minima, lambda m: let(F.transform(m, bin_of), lambda bins: filled(m, bins)))


def bits_of(text: Column, size: int) -> Column:
    return densified(bin_minima(shingles(text, size)))


def packed(bits: Column) -> Column:
    """Hex text of the kept bits, which are held less half their range, as one byte each."""
    return F.array_join(F.transform(bits, lambda v: F.lpad(F.lower(F.hex(v.cast("int") + 2 ** (KEPT_BITS - 1))), KEPT_BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of bins with equal bits, less those equal by chance; 1 for two empty fingerprints, 0 for one."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda v: v)) / F.lit(float(BINS))
    chance = 2.0**-KEPT_BITS
    fair = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(fair)


def successors(ids: DataFrame, folder: str) -> DataFrame:
    """id, next_id: the next distinct id upwards, after the last the first.

    Ids are range partitioned, each part is ordered on its own, and one row a part links the parts.
    """
    parts = saved(ids.select("id").distinct().repartitionByRange("id").withColumn("part", F.spark_partition_id()), folder, "parts")
    in_part = Window.partitionBy("part").orderBy("id")
    rows = parts.select("id", "part", F.lead(F.struct("id")).over(in_part).alias("next"))
    firsts = parts.groupBy("part").agg(F.min(F.struct("id")).alias("first"))
    links = firsts.select("part", F.coalesce(F.lead("first").over(Window.orderBy("part")), F.first("first").over(Window.orderBy("part"))).alias("after"))
    return rows.join(links, "part").select("id", F.coalesce("next", "after")["id"].alias("next_id"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A fingerprint is 128 packed bytes in hex: the lowest 8 bits of the least shingle hash in each of 128 bins,
    empty bins filled by optimal densification; likeness of two is the share of equal bytes, corrected for
    those equal by chance. The edited text replaces the last floor(n_chars / 2) code points by the first as
    many (or all) of the next document, by ascending id; after the last comes the first.

    Null text is empty; a text without a word has the empty fingerprint, like to another empty one (1) and to
    nothing else (0). Of rows with one id, the one with the least SHA-256 of its text is the next document of
    their predecessor; a null id comes first. A single id is its own next document. An empty table gives no
    rows; other columns are ignored.

    Whole texts are shuffled once, by id (both joins read the same exchange), half texts once to their
    predecessors, and fingerprints as 128 bytes each. Keys are the id and whether it is null, so that what an
    aggregation has dealt is not dealt again for the join after it.
    """
    folder = shared_folder(docs.sparkSession)
    zero = F.lit(0).cast(dict(docs.dtypes)[id_col])
    key = lambda c, name: [F.coalesce(c, zero).alias(name), c.isNull().alias(f"{name}_null")]
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    half_chars = docs.groupBy("id").agg(F.max(F.floor(F.char_length("text") / 2)).cast("int").alias("need"))
    after = successors(docs, folder)
    links = after.join(half_chars, after["id"].eqNullSafe(half_chars["id"])).select(*key(after["id"], "before"), *key(F.col("next_id"), "next"), "need")
    links = saved(links, folder, "links")
    docs = docs.select("text", *key(F.col("id"), "k"))  # the same columns for both joins: one exchange
    of_next = (F.col("k") == F.col("next")) & (F.col("k_null") == F.col("next_null"))
    of_own = (F.col("k") == F.col("before")) & (F.col("k_null") == F.col("before_null"))
    head = docs.join(links, of_next).select("before", "before_null", F.struct(F.sha2("text", 256).alias("sha"), F.substring(F.col("text"), F.lit(1), F.col("need")).alias("head")).alias("h"))
    head = head.groupBy("before", "before_null").agg(F.min("h")["head"].alias("head"))
    n = F.char_length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    both = docs.join(head, of_own).select(
        F.when(~F.col("k_null"), F.col("k")).alias("id"), "text", n.alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n.cast("int") - half), F.substring(F.col("head"), F.lit(1), half)).alias("edited"))
    kept = lambda c: F.transform(bits_of(F.col(c), shingle), lambda v: (v - 2 ** (KEPT_BITS - 1)).cast("tinyint"))
    digest = lambda c: F.unhex(F.sha2(c, 256))
    made = saved(both.select("id", "n_chars", digest("text").alias("sha"), digest("edited").alias("edited_sha"), kept("text").alias("bits"), kept("edited").alias("edited_bits")), folder, "made")
    made = made.select("*", *key(F.col("id"), "k"))
    following = made.groupBy("k", "k_null").agg(F.min(F.struct("sha", "bits"))["bits"].alias("next_bits"))
    following = following.join(links, of_next).select("before", "before_null", "next_bits")
    return made.join(following, of_own).select(
        F.col("id").alias(id_col), "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"), packed(F.col("bits")).alias("fingerprint"), packed(F.col("edited_bits")).alias("edited_fingerprint"),
        likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"), likeness(F.col("bits"), F.col("next_bits")).alias("near_next"))
