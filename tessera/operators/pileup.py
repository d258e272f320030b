"""From alignments to bases: flag filters, CIGAR expansion, depth cap and mate overlap.

alignments: contig, pos0, flag, mapq, cigar, qname, seq, qual [, rec_idx]. All plans stay in built-in
expressions. Bases are never shuffled: in_bins() deals the aligned runs of reads by (contig, bin), each task explodes its own, and windows,
the join with sites and the count of a site all keep to a bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars

UNMAPPED, SECONDARY, QC_FAIL, DUPLICATE = 0x4, 0x100, 0x200, 0x400
EXCLUDED = UNMAPPED | SECONDARY | QC_FAIL | DUPLICATE

#: Positions of a bin. A run becomes many bases, so bins are dealt to FAN times the session's shuffle partitions.
BIN, FAN = 512, 8


def usable(flag: Column) -> Column:
    return flag.bitwiseAND(EXCLUDED) == 0


def not_orphan(flag: Column) -> Column:
    """False for paired reads that are not properly paired."""
    return (flag.bitwiseAND(0x1) == 0) | (flag.bitwiseAND(0x2) != 0)


def filter_reads(reads: DataFrame, min_mapq: int = 0, ignore_orphans: bool = True, strand_only: bool = False) -> DataFrame:
    kept = usable(F.col("flag")) & (F.coalesce(F.col("mapq"), F.lit(255)) >= min_mapq)
    if ignore_orphans:
        kept &= not_orphan(F.col("flag"))
    if strand_only:
        kept &= scalars.strand(F.col("flag")).isNotNull()
    return reads.where(kept)


def blocks(cigar: Column) -> Column:
    """Aligned runs of a CIGAR: array of (len, r, q), offsets into the reference and the read."""
    pattern = F.lit(r"(\d+)([MIDNSHP=X])")
    sizes = F.transform(F.regexp_extract_all(cigar, pattern, 1), lambda x: x.cast("int"))
    ops = F.arrays_zip(sizes.alias("n"), F.regexp_extract_all(cigar, pattern, 2).alias("o"))
    start = F.struct(F.array().cast("array<struct<len:int,r:int,q:int>>").alias("out"), F.lit(0).alias("r"), F.lit(0).alias("q"))

    def step(acc: Column, op: Column) -> Column:
        n, o = op["n"], op["o"]
        aligned = o.isin("M", "=", "X")
        more = F.when(aligned, F.array(F.struct(n.alias("len"), acc["r"].alias("r"), acc["q"].alias("q")))).otherwise(F.array().cast("array<struct<len:int,r:int,q:int>>"))
        return F.struct(
            F.concat(acc["out"], more).alias("out"),
            (acc["r"] + F.when(aligned | o.isin("D", "N"), n).otherwise(0)).alias("r"),
            (acc["q"] + F.when(aligned | o.isin("I", "S"), n).otherwise(0)).alias("q"),
        )

    return F.aggregate(ops, start, step, lambda acc: acc["out"])


def runs(reads: DataFrame, *carried: str) -> DataFrame:
    """contig, _start, _len, _seq, _qual and the carried columns: a row for each aligned run, with its own bases."""
    each = reads.select("contig", "pos0", "seq", "qual", *[c for c in carried if c not in ("contig", "pos0", "seq", "qual")], F.inline(blocks(F.col("cigar")))).where(F.col("len") > 0)
    missing = F.col("qual").isNull() | (F.col("qual") == "*")
    own = lambda c: F.substr(c, F.col("q") + 1, F.col("len"))
    return each.select("contig", (F.col("pos0") + F.col("r")).alias("_start"), F.col("len").alias("_len"), own("seq").alias("_seq"), F.when(~missing, own("qual")).alias("_qual"), *carried)


def explode_runs(found: DataFrame, *carried: str | Column) -> DataFrame:
    """A row for each base of runs(); carried columns may look at the base's offset _i."""
    each = found.select("*", F.explode(F.sequence(F.lit(0), F.col("_len") - 1)).alias("_i"))
    return each.select("contig", (F.col("_start") + F.col("_i")).alias("pos0"), nth("_seq").alias("read_base"), F.coalesce(F.ascii(nth("_qual")) - 33, F.lit(0)).alias("bq"), *carried)


def nth(text: str) -> Column:
    return F.substr(text, F.col("_i") + 1, F.lit(1))


def expand(reads: DataFrame, *carried: str) -> DataFrame:
    """contig, pos0, read_base, bq and the carried columns: a row for each aligned base; a missing quality is 0."""
    return explode_runs(runs(reads, *carried), *carried)


def partitions(df: DataFrame) -> int:
    """As many as rows that are dealt already name in the metadata of _bin, so that what joins them is dealt alike."""
    named = df.schema["_bin"].metadata.get("partitions") if "_bin" in df.columns else None
    return named or FAN * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_bins(reads: DataFrame, *carried: str) -> DataFrame:
    """runs() with _bin, dealt by (contig, _bin): a run that goes beyond its bin is cut there.

    Reads that have _bin are dealt already, each once for every bin that it may reach, and stay where they are."""
    dealt = "_bin" in reads.columns
    found = runs(reads, *carried, *(["_bin"] if dealt else []))
    start, stop, low = F.col("_start"), F.col("_start") + F.col("_len"), F.col("_bin") * BIN
    each = found.where((start < low + BIN) & (stop > low)) if dealt else found.select("*", F.explode(F.sequence(F.floor(start / BIN), F.floor((stop - 1) / BIN))).alias("_bin"))
    first, last = F.greatest(start, low), F.least(stop, low + BIN)
    size = (last - first).cast("int")
    own = lambda c: F.substr(c, (first - start + 1).cast("int"), size).alias(c)
    cut = each.select("contig", "_bin", first.alias("_start"), size.alias("_len"), own("_seq"), own("_qual"), *carried)
    return cut if dealt else cut.repartition(partitions(reads), "contig", "_bin")


def numbered(reads: DataFrame, order: tuple[str, ...], *carried: str, mates: bool = True) -> DataFrame:
    """in_bins() with _rank, the run's place in its bin by the order of reads, and with mates _mate, the least _rank of its name there.

    Both stand for the order and the name, so that no base carries strings for them."""
    named = {c if c == "qname" else f"_order{k}": F.col(c) for k, c in enumerate(order)}
    kept = [c for c in carried if c not in named]
    found = in_bins(reads.withColumns(named), *kept, *named, *(["qname"] if mates and "qname" not in named and "qname" not in kept else []))
    w = Window.partitionBy("_bin", "contig")
    found = found.withColumn("_rank", F.row_number().over(w.orderBy(*named)))
    if mates:
        found = found.withColumn("_mate", F.min("_rank").over(Window.partitionBy("_bin", "contig", "qname")))
    return found.select("contig", "_bin", "_start", "_len", "_seq", "_qual", *carried, "_rank", *(["_mate"] if mates else []))


def position(bases: DataFrame) -> list[str]:
    """What a position is known by; with _bin, so that rows stay in the task that has their bin."""
    return ["pos0", "contig", *(["_bin"] if "_bin" in bases.columns else [])]


def reference_span(cigar: Column) -> Column:
    """Bases of the reference that an alignment takes up."""
    sizes = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), 1)
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda n, x: n + x.cast("long"))


def overlapping(reads: DataFrame, contig: str, start: int, stop: int) -> DataFrame:
    """The alignments that overlap a half-open stretch of a contig."""
    return reads.where((F.col("contig") == contig) & (F.col("pos0") < stop) & (F.col("pos0") + reference_span(F.col("cigar")) > start))


def cap_depth(bases: DataFrame, max_depth: int | None, *order: str) -> DataFrame:
    """The first max_depth bases of each column in the given order; all of them for None."""
    if max_depth is None:
        return bases
    w = Window.partitionBy(*position(bases)).orderBy(*order)
    return bases.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_depth).drop("_n")


def clip_overlap(bases: DataFrame, how: str, *order: str) -> DataFrame:
    """Of mates that cover one position. best: the base of highest quality, the first of equals.

    sum: equal bases become one of their summed quality (200 at most), of differing ones the better keeps
    eight tenths of its quality. none: all stay."""
    if how == "none":
        return bases
    w = Window.partitionBy(*position(bases), "_mate" if "_mate" in bases.columns else "qname")
    first = F.row_number().over(w.orderBy(F.desc("bq"), *order))
    if how == "best":
        return bases.withColumn("_n", first).where("_n = 1").drop("_n")
    if how != "sum":
        raise ValueError(f"unknown overlap rule {how!r}")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rated = bases.withColumn("_n", first).withColumn("_all", F.count("*").over(whole)).withColumn("_sum", F.sum("bq").over(whole)).withColumn("_same", F.min("read_base").over(whole) == F.max("read_base").over(whole))
    bq = F.when(F.col("_all") == 1, F.col("bq")).when(F.col("_same"), F.least("_sum", F.lit(200))).otherwise(F.floor(F.col("bq") * 8 / 10))
    return rated.where("_n = 1").withColumn("bq", bq.cast("int")).drop("_n", "_all", "_sum", "_same")
