"""Methylation calls: bases joined with reference sites, per cell and site counts, and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import pileup, reference


def calls(reads: DataFrame, sites: DataFrame, whitelist: DataFrame | None = None, min_mapq: int = 0, min_base_quality: int = 20, max_depth: int | None = 250, overlap: str = "best", order: tuple[str, ...] = ("rec_idx",)) -> DataFrame:
    """barcode, contig, pos0, tri, call, _bin (of the position): a row for each informative base.

    Applied in this order: strand flags, mapping quality, CIGAR, base quality, depth cap, mate overlap, call,
    whitelist. Sites take away whole columns, so they may stand before the windows: that halves what they
    sort. Runs of reads and sites are dealt by (contig, bin) once, and everything up to the count of a site stays in the
    task that has the bin. Without a depth cap no read decides on another barcode's (mates share theirs), so the whitelist
    then stands before the CIGAR expansion."""
    mates, ranked, early = overlap != "none", max_depth is not None or overlap != "none", whitelist is not None and max_depth is None
    bases = _bases_at_sites(reads, sites, whitelist if early else None, min_mapq, order if ranked else None, mates, *(["read_base"] if overlap == "sum" else []))
    bases = bases.where(F.col("bq") >= min_base_quality) if overlap != "sum" else bases
    kept = pileup.clip_overlap(pileup.cap_depth(bases, max_depth, "_rank"), overlap, "_rank")
    kept = kept.where(F.col("bq") >= min_base_quality) if overlap == "sum" else kept
    called = kept.where("call IS NOT NULL").select("barcode", "contig", "pos0", "tri", "call", "_bin")
    return called if whitelist is None or early else keep_listed(called, whitelist)


def _bases_at_sites(reads: DataFrame, sites: DataFrame, whitelist: DataFrame | None, min_mapq: int, order: tuple[str, ...] | None, mates: bool, *more: str) -> DataFrame:
    """barcode, contig, pos0, bq, tri, call, _bin [, _rank, _mate, more]: all bases of reads of either strand that stand at sites."""
    used = reads.where(F.coalesce(F.col("mapq"), F.lit(255)) >= min_mapq).withColumn("strand", scalars.strand(F.col("flag"))).where("strand IS NOT NULL")
    used = used.withColumn("barcode", scalars.barcode(F.col("qname")))
    used = used if whitelist is None else keep_listed(used, whitelist)
    runs = pileup.numbered(used, order, "strand", "barcode", mates=mates) if order else pileup.in_bins(used, "strand", "barcode")
    # One row for each bin: a run takes the letters of its own positions, and no base has to be looked up.
    strings = reference.site_strings(sites, pileup.BIN, pileup.partitions(reads)).hint("shuffle_hash")
    own = F.substr("_sites", (F.col("_start") - F.col("_bin") * pileup.BIN + 1).cast("int"), F.col("_len"))
    placed = runs.join(strings, ["contig", "_bin"]).withColumn("_sites", own)
    marks = [c for c in ("_bin", "_rank", "_mate") if c in runs.columns]
    code = F.col("_code")
    bases = pileup.explode_runs(placed, *marks, "strand", "barcode", pileup.nth("_sites").alias("_code")).where(code.isin(*reference.CODES))
    call = scalars.call(F.col("strand"), reference.base_of(code), F.col("read_base")).alias("call")
    return bases.select("barcode", "contig", "pos0", "bq", reference.tri_of(code).alias("tri"), call, *marks, *more)


def keep_listed(rows: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Rows whose barcode is listed; Spark broadcasts the list if it is small."""
    return rows.join(whitelist.select("barcode").distinct(), "barcode", "left_semi")


def site_counts(called: DataFrame) -> DataFrame:
    """barcode, context, tri, chr, pos (1-based), pct, t, c."""
    counted = called.groupBy("barcode", *pileup.position(called), "tri").agg(F.count_if(F.col("call") == 0).alias("t"), F.count_if(F.col("call") == 1).alias("c"))
    return counted.select("barcode", scalars.context(F.col("tri")).alias("context"), "tri", F.col("contig").alias("chr"), (F.col("pos0") + 1).alias("pos"), scalars.percent(F.col("c"), F.col("t")).alias("pct"), "t", "c")


def context_stats(counts: DataFrame) -> DataFrame:
    """context (CpG, CHG, CHH, CG, CH, Pooled), c, t, pct in one pass."""
    summed = counts.groupingSets([["context", "tri"], ["context"], []], "context", "tri").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    named = F.coalesce("tri", "context", F.lit("Pooled")).alias("context")
    c, t = F.coalesce("c", F.lit(0)), F.coalesce("t", F.lit(0))
    return summed.select(named, c.alias("c"), t.alias("t"), scalars.percent(c, t).alias("pct"))


def site_differences(counts: DataFrame, other: DataFrame) -> DataFrame:
    """barcode, context, chr, pos, t, c, other_t, other_c of the sites whose counts differ between two runs; 0 where one lacks a site."""
    key = ["barcode", "context", "chr", "pos"]
    both = counts.select(*key, "t", "c").join(other.select(*key, F.col("t").alias("other_t"), F.col("c").alias("other_c")), key, "full").na.fill(0, ["t", "c", "other_t", "other_c"])
    return both.where("t <> other_t OR c <> other_c")


def rule_differences(reads: DataFrame, sites: DataFrame, min_mapq: int = 0, min_base_quality: int = 20, max_depth: int = 250, order: tuple[str, ...] = ("rec_idx",)) -> DataFrame:
    """site_differences() between the run with depth cap and the best of mates and the run without either, in one pass: bases are marked and not dropped."""
    bases = _bases_at_sites(reads, sites, None, min_mapq, order, True).where(F.col("bq") >= min_base_quality)
    at = pileup.position(bases)
    capped = bases.withColumn("_in", F.row_number().over(Window.partitionBy(*at).orderBy("_rank")) <= max_depth)
    first = F.row_number().over(Window.partitionBy(*at, "_mate").orderBy(F.desc("_in"), F.desc("bq"), "_rank")) == 1
    marked = capped.withColumn("_in", F.col("_in") & first)
    of = lambda call, kept: F.count_if((F.col("call") == call) & kept)
    every, kept = F.lit(True), F.col("_in")
    counted = marked.groupBy("barcode", *at, "tri").agg(of(0, kept).alias("t"), of(1, kept).alias("c"), of(0, every).alias("other_t"), of(1, every).alias("other_c"))
    return counted.where("t <> other_t OR c <> other_c").select("barcode", scalars.context(F.col("tri")).alias("context"), F.col("contig").alias("chr"), (F.col("pos0") + 1).alias("pos"), "t", "c", "other_t", "other_c")


def contig_breakdown(counts: DataFrame, reads: DataFrame) -> DataFrame:
    """chr, mapped_reads, cells, and c, t, pct of CG and CH."""
    of = lambda ctx, x: F.coalesce(F.sum(F.when(F.col("context") == ctx, F.col(x))), F.lit(0))
    sums = counts.groupBy("chr").agg(F.countDistinct("barcode").alias("cells"), *[of(ctx, x).alias(f"{ctx.lower()}_{x}") for ctx in ("CG", "CH") for x in ("c", "t")])
    mapped = reads.groupBy(F.col("contig").alias("chr")).agg(F.count_if(F.col("flag").bitwiseAND(pileup.UNMAPPED) == 0).alias("mapped_reads"))
    out = mapped.join(sums, "chr", "left").na.fill(0)
    return out.select("chr", "mapped_reads", "cells", "cg_c", "cg_t", scalars.percent(F.col("cg_c"), F.col("cg_t")).alias("cg_pct"), "ch_c", "ch_t", scalars.percent(F.col("ch_c"), F.col("ch_t")).alias("ch_pct"))


def cell_summary(counts: DataFrame) -> DataFrame:
    """barcode, sites and calls by context, pct."""
    of = lambda ctx, x: F.coalesce(F.sum(F.when(F.col("context") == ctx, x)), F.lit(0))
    s = counts.groupBy("barcode").agg(*[of(ctx, x).cast("long").alias(f"{ctx.lower()}_{n}") for ctx in ("CG", "CH") for n, x in (("sites", F.lit(1)), ("c", F.col("c")), ("t", F.col("t")))])
    return s.withColumns({f"{x}_pct": scalars.percent(F.col(f"{x}_c"), F.col(f"{x}_t")) for x in ("cg", "ch")})


def cells_per_shard(counts: DataFrame, n_shards: int) -> DataFrame:
    cells = counts.select("barcode").distinct()
    return cells.groupBy(scalars.shard(F.col("barcode"), n_shards).alias("shard")).agg(F.count("*").alias("n_cells"))


def resolve_shards(cells: int, explicit: int = 0) -> int:
    """The explicit number, else by cells; the fixed steps are 10, 50 and 100 thousand."""
    return explicit or next((n for most, n in ((10_000, 1), (50_000, 8), (100_000, 16)) if cells < most), 32)


def sorted_cells(counts: DataFrame, order: DataFrame, n_shards: int) -> DataFrame:
    """counts with shard, contig_ord and row_no: the rank of a row within its cell and context, by contig list order and position."""
    placed = counts.join(F.broadcast(order.select(F.col("contig").alias("chr"), "contig_ord")), "chr")
    placed = placed.repartition(pileup.partitions(placed), "barcode", "context")  # few whole groups to sort in a task
    w = Window.partitionBy("barcode", "context").orderBy("contig_ord", "pos")
    return placed.withColumn("shard", scalars.shard(F.col("barcode"), n_shards)).withColumn("row_no", F.row_number().over(w))
