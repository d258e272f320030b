"""One call from alignments to written sites and a summary."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import baq as base_alignment
from tessera.operators import calling, pileup, reference
from tessera.sources import bam, sinks, tables, text


def read_alignments(spark: SparkSession, path: str, region: tuple[str, int, int] | None = None) -> DataFrame:
    """By the name's end: .bam, .sam or .sam.gz, else Parquet in the same columns; region: only alignments that overlap it."""
    if path.endswith(".bam"):
        return bam.read_bam(spark, path, region)
    reads = text.read_sam(spark, path) if path.endswith((".sam", ".sam.gz")) else spark.read.parquet(path)
    return pileup.overlapping(reads, *region) if region else reads


def peak_memory_mb(spark: SparkSession) -> int:
    """The most memory that the driver's JVM or any executor's has held so far."""
    sc = spark.sparkContext
    own = sum(p.getPeakUsage().getUsed() for p in sc._jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans() if p.getType().toString() == "Heap memory")
    known, most = sc._jsc.sc().statusStore().executorList(False), own
    for i in range(known.size()):
        metrics = known.apply(i).peakMemoryMetrics()
        if metrics.isDefined():
            most = max(most, metrics.get().getMetricValue("JVMHeapMemory"))
    return most >> 20


def extract_methylation(
    spark: SparkSession, alignments: str, fasta: str, out: str | None, chroms: list[str] | None = None, whitelist: str | None = None, min_base_quality: int = 20, min_mapq: int = 0,
    max_depth: int | None = 250, ignore_orphans: bool = True, overlap: str = "best", n_shards: int = 0, codec: str = "zstd", start: int | None = None, stop: int | None = None,
    baq: bool = False, write: bool = True, dump_sites: str | None = None,
    hdf5: str | None = None, hdf5_codec: str = "gzip", hdf5_version: str = "", mode: str = "overwrite",
) -> dict:
    """Writes sites (Parquet by context and shard, with an index) and returns the run's summary.

    start and stop, given together, restrict the run to that half-open stretch of the first contig: only alignments
    that overlap it are read. baq caps qualities by base alignment quality. Without out nothing but dump_sites
    and hdf5 is written, and with none of them only the summary is made, from sums for each cell; write=False leaves
    the sites out and keeps their counts. dump_sites names a folder for the sorted table of sites, hdf5 one for a file of
    each shard and a master file, whose layout hdf5_version names. mode append adds to the sites that are there."""
    began = time.time()
    entries = text.fasta_index(fasta)
    known = spark.createDataFrame([(e[0], e[1]) for e in entries], "contig string, length long")
    order = reference.order_contigs(known, chroms)
    names = [r["contig"] for r in order.orderBy("contig_ord").collect()]  # a row for each contig
    region = (names[0], start, stop) if start is not None and stop is not None and names else None
    read = names[:1] if region else names
    reads = read_alignments(spark, alignments, region).where(F.col("contig").isin(read))
    tiles = text.read_fasta(spark, fasta).where(F.col("contig").isin(read))
    near = tiles.where((F.col("tile_start") >= start - 2 - text.TILE) & (F.col("tile_start") < stop + 2)) if region else tiles
    sites = reference.sites(near)
    sites = sites.where((F.col("pos0") >= start) & (F.col("pos0") < stop)) if region else sites
    listed = text.read_whitelist(spark, whitelist) if whitelist else None
    seen = Observation()
    kept = pileup.filter_reads(reads, min_mapq, ignore_orphans).observe(seen, F.count(F.lit(1)).alias("reads"))
    with tables.scratch():
        kept = base_alignment.realign(kept.where(scalars.strand(F.col("flag")).isNotNull()), tiles) if baq else kept
        counts = calling.site_counts(calling.calls(kept, sites, listed, min_mapq, min_base_quality, max_depth, overlap))
        counts = counts.select("barcode", "context", "tri", "chr", "pos", "pct", "t", "c")
        if out:
            counts.write.mode("overwrite").parquet(f"{out}/counts")
            counts = spark.read.parquet(f"{out}/counts")
        elif dump_sites or hdf5:
            counts = tables.materialize(counts, "counts")
        sums = tables.materialize(counts.groupBy("barcode", "context", "tri").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "cell-sums")
        cells = sums.select("barcode").distinct().count()
        shards = calling.resolve_shards(cells, n_shards)
        if write and out:
            sinks.write_sites(counts, order, out, shards, codec, mode)
        if hdf5:
            sinks.write_hdf5(counts, order, hdf5, hdf5_version, shards, hdf5_codec)
        if dump_sites:
            sinks.write_tsv(counts, dump_sites)
        stats = {r["context"]: {"c": r["c"], "t": r["t"], "pct": r["pct"]} for r in calling.context_stats(sums).collect()}
    took, reads_used = time.time() - began, seen.get["reads"]
    return {"cells": cells, "shards": shards, "contigs": names, "contexts": stats, "seconds": took, "reads": reads_used, "reads_per_second": reads_used / took, "cells_per_minute": 60 * cells / took, "peak_memory_mb": peak_memory_mb(spark)}


def extract_batch(spark: SparkSession, alignments: list[str], fasta: str, out: str | None, **options) -> dict[str, dict]:
    """extract_methylation() of several files, each to a folder of its own name without ending; summaries by that name."""
    named = {os.path.basename(path).split(".")[0]: path for path in alignments}
    if len(named) < len(alignments):
        raise ValueError("two files have the same name")
    return {name: extract_methylation(spark, path, fasta, f"{out}/{name}" if out else None, **options) for name, path in named.items()}


def summary_line(summary: dict) -> str:
    part = lambda k: "{k}={pct:.4f}% ({c}/{n})".format(k=k, n=summary["contexts"][k]["c"] + summary["contexts"][k]["t"], **{x: summary["contexts"][k][x] for x in ("pct", "c")})
    return " ".join([f"cells={summary['cells']}", *(part(k) for k in ("CpG", "CHG", "CHH", "CH", "Pooled") if k in summary["contexts"])])
