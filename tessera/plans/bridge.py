"""Alignments and a reference derived from the test tables, alike in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import pileup

ORDER = ("pos0", "qname", "flag")
MIN_MAPQ, MIN_BASE_QUALITY, MAX_DEPTH, SHARDS, WINDOW = 10, 20, 8, 13, 1000
#: Line items of a task: it sorts the bases of both reads of each in memory, however few partitions the session has.
ITEMS = 60_000

_TILES = """
SELECT 'chr' || (1 + p_partkey % 3) AS contig, CAST((p_partkey {div} 3) * 32 AS BIGINT) AS tile_start,
       translate(md5(CAST(p_partkey AS {str})), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM {part}
"""
_CONTIG = "'chr' || (1 + l_partkey % 3)"
_POS0 = "CAST((l_partkey {div} 3) * 32 + l_orderkey % 32 + {m} * (l_orderkey % 24) AS BIGINT)"
_FLAG = """CAST(CASE WHEN l_orderkey % 23 = 0 THEN {m} * 16 WHEN l_orderkey % 29 = 0 THEN 1123 + {m} * 48 WHEN l_orderkey % 31 = 0 THEN 355 + {m} * 48
    WHEN l_orderkey % 37 = 0 THEN 65 + {m} * 64 WHEN l_suppkey % 2 = 0 THEN 99 + {m} * 48 ELSE 83 + {m} * 80 END AS INT)"""
_CIGAR = "CASE l_linenumber % 5 WHEN 0 THEN '32M' WHEN 1 THEN '4S28M' WHEN 2 THEN '10M2D22M' WHEN 3 THEN '10M2I20M' ELSE '16M50N16M' END"
#: Positions that a read of each CIGAR takes up.
_SPAN = "CASE l_linenumber % 5 WHEN 0 THEN 32 WHEN 1 THEN 28 WHEN 2 THEN 34 WHEN 3 THEN 30 ELSE 82 END"
_READS_OF = f"""
SELECT {{contig}} AS contig,
  {_POS0.format(div="{div}", m="m")} AS pos0,
  {_FLAG.format(m="m")} AS flag,
  CAST(l_quantity AS INT) AS mapq,
  {_CIGAR} AS cigar,
  'BC' || (l_suppkey % 40) || CASE WHEN l_orderkey % 10 = 0 THEN '/' ELSE ':' END || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS qname,
  translate(md5('s' || l_orderkey || '-' || l_linenumber || '-' || m), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq,
  translate(md5('q' || l_orderkey || '-' || l_linenumber || '-' || m), '0123456789abcdef', '+-/13579;=?ACEGI') AS qual{{more}}
FROM {{lineitem}} {{mates}}
"""
_MATES = "LATERAL VIEW explode(array(0, 1)) AS m"
_READS = _READS_OF.replace("{contig}", _CONTIG).replace("{more}", "")
TILES_SQL = _TILES.format(div="//", str="VARCHAR", part="part")
READS_SQL = _READS.format(div="//", lineitem="lineitem", mates="CROSS JOIN (SELECT unnest([0, 1]) AS m)")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_TILES.format(div="div", str="STRING", part="{part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def reads(spark: SparkSession, sf_dir: str, spread: bool = True) -> DataFrame:
    """Two mates for each line item. spread: dealt to all cores, since the file may be a single row group, so a single task."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    items = items.repartition(2 * spark.sparkContext.defaultParallelism) if spread else items
    return spark.sql(_READS.format(div="div", lineitem="{lineitem}", mates=_MATES), lineitem=items)


def reads_in_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reads() of either strand with _bin, each in all bins that it may reach, dealt by (contig, _bin).

    A line item is a fraction of its two reads, so that items are dealt, and reads are made where their bin is. Items are counted
    by the file's footers, so that a task gets ITEMS of them on average at most."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    first, last = (F.expr(_POS0.format(div="div", m=m)) for m in (0, 1))
    flags = [F.expr(_FLAG.format(m=m)) for m in (0, 1)]
    items = items.where(scalars.strand(flags[0]).isNotNull() | scalars.strand(flags[1]).isNotNull())
    bins = F.sequence(F.floor(first / pileup.BIN), F.floor((last + F.expr(_SPAN) - 1) / pileup.BIN))
    n = max(pileup.partitions(items), -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // ITEMS))
    items = items.select("*", F.expr(_CONTIG).alias("contig"), F.explode(bins).alias("_bin")).withMetadata("_bin", {"partitions": n})
    dealt = items.repartition(n, "contig", "_bin")
    return spark.sql(_READS_OF.format(div="div", contig="contig", more=", _bin", lineitem="{lineitem}", mates=_MATES), lineitem=dealt)


def whitelist(spark: SparkSession) -> DataFrame:
    # A range has a known size: the list is broadcast as the query is planned, and calls stay where they are.
    return spark.range(0, 40, 2).select(F.concat(F.lit("BC"), F.col("id").cast("string")).alias("barcode"))


def contigs(tiles_: DataFrame) -> DataFrame:
    return tiles_.groupBy("contig").agg(F.max(F.col("tile_start") + F.length("seq")).alias("length"))


CONTIG_LIST = ["chr2", "chr1", "chr3"]
