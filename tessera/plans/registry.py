"""Queries by name over the derived fixture, and DuckDB SQL that checks each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import baq, calling, pileup, reference
from tessera.plans import bridge

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


STRAND = "CASE WHEN flag IN (99, 147) THEN 'OT' WHEN flag IN (83, 163) THEN 'OB' END"
BARCODE = "CASE WHEN position(':' IN qname) > 0 THEN split_part(qname, ':', 1) WHEN position('/' IN qname) > 0 THEN split_part(qname, '/', 1) ELSE qname END"
CALL = "CASE WHEN strand = 'OT' AND ref_base = 'C' THEN CASE read_base WHEN 'T' THEN 1 WHEN 'C' THEN 0 END WHEN strand = 'OB' AND ref_base = 'G' THEN CASE read_base WHEN 'A' THEN 1 WHEN 'G' THEN 0 END END"
PCT = "CASE WHEN {c} + {t} > 0 THEN 100.0::DOUBLE * {c} / ({c} + {t}) ELSE 0.0::DOUBLE END"
SHARD = "(" + "(" * 4 + "0" + "".join(f" * 4294967296 + ('0x' || substr(md5(barcode), {1 + 8 * k}, 8))::BIGINT) % {bridge.SHARDS}" for k in range(4)) + ")::INT"

_READS = f"reads AS ({bridge.READS_SQL})"
_SITES = f"""tiles AS ({bridge.TILES_SQL}),
bp AS (SELECT contig, tile_start + i AS pos0, substr(seq, i + 1, 1) AS b FROM (SELECT *, unnest(range(0, 32))::INT AS i FROM tiles)),
nb AS (SELECT contig, pos0, b, coalesce(CASE WHEN lag(pos0, 1) OVER w = pos0 - 1 THEN lag(b, 1) OVER w END, 'N') AS p1, coalesce(CASE WHEN lag(pos0, 2) OVER w = pos0 - 2 THEN lag(b, 2) OVER w END, 'N') AS p2,
  coalesce(CASE WHEN lead(pos0, 1) OVER w = pos0 + 1 THEN lead(b, 1) OVER w END, 'N') AS n1, coalesce(CASE WHEN lead(pos0, 2) OVER w = pos0 + 2 THEN lead(b, 2) OVER w END, 'N') AS n2 FROM bp WINDOW w AS (PARTITION BY contig ORDER BY pos0)),
sites AS (SELECT contig, pos0, b AS ref_base, CASE b WHEN 'C' THEN CASE WHEN n1 = 'G' THEN 'CpG' WHEN n2 = 'G' AND n1 <> 'N' THEN 'CHG' ELSE 'CHH' END
  ELSE CASE WHEN p1 = 'C' THEN 'CpG' WHEN p2 = 'C' AND p1 <> 'N' THEN 'CHG' ELSE 'CHH' END END AS tri FROM nb WHERE b IN ('C', 'G'))"""


def _bases(where: str) -> str:
    return rf"""{_READS}, used AS MATERIALIZED (SELECT row_number() OVER () AS rid, *, {STRAND} AS strand, {BARCODE} AS barcode FROM reads WHERE {where}),
ops AS (SELECT rid, generate_subscripts(n, 1) AS k, unnest(n)::INT AS n, unnest(o) AS o FROM (SELECT rid, regexp_extract_all(cigar, '(\d+)([MIDNSHP=X])', 1) AS n, regexp_extract_all(cigar, '(\d+)([MIDNSHP=X])', 2) AS o FROM used)),
offs AS (SELECT rid, n, o, coalesce(sum(CASE WHEN o IN ('M', '=', 'X', 'D', 'N') THEN n ELSE 0 END) OVER w, 0)::INT AS r, coalesce(sum(CASE WHEN o IN ('M', '=', 'X', 'I', 'S') THEN n ELSE 0 END) OVER w, 0)::INT AS q FROM ops
  WINDOW w AS (PARTITION BY rid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
steps AS (SELECT rid, r, q, unnest(range(0, n))::INT AS i FROM offs WHERE o IN ('M', '=', 'X')),
bases AS (SELECT u.contig, u.pos0 + r + i AS pos0, substr(seq, q + i + 1, 1) AS read_base, ascii(substr(qual, q + i + 1, 1)) - 33 AS bq, strand, barcode, qname, flag, u.pos0 AS start0 FROM steps JOIN used u USING (rid))"""


_USED = f"mapq >= {bridge.MIN_MAPQ} AND flag IN (99, 147, 83, 163)"
_CAPPED = f"{_bases(_USED)}, good AS (SELECT * FROM bases WHERE bq >= {bridge.MIN_BASE_QUALITY}), capped AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY contig, pos0 ORDER BY start0, qname, flag) <= {bridge.MAX_DEPTH})"
_BEST = f"{_CAPPED}, best AS (SELECT * FROM capped QUALIFY row_number() OVER (PARTITION BY contig, pos0, qname ORDER BY bq DESC, start0, qname, flag) = 1)"
_CALLS = f"{_BEST}, {_SITES}, calls AS (SELECT * FROM (SELECT barcode, contig, pos0, tri, {CALL} AS call FROM best JOIN sites USING (contig, pos0)) WHERE call IS NOT NULL)"
_COUNTS = f"""{_CALLS}, counts AS (SELECT barcode, CASE tri WHEN 'CpG' THEN 'CG' ELSE 'CH' END AS context, tri, chr, pos, {PCT.format(c='c', t='t')} AS pct, t, c FROM
 (SELECT barcode, tri, contig AS chr, pos0 + 1 AS pos, count(*) FILTER (call = 0) AS t, count(*) FILTER (call = 1) AS c FROM calls GROUP BY ALL))"""


def _counts(spark: SparkSession, sf_dir: str, whitelist: DataFrame | None = None, **more) -> DataFrame:
    return calling.site_counts(_called(spark, sf_dir, whitelist, **more))


def _called(spark: SparkSession, sf_dir: str, whitelist: DataFrame | None = None, **more) -> DataFrame:
    rules = {"min_mapq": bridge.MIN_MAPQ, "min_base_quality": bridge.MIN_BASE_QUALITY, "max_depth": bridge.MAX_DEPTH, "overlap": "best", "order": bridge.ORDER} | more
    return calling.calls(bridge.reads_in_bins(spark, sf_dir), reference.coded(bridge.tiles(spark, sf_dir)), whitelist, **rules)


def _used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.reads(spark, sf_dir).where(_USED)


def _good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.expand(_used(spark, sf_dir)).where(F.col("bq") >= bridge.MIN_BASE_QUALITY)


def _stacked(spark: SparkSession, sf_dir: str, mates: bool = True) -> DataFrame:
    """Bases of all qualities in their bins, with the places of their reads."""
    marks = ["_bin", "_rank", *(["_mate"] if mates else [])]
    return pileup.explode_runs(pileup.numbered(_used(spark, sf_dir), bridge.ORDER, mates=mates), *marks)


def _columns(bases: DataFrame) -> DataFrame:
    summed = bases.groupBy(*pileup.position(bases)).agg(F.count("*").alias("n"), F.sum("bq").alias("bq"))
    return summed.select("contig", "pos0", "n", "bq")


@query(f"WITH {_COUNTS} SELECT * FROM counts")
def flagship(spark, sf_dir):
    return _counts(spark, sf_dir)


@query(f"WITH {_bases(_USED)}, {_SITES}, calls AS (SELECT * FROM (SELECT barcode, contig, pos0, tri, {CALL} AS call FROM bases JOIN sites USING (contig, pos0) WHERE bq >= 20) WHERE call IS NOT NULL) SELECT barcode, CASE tri WHEN 'CpG' THEN 'CG' ELSE 'CH' END AS context, tri, contig AS chr, pos0 + 1 AS pos, {PCT.format(c='count(*) FILTER (call = 1)', t='count(*) FILTER (call = 0)')} AS pct, count(*) FILTER (call = 0) AS t, count(*) FILTER (call = 1) AS c FROM calls GROUP BY barcode, tri, contig, pos0")
def site_counts(spark, sf_dir):
    """Without depth cap and overlap rule no window is needed at all."""
    return _counts(spark, sf_dir, max_depth=None, overlap="none")


@query(f"WITH {_READS} SELECT flag, {STRAND} AS strand, count(*) AS n FROM reads GROUP BY ALL")
def strand_classify(spark, sf_dir):
    return bridge.reads(spark, sf_dir).groupBy("flag", scalars.strand(F.col("flag")).alias("strand")).agg(F.count("*").alias("n"))


@query(f"WITH {_bases(_USED)}, {_SITES} SELECT strand, ref_base, read_base, {CALL} AS call, count(*) AS n FROM bases JOIN sites USING (contig, pos0) GROUP BY ALL")
def mctot_call(spark, sf_dir):
    reads = _used(spark, sf_dir).withColumn("strand", scalars.strand(F.col("flag")))
    at = pileup.expand(reads, "strand").join(reference.sites(bridge.tiles(spark, sf_dir)).hint("shuffle_hash"), ["contig", "pos0"])
    return at.groupBy("strand", "ref_base", "read_base", scalars.call(F.col("strand"), F.col("ref_base"), F.col("read_base")).alias("call")).agg(F.count("*").alias("n"))


@query(f"WITH {_SITES} SELECT contig, pos0, ref_base, tri FROM sites")
def ref_sites(spark, sf_dir):
    return reference.sites(bridge.tiles(spark, sf_dir))


@query(f"""WITH tiles AS ({bridge.TILES_SQL}), x AS (SELECT contig, tile_start, i AS pos, 'NN' || seq || 'NN' AS s FROM tiles, (SELECT unnest(range(-1, 33))::INT AS i)),
y AS (SELECT contig, tile_start, pos, CASE WHEN pos BETWEEN 0 AND 31 THEN substr(s, pos + 3, 1) END AS b, substr(s, pos + 1, 1) AS p2, substr(s, pos + 2, 1) AS p1, substr(s, pos + 4, 1) AS n1, substr(s, pos + 5, 1) AS n2 FROM x)
SELECT contig, tile_start, pos, CASE b WHEN 'C' THEN CASE WHEN n1 = 'G' THEN 'CpG' WHEN n2 = 'G' AND n1 <> 'N' THEN 'CHG' ELSE 'CHH' END WHEN 'G' THEN CASE WHEN p1 = 'C' THEN 'CpG' WHEN p2 = 'C' AND p1 <> 'N' THEN 'CHG' ELSE 'CHH' END END AS tri FROM y""")
def trinuc_context(spark, sf_dir):
    t = bridge.tiles(spark, sf_dir).withColumn("pos", F.explode(F.sequence(F.lit(-1), F.length("seq"))))
    return t.select("contig", "tile_start", "pos", scalars.trinucleotide_at(F.col("seq"), F.col("pos")).alias("tri"))


@query(f"WITH {_SITES} SELECT tri, CASE tri WHEN 'CpG' THEN 'CG' ELSE 'CH' END AS context, count(*) AS n FROM sites GROUP BY ALL")
def context_collapse(spark, sf_dir):
    return ref_sites(spark, sf_dir).groupBy("tri", scalars.context(F.col("tri")).alias("context")).agg(F.count("*").alias("n"))


@query(f"WITH {_READS} SELECT qname, {BARCODE} AS barcode FROM reads")
def barcode_extract(spark, sf_dir):
    return bridge.reads(spark, sf_dir).select("qname", scalars.barcode(F.col("qname")).alias("barcode"))


@query(f"WITH {_READS}, b AS (SELECT DISTINCT {BARCODE} AS barcode FROM reads) SELECT barcode, {SHARD} AS shard FROM b")
def shard_assign(spark, sf_dir):
    b = barcode_extract(spark, sf_dir).select("barcode").distinct()
    return b.select("barcode", scalars.shard(F.col("barcode"), bridge.SHARDS).alias("shard"))


_CONTIGS = "contigs AS (SELECT contig, max(tile_start + 32) AS length, CASE contig WHEN 'chr2' THEN 0 WHEN 'chr1' THEN 1 ELSE 2 END AS contig_ord FROM tiles GROUP BY contig)"


def _contigs(spark, sf_dir):
    return reference.order_contigs(bridge.contigs(bridge.tiles(spark, sf_dir)), bridge.CONTIG_LIST)


@query(f"""WITH tiles AS ({bridge.TILES_SQL}), {_CONTIGS}, s AS (SELECT contig, contig_ord, length, unnest(range(0, length, {bridge.WINDOW})) AS start FROM contigs)
SELECT row_number() OVER (ORDER BY contig_ord, start) - 1 AS chunk_id, contig, start, least(start + {bridge.WINDOW}, length) AS stop FROM s""")
def plan_windows(spark, sf_dir):
    return reference.plan_windows(_contigs(spark, sf_dir), bridge.WINDOW)


@query(f"WITH {_bases(_USED)} SELECT contig, pos0, count(*) AS n, sum(bq)::BIGINT AS bq, count(*) FILTER (read_base = 'T') AS t_bases FROM bases GROUP BY ALL")
def cigar_expand(spark, sf_dir):
    bases = pileup.expand(_used(spark, sf_dir))
    return bases.groupBy("contig", "pos0").agg(F.count("*").alias("n"), F.sum("bq").alias("bq"), F.count_if(F.col("read_base") == "T").alias("t_bases"))


@query(f"WITH {_READS} SELECT * FROM reads WHERE flag & 1796 = 0")
def flag_filter(spark, sf_dir):
    return pileup.filter_reads(bridge.reads(spark, sf_dir), ignore_orphans=False)


@query(f"WITH {_READS} SELECT * FROM reads WHERE flag & 1796 = 0 AND (flag & 1 = 0 OR flag & 2 <> 0)")
def orphan_filter(spark, sf_dir):
    return pileup.filter_reads(bridge.reads(spark, sf_dir))


@query(f"WITH {_READS} SELECT * FROM reads WHERE flag & 1796 = 0 AND (flag & 1 = 0 OR flag & 2 <> 0) AND mapq >= {bridge.MIN_MAPQ}")
def mapq_filter(spark, sf_dir):
    return pileup.filter_reads(bridge.reads(spark, sf_dir), min_mapq=bridge.MIN_MAPQ)


@query(f"WITH {_bases(_USED)} SELECT contig, pos0, count(*) AS n, min(bq)::INT AS least FROM bases WHERE bq >= 20 GROUP BY ALL")
def baseq_filter(spark, sf_dir):
    return _good(spark, sf_dir).groupBy("contig", "pos0").agg(F.count("*").alias("n"), F.min("bq").alias("least"))


@query(f"WITH {_CAPPED} SELECT contig, pos0, count(*) AS n, sum(bq)::BIGINT AS bq FROM capped GROUP BY ALL")
def depth_cap(spark, sf_dir):
    good = _stacked(spark, sf_dir, mates=False).where(F.col("bq") >= bridge.MIN_BASE_QUALITY).drop("read_base")
    return _columns(pileup.cap_depth(good, bridge.MAX_DEPTH, "_rank"))


@query(f"WITH {_BEST} SELECT contig, pos0, count(*) AS n, sum(bq)::BIGINT AS bq FROM best GROUP BY ALL")
def overlap_best(spark, sf_dir):
    good = _stacked(spark, sf_dir).where(F.col("bq") >= bridge.MIN_BASE_QUALITY).drop("read_base")
    return _columns(pileup.clip_overlap(pileup.cap_depth(good, bridge.MAX_DEPTH, "_rank"), "best", "_rank"))


@query(f"""WITH {_bases(_USED)}, x AS (SELECT *, row_number() OVER (PARTITION BY contig, pos0, qname ORDER BY bq DESC, start0, qname, flag) AS k, count(*) OVER p AS n, sum(bq) OVER p AS total, min(read_base) OVER p = max(read_base) OVER p AS same
FROM bases WINDOW p AS (PARTITION BY contig, pos0, qname)), y AS (SELECT contig, pos0, (CASE WHEN n = 1 THEN bq WHEN same THEN least(total, 200) ELSE floor(bq * 8 / 10) END)::INT AS bq FROM x WHERE k = 1)
SELECT contig, pos0, count(*) AS n, sum(bq)::BIGINT AS bq FROM y WHERE bq >= 20 GROUP BY ALL""")
def overlap_sum(spark, sf_dir):
    kept = pileup.clip_overlap(_stacked(spark, sf_dir), "sum", "_rank").where(F.col("bq") >= bridge.MIN_BASE_QUALITY)
    return _columns(kept)


@query(f"WITH {_COUNTS} SELECT * FROM counts WHERE replace(barcode, 'BC', '')::INT % 2 = 0")
def whitelist_semi(spark, sf_dir):
    return _counts(spark, sf_dir, bridge.whitelist(spark))


@query(f"WITH {_COUNTS} SELECT * FROM counts WHERE chr = 'chr1' AND pos BETWEEN 101 AND 5000")
def region_filter(spark, sf_dir):
    return _counts(spark, sf_dir).where("chr = 'chr1' AND pos BETWEEN 101 AND 5000")


@query(f"""WITH {_COUNTS}, s AS (SELECT coalesce(tri, context, 'Pooled') AS context, coalesce(sum(c), 0)::BIGINT AS c, coalesce(sum(t), 0)::BIGINT AS t FROM counts GROUP BY GROUPING SETS ((context, tri), (context), ()))
SELECT context, c, t FROM s""")
def context_stats(spark, sf_dir):
    return calling.context_stats(_counts(spark, sf_dir)).select("context", "c", "t")


@query(f"""WITH {_COUNTS}, s AS (SELECT coalesce(tri, context, 'Pooled') AS context, coalesce(sum(c), 0)::BIGINT AS c, coalesce(sum(t), 0)::BIGINT AS t FROM counts GROUP BY GROUPING SETS ((context, tri), (context), ()))
SELECT context, {PCT.format(c='c', t='t')} AS pct FROM s""")
def percentages(spark, sf_dir):
    return calling.context_stats(_counts(spark, sf_dir)).select("context", "pct")


@query(f"""WITH {_COUNTS}, m AS (SELECT contig AS chr, count(*) FILTER (flag & 4 = 0) AS mapped_reads FROM reads GROUP BY contig),
s AS (SELECT chr, count(DISTINCT barcode) AS cells, coalesce(sum(c) FILTER (context = 'CG'), 0)::BIGINT AS cg_c, coalesce(sum(t) FILTER (context = 'CG'), 0)::BIGINT AS cg_t, coalesce(sum(c) FILTER (context = 'CH'), 0)::BIGINT AS ch_c, coalesce(sum(t) FILTER (context = 'CH'), 0)::BIGINT AS ch_t FROM counts GROUP BY chr)
SELECT chr, mapped_reads, cells, cg_c, cg_t, {PCT.format(c='cg_c', t='cg_t')} AS cg_pct, ch_c, ch_t, {PCT.format(c='ch_c', t='ch_t')} AS ch_pct FROM m JOIN s USING (chr)""")
def contig_breakdown(spark, sf_dir):
    return calling.contig_breakdown(_counts(spark, sf_dir), bridge.reads(spark, sf_dir, spread=False))  # only counted


@query(f"WITH {_COUNTS} SELECT count(DISTINCT barcode) AS n_cells FROM counts")
def distinct_cells(spark, sf_dir):
    return _called(spark, sf_dir).agg(F.countDistinct("barcode").alias("n_cells"))


@query(f"WITH {_COUNTS}, b AS (SELECT DISTINCT barcode FROM counts) SELECT {SHARD} AS shard, count(*) AS n_cells FROM b GROUP BY 1")
def cells_per_shard(spark, sf_dir):
    return calling.cells_per_shard(_counts(spark, sf_dir), bridge.SHARDS)


@query(f"""WITH {_COUNTS}, s AS (SELECT barcode, count(*) FILTER (context = 'CG') AS cg_sites, coalesce(sum(c) FILTER (context = 'CG'), 0)::BIGINT AS cg_c, coalesce(sum(t) FILTER (context = 'CG'), 0)::BIGINT AS cg_t,
 count(*) FILTER (context = 'CH') AS ch_sites, coalesce(sum(c) FILTER (context = 'CH'), 0)::BIGINT AS ch_c, coalesce(sum(t) FILTER (context = 'CH'), 0)::BIGINT AS ch_t FROM counts GROUP BY barcode)
SELECT *, {PCT.format(c='cg_c', t='cg_t')} AS cg_pct, {PCT.format(c='ch_c', t='ch_t')} AS ch_pct FROM s""")
def cell_summary(spark, sf_dir):
    return calling.cell_summary(_counts(spark, sf_dir))


@query(f"""WITH {_COUNTS}, {_CONTIGS.replace('contigs AS', 'cl AS')} SELECT counts.*, contig_ord::INT AS contig_ord, {SHARD} AS shard, row_number() OVER (PARTITION BY barcode, context ORDER BY contig_ord, pos)::INT AS row_no FROM counts JOIN cl ON chr = contig""")
def sorted_cell_dataset(spark, sf_dir):
    return calling.sorted_cells(_counts(spark, sf_dir), _contigs(spark, sf_dir), bridge.SHARDS)


@query(f"WITH {_COUNTS} SELECT barcode, context AS ctx, chr, pos, t, c FROM counts")
def site_dump(spark, sf_dir):
    counts = _counts(spark, sf_dir).select("barcode", F.col("context").alias("ctx"), "chr", "pos", "t", "c")
    # A sort by range reads its input twice, the first time for bounds: it then finds counts, and not bases to count again.
    return counts.repartition("barcode", "chr", "pos").orderBy("barcode", "ctx", "chr", "pos")


@query(f"WITH {_COUNTS} SELECT barcode FROM counts WHERE context = 'CG' UNION SELECT barcode FROM counts WHERE context = 'CH'")
def barcode_union(spark, sf_dir):
    return _counts(spark, sf_dir).where("context IN ('CG', 'CH')").select("barcode").distinct()


@query(f"WITH {_COUNTS} SELECT chr, (pos - 1) // {bridge.WINDOW} AS window_no, sum(t)::BIGINT AS t, sum(c)::BIGINT AS c FROM counts GROUP BY ALL")
def window_counts(spark, sf_dir):
    number = F.floor((F.col("pos") - 1) / bridge.WINDOW).cast("long").alias("window_no")
    return _counts(spark, sf_dir).groupBy("chr", number).agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


@query(f"""WITH {_COUNTS}, free AS (SELECT barcode, CASE tri WHEN 'CpG' THEN 'CG' ELSE 'CH' END AS context, contig AS chr, pos0 + 1 AS pos, count(*) FILTER (call = 0) AS t, count(*) FILTER (call = 1) AS c
 FROM (SELECT barcode, contig, pos0, tri, {CALL} AS call FROM good JOIN sites USING (contig, pos0)) WHERE call IS NOT NULL GROUP BY barcode, tri, contig, pos0)
SELECT barcode, context, chr, pos, coalesce(a.t, 0) AS t, coalesce(a.c, 0) AS c, coalesce(b.t, 0) AS other_t, coalesce(b.c, 0) AS other_c FROM counts a FULL JOIN free b USING (barcode, context, chr, pos)
WHERE coalesce(a.t, 0) <> coalesce(b.t, 0) OR coalesce(a.c, 0) <> coalesce(b.c, 0)""")
def site_differences(spark, sf_dir):
    """What depth cap and overlap rule change."""
    rules = {"min_mapq": bridge.MIN_MAPQ, "min_base_quality": bridge.MIN_BASE_QUALITY, "max_depth": bridge.MAX_DEPTH, "order": bridge.ORDER}
    return calling.rule_differences(bridge.reads(spark, sf_dir), reference.sites(bridge.tiles(spark, sf_dir)), **rules)


@query(f"WITH {_READS}, span AS (SELECT *, list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MDN=X]', 1), lambda x: x::BIGINT)) AS n FROM reads) SELECT contig, pos0, flag, mapq, cigar, qname, seq, qual FROM span WHERE contig = 'chr1' AND pos0 < 5000 AND pos0 + n > 100")
def region_reads(spark, sf_dir):
    return pileup.overlapping(bridge.reads(spark, sf_dir), "chr1", 100, 5000)


@query(f"WITH {_bases(_USED + " AND replace(replace(regexp_extract(qname, '^[^:/]*'), 'BC', ''), '/', '')::INT % 2 = 0")}, {_SITES}, calls AS (SELECT * FROM (SELECT barcode, contig, pos0, tri, {CALL} AS call FROM bases JOIN sites USING (contig, pos0) WHERE bq >= 20) WHERE call IS NOT NULL) SELECT barcode, CASE tri WHEN 'CpG' THEN 'CG' ELSE 'CH' END AS context, tri, contig AS chr, pos0 + 1 AS pos, {PCT.format(c='count(*) FILTER (call = 1)', t='count(*) FILTER (call = 0)')} AS pct, count(*) FILTER (call = 0) AS t, count(*) FILTER (call = 1) AS c FROM calls GROUP BY barcode, tri, contig, pos0")
def whitelist_early(spark, sf_dir):
    """Without a depth cap the whitelist stands before the CIGAR expansion."""
    return _counts(spark, sf_dir, bridge.whitelist(spark), max_depth=None, overlap="none")


def baq_qualities(spark, sf_dir):
    """The model has no SQL: tests hold it against sums over all paths."""
    return baq.realign(_used(spark, sf_dir), bridge.tiles(spark, sf_dir)).select("contig", "pos0", "flag", "qname", "qual")


QUERIES["baq_qualities"] = baq_qualities
