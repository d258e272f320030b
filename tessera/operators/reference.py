"""Reference sequence tables: windows, and cytosine sites with their context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars

#: Chromosomes that are taken where none are named: fixed values, in this order.
CANONICAL = [f"chr{n}" for n in range(1, 20)] + ["chrX", "chrY"]


def order_contigs(contigs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """contig, contig_ord, length of the named contigs (or the canonical ones) in list order; absent and repeated names go."""
    wanted = [n.strip() for n in (names if names is not None else CANONICAL)]
    listed = [(n, i) for i, n in enumerate(dict.fromkeys(n for n in wanted if n))]
    order = contigs.sparkSession.createDataFrame(listed, "contig string, contig_ord int")
    return contigs.select("contig", "length").join(F.broadcast(order), "contig").select("contig", "contig_ord", "length")


def plan_windows(contigs: DataFrame, size: int) -> DataFrame:
    """chunk_id, contig, start, stop: half-open windows, numbered over contigs in contig_ord order."""
    size = max(1, size)
    counts = F.ceil(F.col("length") / size)
    before = F.sum(counts).over(Window.orderBy("contig_ord")) - counts  # one row for each contig
    planned = contigs.where(F.col("length") > 0).withColumn("_before", before)
    each = planned.select("*", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("_i", "start"))
    return each.select((F.col("_before") + F.col("_i")).cast("long").alias("chunk_id"), "contig", "start", F.least(F.col("start") + size, F.col("length")).alias("stop"))


def with_halo(tiles: DataFrame) -> DataFrame:
    """contig, tile_start, seq, halo: seq in capitals, and with two bases more on either side, N where no tile lends them.

    A tile's own ends carry its outer bases to the tiles that touch it, keyed by (contig, position), so that a contig is
    as many groups as it has tiles and no window orders it."""
    t = tiles.select("contig", F.col("tile_start").cast("long").alias("tile_start"), F.upper(F.regexp_replace("seq", "[\r\n]", "")).alias("seq")).where(F.length("seq") > 0)
    stop = F.col("tile_start") + F.length("seq")
    # Three short rows beside a tile's own: what it lends to a tile that begins where it ends, and to one that ends where it begins.
    lends = F.array(
        F.struct(stop.alias("at"), F.lit(True).alias("left"), F.substring("seq", -2, 2).alias("bases")),
        F.struct(F.col("tile_start").alias("at"), F.lit(False).alias("left"), F.substring("seq", 1, 2).alias("bases")),
    )
    lent = t.select("contig", F.inline(lends))
    before = lent.where("left").select(F.col("contig").alias("_c1"), F.col("at").alias("_start"), F.col("bases").alias("_before"))
    after = lent.where("NOT left").select(F.col("contig").alias("_c2"), F.col("at").alias("_stop"), F.col("bases").alias("_after"))
    t = t.join(before, (F.col("contig") == F.col("_c1")) & (F.col("tile_start") == F.col("_start")), "left")
    t = t.join(after, (F.col("contig") == F.col("_c2")) & (stop == F.col("_stop")), "left")
    halo = F.concat(F.lpad(F.coalesce("_before", F.lit("")), 2, "N"), "seq", F.rpad(F.coalesce("_after", F.lit("")), 2, "N"))
    return t.select("contig", "tile_start", "seq", halo.alias("halo"))


def sites(tiles: DataFrame) -> DataFrame:
    """contig, pos0, ref_base, tri of every C and G. tiles: contig, tile_start, seq; neighbouring tiles lend two bases each."""
    t = with_halo(tiles)
    each = t.select("contig", "tile_start", "halo", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)).alias("i"))
    base = [F.substr("halo", F.col("i") + k, F.lit(1)) for k in (3, 1, 2, 4, 5)]
    found = each.select("contig", (F.col("tile_start") + F.col("i")).cast("long").alias("pos0"), base[0].alias("ref_base"), scalars.trinucleotide(*base).alias("tri"))
    return found.where(F.col("ref_base").isin("C", "G"))


#: A letter for each kind of site: its base and context.
CODES = {"a": ("C", "CpG"), "b": ("C", "CHG"), "c": ("C", "CHH"), "d": ("G", "CpG"), "e": ("G", "CHG"), "f": ("G", "CHH")}


def coded(tiles: DataFrame) -> DataFrame:
    """contig, tile_start, codes: the sites() of a tile as a letter of CODES for each of its positions, a dot for none.

    What was a C or a G stays known by its letter, so that each pass still sees the neighbours of the next."""
    code = F.col("halo")
    for pattern, letter in (("C(?=G)", "a"), ("C(?=[ACTabc]G)", "b"), ("C", "c"), ("(?<=a)G", "d"), ("(?<=[abc][AGTd])G", "e"), ("G", "f"), ("[^a-f]", ".")):
        code = F.regexp_replace(code, pattern, letter)
    return with_halo(tiles).select("contig", "tile_start", F.substr(code, F.lit(3), F.length("seq")).alias("codes"))


def site_strings(sites: DataFrame, size: int, n: int) -> DataFrame:
    """contig, _bin, _sites: for each bin of positions with a site its letters of CODES in order, from the bin's first position on; a dot for none.

    sites: rows of sites(), or of coded(), which are a letter for a position where those are a row."""
    if "codes" in sites.columns:
        start, stop, low = F.col("tile_start"), F.col("tile_start") + F.length("codes"), F.col("_bin") * size
        each = sites.select("*", F.explode(F.sequence(F.floor(start / size), F.floor((stop - 1) / size))).alias("_bin"))
        first = F.greatest(start, low)
        own = F.substr("codes", (first - start + 1).cast("int"), (F.least(stop, low + size) - first).cast("int"))
        at = each.select("contig", "_bin", F.struct((first - low).cast("int").alias("at"), own.alias("code")).alias("s"))
    else:
        code = F.coalesce(*[F.when((F.upper("ref_base") == base) & (F.col("tri") == tri), k) for k, (base, tri) in CODES.items()])
        at = sites.select("contig", F.floor(F.col("pos0") / size).alias("_bin"), F.struct((F.col("pos0") % size).cast("int").alias("at"), code.alias("code")).alias("s")).where("s.code IS NOT NULL")
    found = at.repartition(n, "contig", "_bin").groupBy("contig", "_bin").agg(F.array_sort(F.collect_list("s")).alias("s"))  # a bin of them at most
    put = lambda acc, x: F.concat(F.rpad(acc, x["at"], F.lit(".")), x["code"], F.substr(acc, x["at"] + F.length(x["code"]) + 1))
    return found.select("contig", "_bin", F.aggregate("s", F.lit(""), put).alias("_sites"))


def base_of(code: Column) -> Column:
    return F.when(code.isin("a", "b", "c"), "C").otherwise("G")


def tri_of(code: Column) -> Column:
    return F.when(code.isin("a", "d"), "CpG").when(code.isin("b", "e"), "CHG").otherwise("CHH")
