"""Base alignment quality: qualities capped by the chance that a base is aligned where its CIGAR puts it.

The published hidden Markov model (Li 2011, doi:10.1093/bioinformatics/btr076) runs over a band around the
read's diagonal; numpy takes all reads of one length and band of a batch together, so a step is a matrix
operation over reads and band. The model can't be an expression of columns, and this is the engine's only
Python between sources and sinks.

Reads are joined with stretches of reference by (contig, size class, bin), so none needs more than one row of
the reference. Reads keep their qualities where the contig or the qualities are missing, the CIGAR has a
reference skip or no aligned base or doesn't fit the sequence, the band covers more than MOST cells or the
read more than the largest stretch.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.tables import materialize

#: Chances of opening and extending a gap, least band on either side, highest quality, Phred offset: fixed values.
OPEN, EXTEND, BAND, HIGHEST, OFFSET = 0.001, 0.1, 7, 99, 33
#: Cells (bases times band) of a matrix and of the largest read; sizes of reference stretches.
CELLS, MOST, SIZES = 1 << 18, 1 << 23, (1 << 12, 1 << 20)
_OTHER, _OUTSIDE = 4, 5
_CODE = np.full(256, _OTHER, np.uint8)
for _i, _pair in enumerate(("Aa", "Cc", "Gg", "Tt")):
    _CODE[[ord(c) for c in _pair]] = _i
_CODE[0] = _OUTSIDE


def posterior(ref: np.ndarray, query: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances (reads, bases, band) that a base is aligned to, or inserted after, a base of the reference.

    query and error: codes and error rates (reads, bases); ref: codes (reads, bases + band - 1); base i with
    band column b stands at column i + b of ref."""
    n, size = query.shape
    wide = ref.shape[1] - size + 1
    stop = 1 / (2 * size + 2)
    go, mm, gap, im, ii = 1 - stop, (1 - 2 * OPEN) * (1 - stop), OPEN * (1 - stop), (1 - EXTEND) * (1 - stop), EXTEND * (1 - stop)
    # Reads lie side by side, so that each step goes over rows of numbers that adjoin.
    at, own, miss = np.ascontiguousarray(ref.T), np.ascontiguousarray(query.T), np.ascontiguousarray(error.T) / 3
    hit = 1 - np.ascontiguousarray(error.T)
    inside = (at != _OUTSIDE).astype(float)
    whole, plain = bool(inside.all()), at.max() < _OTHER and own.max() < _OTHER
    match = np.empty((size, wide, n))
    for i in range(size):
        match[i] = np.where(at[i : i + wide] == own[i], hit[i], miss[i])
        if not plain:
            match[i][(at[i : i + wide] >= _OTHER) | (own[i] >= _OTHER)] = 1.0
            match[i] *= inside[i : i + wide]
    step = np.arange(wide) - np.arange(wide)[:, None] - 1
    skip = (1 - EXTEND) * np.where(step >= 0, OPEN * go * EXTEND ** np.maximum(step, 0), 0)  # from column j over deleted bases to b
    back = np.ascontiguousarray(skip.T)

    def level(a, b):
        total = a.sum(0)
        total += b.sum(0)
        total[total <= 0] = 1
        a /= total
        b /= total

    fm, fi, spare = np.empty((size, wide, n)), np.empty((size, wide, n)), np.empty((wide, n))
    fm[0], fi[0] = match[0] * (1 - OPEN), inside[:wide] * OPEN / 4
    level(fm[0], fi[0])
    for i in range(1, size):
        m, ins, m_, ins_ = fm[i - 1], fi[i - 1], fm[i], fi[i]
        np.multiply(m[1:], gap / 4, out=ins_[:-1])
        ins_[-1] = 0
        ins_[:-1] += np.multiply(ins[1:], ii / 4, out=spare[1:])
        if not whole:
            ins_ *= inside[i : i + wide]
        np.matmul(back, m, out=m_)
        m_ += np.multiply(m, mm, out=spare)
        m_ += np.multiply(ins, im, out=spare)
        m_ *= match[i]
        level(m_, ins_)
    bm, bi, ahead, moved = np.full((wide, n), stop), np.full((wide, n), stop), np.empty((wide, n)), np.zeros((wide, n))
    for i in range(size - 1, -1, -1):
        if i < size - 1:
            np.multiply(match[i + 1], bm, out=ahead)
            np.multiply(bi[:-1], 0.25, out=moved[1:])
            if not whole:
                moved[1:] *= inside[i + 1 : i + wide]
            np.matmul(skip, ahead, out=bm)
            bm += np.multiply(ahead, mm, out=spare)
            bm += np.multiply(moved, gap, out=spare)
            np.multiply(ahead, im, out=bi)
            bi += np.multiply(moved, ii, out=spare)
            level(bm, bi)
        fm[i] *= bm
        fi[i] *= bi
        level(fm[i], fi[i])
    return fm.transpose(2, 0, 1), fi.transpose(2, 0, 1)


@functools.lru_cache(maxsize=65536)
def layout(cigar: str) -> tuple[tuple[tuple[int, int, int], ...], int, int, int] | None:
    """((length, offset in the read, diagonal against the first base's), ...) of the aligned runs, bases of the read, clipped before, indel bases; None if it stays as it is."""
    r = q = clip = gaps = 0
    runs = []
    for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar or ""):
        n = int(n)
        if o == "N":
            return None
        if o in "M=X":
            if runs and runs[-1][1] + runs[-1][0] == q and runs[-1][2] == r - q:
                runs[-1] = (runs[-1][0] + n, *runs[-1][1:])
            elif n:
                runs.append((n, q, r - q))
        if o == "S" and not runs:
            clip += n
        gaps += n if o in "ID" else 0
        r, q = r + (n if o in "M=XD" else 0), q + (n if o in "M=XIS" else 0)
    return (tuple(runs), q, clip, gaps) if runs else None


def cap(ref: np.ndarray, query: np.ndarray, quality: np.ndarray, runs: list, start: list[int]) -> np.ndarray:
    """Capped qualities of reads of one length and band; start: the band column of diagonal 0. Reads alike in both are capped at once, if they adjoin."""
    fm, fi = (x.transpose(1, 2, 0) for x in posterior(ref, query, 10.0 ** (-quality / 10.0)))
    top = np.maximum(fm.max(1), fi.max(1))
    out, a = np.ascontiguousarray(quality.T), 0
    for (own, zero), alike in itertools.groupby(zip(runs, start, strict=True)):
        b = a + sum(1 for _ in alike)
        for n, q, diagonal in own:
            p = fm[q : q + n, zero + diagonal, a:b]
            rated = np.floor(-10 * np.log10(np.maximum(1 - p, 1e-12)) + 0.499)
            rated = np.where(p >= top[q : q + n, a:b], np.clip(rated, 0, HIGHEST), 0)
            # A base is as sure as the surest on either side of it within its run.
            rated = np.minimum(np.maximum.accumulate(rated), np.maximum.accumulate(rated[::-1])[::-1])
            out[q : q + n, a:b] = np.minimum(out[q : q + n, a:b], rated)
        a = b
    return out.T


def _bytes(texts: list[str], size: int) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("ascii"), np.uint8).reshape(len(texts), size)


def _qualities(cigars: list, seqs: list, quals: list, refs: list, missing: list) -> list:
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (c, s, u, r) in enumerate(zip(cigars, seqs, quals, refs, strict=True)):
        known = layout(c) if c and s and u and r else None
        if known and known[1] == len(s) == len(u):
            band = max(BAND, known[3] + 3)
            if len(s) * (2 * band + 1) <= MOST:
                groups.setdefault((len(s), band), []).append(i)
    out = list(quals)
    for (size, band), rows in groups.items():
        rows.sort(key=lambda i: cigars[i])
        step = max(1, CELLS // (size * (2 * band + 1)))
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            wide = size + 2 * band
            ref = _CODE[_bytes([("\0" * missing[i] + refs[i])[:wide].ljust(wide, "\0") for i in part], wide)]
            done = [layout(cigars[i]) for i in part]
            capped = cap(ref, _CODE[_bytes([seqs[i] for i in part], size)], _bytes([quals[i] for i in part], size).astype(int) - OFFSET, [x[0] for x in done], [x[2] + band for x in done])
            text = (capped + OFFSET).astype(np.uint8).tobytes().decode("ascii")
            for k, i in enumerate(part):
                out[i] = text[k * size : (k + 1) * size]
    return out


def stretches(tiles: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """contig, _size, _bin, _first, _bases: for each size and bin the reference from bin * size on, two sizes long, as bytes, of which a piece is found without a walk over characters; gaps between tiles are N."""
    t = tiles.where(F.length("seq") > 0).select("contig", "tile_start", "seq", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("_size"))
    first, last = F.floor(F.col("tile_start") / F.col("_size")) - 1, F.floor((F.col("tile_start") + F.length("seq") - 1) / F.col("_size"))
    t = t.select("*", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)).alias("_bin"))
    start = F.greatest("tile_start", F.col("_bin") * F.col("_size"))
    stop = F.least(F.col("tile_start") + F.length("seq"), (F.col("_bin") + 2) * F.col("_size"))
    piece = F.substr("seq", (start - F.col("tile_start") + 1).cast("int"), (stop - start).cast("int"))
    parts = t.select("contig", "_size", "_bin", F.struct(start.alias("at"), F.upper(piece).alias("s")).alias("p"))
    parts = parts.groupBy("contig", "_size", "_bin").agg(F.array_sort(F.collect_list("p")).alias("p"))  # two sizes of bases at most
    least = F.col("p")[0]["at"]
    # Each piece is brought to the length up to the next one, and all are joined once: the work grows with the bases and not with their square.
    upto = lambda x, i: F.coalesce((F.get("p", i + 1)["at"] - x["at"]).cast("int"), F.length(x["s"]))
    whole = F.array_join(F.transform("p", lambda x, i: F.rpad(x["s"], upto(x, i), F.lit("N"))), "")
    return parts.select("contig", "_size", "_bin", least.alias("_first"), whole.cast("binary").alias("_bases"))


def realign(reads: DataFrame, tiles: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """reads, all columns, with capped qualities. tiles: contig, tile_start, seq."""
    names = reads.columns
    gaps = F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[ID]"), 1), F.lit(0), lambda acc, x: acc + x.cast("int"))
    clip = F.coalesce(F.regexp_extract("cigar", r"^(?:\d+H)?(\d+)S", 1).try_cast("int"), F.lit(0))
    placed = reads.withColumn("_band", F.greatest(F.lit(BAND), gaps + 3)).withColumn("_from", F.col("pos0") - clip - F.col("_band"))
    placed = placed.withColumn("_to", F.col("_from") + F.length("seq") + 2 * F.col("_band"))
    size = F.coalesce(*[F.when(F.col("_to") - F.col("_from") <= s, s) for s in sizes])
    placed = placed.withColumn("_size", size).withColumn("_bin", F.floor(F.greatest("_from", F.lit(0)) / F.col("_size")))
    # Written first: joined right away, reads and stretches would share the aggregate's exchange, and Spark could not split
    # the reads of a deep locus.
    # Hashed, since only the reads are many: they need no sort.
    joined = placed.join(materialize(stretches(tiles, sizes), "baq-stretches").hint("shuffle_hash"), ["contig", "_size", "_bin"], "left")
    start = F.greatest("_from", "_first")
    ref = F.when(F.col("_to") > start, F.substr("_bases", (start - F.col("_first") + 1).cast("int"), (F.col("_to") - start).cast("int")).cast("string"))
    ready = joined.select(*names, ref.alias("_ref"), F.when(ref.isNotNull(), (start - F.col("_from")).cast("int")).otherwise(0).alias("_missing"))

    def run(batches):
        for b in batches:
            done = _qualities(*(b.column(c).to_pylist() for c in ("cigar", "seq", "qual", "_ref", "_missing")))
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()) if c == "qual" else b.column(c) for c in names], names)

    return ready.mapInArrow(run, reads.schema)
