"""Scalar functions as Column expressions; register_sql() makes them SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the SAM flags of proper pairs, by the strand that they were read from.
TOP_FLAGS, BOTTOM_FLAGS = (99, 147), (83, 163)


def strand(flag: Column) -> Column:
    return F.when(flag.isin(*TOP_FLAGS), "OT").when(flag.isin(*BOTTOM_FLAGS), "OB")


def call(strand_: Column, ref: Column, read: Column) -> Column:
    """1 methylated (mC read as T), 0 unmethylated, null where the base tells nothing."""
    ref, read = F.upper(ref), F.upper(read)
    top = (strand_ == "OT") & (ref == "C")
    bottom = (strand_ == "OB") & (ref == "G")
    return F.when(top & (read == "T") | bottom & (read == "A"), 1).when(top & (read == "C") | bottom & (read == "G"), 0)


def trinucleotide(base: Column, before2: Column, before: Column, after: Column, after2: Column) -> Column:
    """CpG, CHG or CHH of a C (by what follows) or a G (by what precedes); null for other bases."""
    c = F.when(after == "G", "CpG").when((after2 == "G") & after.isin("A", "C", "T"), "CHG").otherwise("CHH")
    g = F.when(before == "C", "CpG").when((before2 == "C") & before.isin("A", "G", "T"), "CHG").otherwise("CHH")
    return F.when(base == "C", c).when(base == "G", g)


def trinucleotide_at(seq: Column, pos: Column) -> Column:
    """trinucleotide() of the 0-based position of a short sequence; a missing neighbour counts as N."""
    padded, at = F.concat(F.lit("NN"), F.upper(seq), F.lit("NN")), pos + 3
    inside = (pos >= 0) & (pos < F.length(seq))
    five = [F.substr(padded, F.when(inside, at + k).otherwise(1), F.lit(1)) for k in (0, -2, -1, 1, 2)]
    return F.when(inside, trinucleotide(*five))


def context(tri: Column) -> Column:
    return F.when(tri == "CpG", "CG").when(tri.isin("CHG", "CHH"), "CH")


def barcode(qname: Column) -> Column:
    """What stands before the first colon, else before the first slash, else everything."""
    return F.when(F.instr(qname, ":") > 0, F.substring_index(qname, ":", 1)).when(F.instr(qname, "/") > 0, F.substring_index(qname, "/", 1)).otherwise(qname)


def shard(name: Column, n: int) -> Column:
    """The 128-bit big-endian MD5 of a barcode modulo n, in 32-bit steps; 0 for n of 1 or less."""
    if n <= 1:
        return F.lit(0)
    digest, out = F.md5(name.cast("binary")), F.lit(0).cast("long")
    for k in range(4):
        out = (out * (1 << 32) + F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long")) % n
    return out.cast("int")


def percent(c: Column, t: Column) -> Column:
    """100 * c / (c + t), 0 without coverage."""
    return F.when(c + t > 0, F.lit(100.0) * c / (c + t)).otherwise(0.0)


def register_sql(spark: SparkSession) -> None:
    """strand_of, call_of, trinucleotide_of, context_of, barcode_of, shard_of and percent_of as temporary SQL functions."""
    at = lambda k: f"substr(concat('NN', upper(seq), 'NN'), pos + {3 + k}, 1)"
    tri = f"CASE {at(0)} WHEN 'C' THEN CASE WHEN {at(1)} = 'G' THEN 'CpG' WHEN {at(2)} = 'G' AND {at(1)} IN ('A', 'C', 'T') THEN 'CHG' ELSE 'CHH' END WHEN 'G' THEN CASE WHEN {at(-1)} = 'C' THEN 'CpG' WHEN {at(-2)} = 'C' AND {at(-1)} IN ('A', 'G', 'T') THEN 'CHG' ELSE 'CHH' END END"
    digits = "0L"
    for k in range(4):  # 32 bits at a time, as in shard()
        digits = f"pmod({digits} * 4294967296L + cast(conv(substr(md5(cast(barcode AS BINARY)), {1 + 8 * k}, 8), 16, 10) AS BIGINT), n)"
    for text in (
        "strand_of(flag INT) RETURNS STRING RETURN CASE WHEN flag IN (99, 147) THEN 'OT' WHEN flag IN (83, 163) THEN 'OB' END",
        "call_of(s STRING, ref STRING, base STRING) RETURNS INT RETURN CASE WHEN s = 'OT' AND upper(ref) = 'C' THEN CASE upper(base) WHEN 'T' THEN 1 WHEN 'C' THEN 0 END WHEN s = 'OB' AND upper(ref) = 'G' THEN CASE upper(base) WHEN 'A' THEN 1 WHEN 'G' THEN 0 END END",
        "context_of(tri STRING) RETURNS STRING RETURN CASE WHEN tri = 'CpG' THEN 'CG' WHEN tri IN ('CHG', 'CHH') THEN 'CH' END",
        "barcode_of(q STRING) RETURNS STRING RETURN CASE WHEN instr(q, ':') > 0 THEN substring_index(q, ':', 1) WHEN instr(q, '/') > 0 THEN substring_index(q, '/', 1) ELSE q END",
        f"trinucleotide_of(seq STRING, pos INT) RETURNS STRING RETURN CASE WHEN pos BETWEEN 0 AND length(seq) - 1 THEN {tri} END",
        f"shard_of(barcode STRING, n INT) RETURNS INT RETURN CASE WHEN n <= 1 THEN 0 ELSE cast({digits} AS INT) END",
        "percent_of(c BIGINT, t BIGINT) RETURNS DOUBLE RETURN CASE WHEN c + t > 0 THEN 100.0D * c / (c + t) ELSE 0.0D END",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
