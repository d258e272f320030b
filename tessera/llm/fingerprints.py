"""Merkle tree fingerprints of documents over paragraphs and sections. DataFrame functions only.

A text is cut into atoms: words with the white space or punctuation behind them, and 64 characters at a time where
neither comes, so that texts of any script are cut. Paragraphs close after a line's end, and within long lines
after atoms whose hash is divisible by PARAGRAPH (after every second one that has no break): cuts depend on the text around them alone, so an edit changes the
paragraphs that it touches and no others. A paragraph's digest is a 64-bit hash of its text; paragraphs are gathered into
sections that close after digests divisible by SECTION and hash the chain of them, and sections alike into chapters;
the root (SHA-256) is over the digests of the chapters and their number.

A fingerprint is "root/chapters/sections/paragraphs", the 64-bit digests of each level run together in base64.
Equal roots mean equal texts; likeness is the Dice coefficient of the distinct paragraph digests, 1 for equal
roots; differing() names the chapters, sections and paragraphs that an edit changed.

Defined cases: a null text is empty and has one empty paragraph; documents follow each other in descending
doc_id, null ids last, rows of one id in descending order of their text's hash; the last is followed by the first,
a single one by itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

#: Atoms of a paragraph and branches of a section or chapter, on average; hexadecimal digits of the root; characters of an atom without a break.
PARAGRAPH, SECTION, ROOT_HEX = 16, 8, 32
UNBROKEN = 64
ATOM = f"(?:(?<=[\\s\\p{{IsPunctuation}}])|(?<=\\G.{{{UNBROKEN}}}))(?!\\z)"
#: Documents of a bucket that one task puts in order, the most buckets (their bounds are kept on the driver), and the sampled
#: documents that a bound is drawn from.
BUCKET_ROWS, MAX_BUCKETS, SAMPLED = 1000, 1 << 16, 16
_FIRST = -(2**63)
LEVELS = ("chapters", "sections", "paragraphs")


def _ends(n: Column, closes) -> Column:
    """Positions (from 1) after which a branch closes; the last one always does."""
    return F.filter(F.sequence(F.lit(1), n), lambda i: closes(i - 1) | (i == n))


def _branches(digests: Column, ends: Column) -> Column:
    """A digest chained over each branch; both arguments plain columns, as each is looked up for each part."""

    def chained(first: Column, last: Column) -> Column:
        return F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda h, i: F.xxhash64(h, F.get(digests, i)))

    return F.transform(ends, lambda e, k: chained(F.when(k == 0, 0).otherwise(F.get(ends, k - 1)), e - 1))


def with_leaves(df: DataFrame, **texts: str) -> DataFrame:
    """df with the paragraph digests of its text columns, under the given names; each step is a column of its own, so it is made once."""
    own = df.columns
    df = df.select("*", *[F.split(text, ATOM).alias(f"{name}_atoms") for name, text in texts.items()])

    def last(n: Column):
        """The position (from 1) of an atom that closes a paragraph, else null."""

        def of(atom: Column, i: Column) -> Column:
            often = F.when(F.char_length(atom) >= UNBROKEN, 2).otherwise(PARAGRAPH)
            return F.when((F.pmod(F.xxhash64(atom), often) == 0) | F.endswith(atom, F.lit("\n")) | (i == n - 1), i + 1)

        return of

    def digests(atoms: Column, ends: Column) -> Column:
        def of(end: Column, k: Column) -> Column:
            before = F.when(k == 0, 0).otherwise(F.get(ends, k - 1))
            return F.xxhash64(F.array_join(F.slice(atoms, before + 1, end - before), ""))

        return F.transform(ends, of)

    ends = [F.array_compact(F.transform(f"{name}_atoms", last(F.size(f"{name}_atoms")))).alias(f"{name}_ends") for name in texts]
    df = df.select(*own, *[f"{name}_atoms" for name in texts], *ends)
    return df.select(*own, *[digests(F.col(f"{name}_atoms"), F.col(f"{name}_ends")).alias(name) for name in texts])


def with_fingerprints(df: DataFrame, **leaves: str) -> DataFrame:
    """df with fingerprints of its columns of paragraph digests, under the given names."""
    own = df.columns
    below = leaves
    for level in LEVELS[1::-1]:
        divides = lambda c: lambda i: F.pmod(F.get(c, i), F.lit(SECTION)) == 0
        df = df.select("*", *[_ends(F.size(c), divides(F.col(c))).alias(f"{name}_{level}_ends") for name, c in below.items()])
        df = df.select("*", *[_branches(F.col(c), F.col(f"{name}_{level}_ends")).alias(f"{name}_{level}") for name, c in below.items()])
        below = {name: f"{name}_{level}" for name in leaves}
    return df.select(*own, *[_fingerprint(F.col(f"{name}_chapters"), F.col(f"{name}_sections"), F.col(c)).alias(name) for name, c in leaves.items()])


def _packed(digests: Column) -> Column:
    """64 bits each, run together in base64."""
    return F.base64(F.unhex(F.array_join(F.transform(digests, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def _fingerprint(chapters: Column, sections: Column, paragraphs: Column) -> Column:
    top = F.concat_ws(" ", F.size(chapters).cast("string"), F.array_join(F.transform(chapters, lambda x: x.cast("string")), " "))
    return F.concat_ws("/", F.substring(F.sha2(top, 256), 1, ROOT_HEX), *[F.translate(_packed(x), "/\r\n", "-") for x in (chapters, sections, paragraphs)])


def branches(fingerprint: Column, level: str) -> Column:
    """The digests of a level, as 16 hexadecimal digits each."""
    part = F.get(F.split(fingerprint, "/"), F.lit(1 + LEVELS.index(level)))
    return F.regexp_extract_all(F.hex(F.unbase64(F.translate(part, "-", "/"))), F.lit(".{16}"), 0)


def likeness(x: Column, y: Column) -> Column:
    """Dice coefficient of two arrays of distinct paragraph digests."""
    return 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))


def likeness_of(a: Column, b: Column) -> Column:
    """The same from two fingerprints."""
    return likeness(*[F.array_distinct(branches(x, "paragraphs")) for x in (a, b)])


def differing(a: Column, b: Column) -> Column:
    """Positions (from 0) of the chapters, sections and paragraphs of fingerprint a that fingerprint b lacks; none if the roots agree."""
    none = F.array().cast("array<int>")

    def lacking(level: str) -> Column:
        mine, other = branches(a, level), branches(b, level)
        gone, every = F.array_except(mine, other), F.sequence(F.lit(0), F.size(mine) - 1)
        some = F.filter(every, lambda i: F.array_contains(gone, F.get(mine, i)))
        return F.when(F.size(gone) == 0, none).when(F.size(F.array_intersect(mine, other)) == 0, every).otherwise(some)

    same = F.get(F.split(a, "/"), F.lit(0)) == F.get(F.split(b, "/"), F.lit(0))
    return F.struct(*[F.when(same, none).otherwise(lacking(level)).alias(level) for level in LEVELS])


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, text, next_text: the text of the document that follows in descending doc_id, from the last to the first."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_at", F.struct(F.coalesce("doc_id", F.lit(_FIRST)).alias("k"), F.xxhash64("text").alias("h")))
    n = rows.count()
    side = max(1, math.ceil(math.sqrt(min(MAX_BUCKETS, n / bucket_rows))))
    # Bounds of side * side buckets from a sample by hash, so rows of one id are split too, by the hash of their text. The bounds
    # deal rows to tasks and decide no result.
    every = max(1, n // (SAMPLED * side * side))
    sample = rows.where(F.pmod(F.xxhash64("_at"), F.lit(every)) == 0).select("_at").distinct().collect()  # about SAMPLED * side * side pairs of numbers
    sample = sorted((r[0].k, r[0].h) for r in sample) or [(0, 0)]
    bounds = [sample[min(len(sample) - 1, len(sample) * (i + 1) // (side * side))] for i in range(side * side)]
    kind = "array<struct<k:bigint,h:bigint>>"
    listed = lambda pairs: F.array(*[F.struct(F.lit(k).alias("k"), F.lit(h).alias("h")) for k, h in pairs]).cast(kind)
    # In two levels, so that a row is compared with 2 * side bounds.
    below = lambda numbers: F.size(F.filter(numbers, lambda b: b < F.col("_at")))
    fine = F.array(*[listed(bounds[i * side : (i + 1) * side - 1]) for i in range(side)])
    rows = rows.withColumn("_coarse", below(listed(bounds[side - 1 :: side][:-1])))
    rows = rows.withColumn("_bucket", F.col("_coarse") * side + below(F.get(fine, F.col("_coarse")))).drop("_coarse")
    tops = sorted((r[0], r[1].k, r[1].h) for r in rows.groupBy("_bucket").agg(F.max("_at")).collect())  # at most MAX_BUCKETS
    # The first document of each bucket also ends the bucket above; that of the highest ends the lowest.
    copies = [(k, h, tops[(i + 1) % len(tops)][0]) for i, (_, k, h) in enumerate(tops)]
    ends = spark.createDataFrame(copies, "_k long, _h long, _above int")
    placed = rows.join(F.broadcast(ends), (F.col("_at.k") == F.col("_k")) & (F.col("_at.h") == F.col("_h")), "left")  # at most MAX_BUCKETS rows
    one = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("end"))
    two = F.array(one, F.struct(F.col("_above").alias("b"), F.lit(True).alias("end")))
    placed = placed.withColumn("_in", F.explode(F.when(F.col("_above").isNull(), F.array(one)).otherwise(two)))
    order = Window.partitionBy("_in.b").orderBy("_in.end", F.desc("_at.k"), F.desc("_at.h"))
    return placed.withColumn("next_text", F.lead("text").over(order)).where(~F.col("_in.end")).select("doc_id", "text", "next_text")


def op10_merkle_fingerprints(spark, sf_dir: str) -> DataFrame:
    pairs = with_next(table(spark, sf_dir, "documents"))
    pairs = pairs.withColumn("n_chars", F.length("text").cast("long")).withColumn("_half", F.floor(F.col("n_chars") / 2).cast("int"))
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - F.col("_half")), F.substr("next_text", F.lit(1), F.col("_half")))
    pairs = pairs.withColumn("edited", edited).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    trees = with_leaves(pairs, mine="text", changed="edited", after="next_text").select("doc_id", "n_chars", "edited_sha256", "mine", "changed", "after")
    trees = trees.select("*", *[F.array_distinct(c).alias(f"{c}_set") for c in ("mine", "changed", "after")])
    trees = with_fingerprints(trees, fingerprint="mine", edited_fingerprint="changed")
    near = {"near_edited": "changed_set", "near_next": "after_set"}
    return trees.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *[likeness(F.col("mine_set"), F.col(c)).alias(k) for k, c in near.items()])
