"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are dealt to virtual partitions by a hash, the numbers that each partition sends to each shard are
drawn from the multivariate hypergeometric law (what a uniform permutation would give), each partition is
permuted locally to decide which rows go where, rows are exchanged, and each shard is permuted again.
All orders are total orders of seeded row hashes, so a task that is run again makes the same choice; rows that
repeat are hashed with their place in a written copy of the input.

Defined cases: null texts and null ids are ordinary rows; rows that repeat exactly are interchangeable;
an empty table gives an empty result; columns of the input named shard or slot are replaced, all others are kept.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialize, table

#: Rows of a virtual partition, and of a part of a shard that one task permutes.
PART_ROWS, MAX_PARTS = 200_000, 1 << 16


def _log_factorial(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    small = np.array([math.lgamma(k + 1) for k in range(32)])
    y = np.maximum(x, 1)
    series = y * np.log(y) - y + 0.5 * np.log(2 * np.pi * y) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return np.where(x < 32, small[np.minimum(x, 31).astype(int)], series)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good; numpy's sampler ends at 1e9, beyond it the law is inverted."""
    if n == 0 or good == 0:
        return 0
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mean = n * good / total
    wide = 40 + 12 * math.sqrt(max(n * good / total * bad / total * (total - n) / max(total - 1, 1), 1))
    k = np.arange(max(0, n - bad, int(mean - wide)), min(n, good, int(mean + wide)) + 1)
    log_p = -(_log_factorial(k) + _log_factorial(good - k) + _log_factorial(n - k) + _log_factorial(bad - n + k))
    p = np.cumsum(np.exp(log_p - log_p.max()))
    return int(k[min(np.searchsorted(p, rng.random() * p[-1]), len(k) - 1)])


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Rows that each partition sends to each shard: rows sum to counts, columns to sizes."""
    rng, left = np.random.Generator(np.random.PCG64(seed)), [int(x) for x in sizes]
    out = np.zeros((len(counts), len(sizes)), np.int64)
    for p, n in enumerate(counts):
        rest, n = sum(left), int(n)
        for s, room in enumerate(left):
            rest -= room
            out[p, s] = x = hypergeometric(rng, room, rest, n)
            n -= x
        left = [room - int(x) for room, x in zip(left, out[p], strict=True)]
    return out


def shuffle_into_shards(df: DataFrame, n_shards: int = 40, seed: int = 17) -> DataFrame:
    """df's rows with shard (0 to n_shards - 1, sizes at most one apart) and slot (0, 1, ... in each shard)."""
    df = df.drop("shard", "slot")
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    # The caller's columns travel as one, so that no name of theirs meets one of these. Rows that repeat, and they alone, are
    # told apart by their place in a first table, which is written and so keeps it: many equal rows are no large group.
    first = materialize(df.select(row.alias("own"), F.struct(*[f"`{c}`" for c in df.columns]).alias("row"), F.monotonically_increasing_id().alias("place")), "sharding-input")
    twice = materialize(first.groupBy("own").count().where("count > 1").select(F.col("own").alias("twice")), "sharding-repeated")
    tag = F.when(F.col("twice").isNotNull(), F.col("place")).otherwise(-1)
    held = first.join(twice, F.col("own") == F.col("twice"), "left")
    held = held.select("row", F.xxhash64("own", tag, F.lit(seed)).alias("local"), F.xxhash64("own", tag, F.lit(seed + 1)).alias("again"))
    rows = first.count()
    parts = min(MAX_PARTS, max(64, 1 << math.ceil(math.log2(max(rows, 1) / PART_ROWS + 1))))
    held = held.withColumn("part", F.pmod(F.xxhash64("local"), F.lit(parts)).cast("int"))
    counts = [0] * parts
    for p, n in held.groupBy("part").count().collect():  # one row for each of at most MAX_PARTS
        counts[p] = n
    sizes = [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]
    ends = np.cumsum(communication_matrix(counts, sizes, seed), axis=1)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("ends", T.ArrayType(T.LongType()))])
    matrix = df.sparkSession.createDataFrame([(p, [int(x) for x in e]) for p, e in enumerate(ends)], schema)
    rank = F.row_number().over(Window.partitionBy("part").orderBy("local", "again")) - 1
    dealt = (
        held.withColumn("rank", rank)
        .join(F.broadcast(matrix), "part")  # at most MAX_PARTS rows of n_shards numbers
        .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))))
    )
    pieces = max(1, math.ceil(rows / n_shards / PART_ROWS * 4))
    dealt = dealt.select("row", "local", "again", "shard", F.pmod("again", F.lit(pieces)).cast("int").alias("piece"))
    dealt = materialize(dealt, "sharding-dealt")
    before = dealt.groupBy("shard", "piece").count()
    before = before.select("shard", "piece", (F.sum("count").over(Window.partitionBy("shard").orderBy("piece")) - F.col("count")).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("again", "local")) - 1
    placed = dealt.withColumn("within", within).join(before, ["shard", "piece"])
    return placed.select("row.*", "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, n_shards: int = 40, seed: int = 17) -> None:
    """Writes one folder for each shard, its rows in slot order within files; whole rows, all columns."""
    placed = shuffle_into_shards(df, n_shards, seed)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_hypergeometric_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    light = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffle_into_shards(light).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
