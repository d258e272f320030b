"""Benchmark items inside documents: size-partitioned MinHash containment search, verified exactly.

An item's shingles are ranked by a hash (its MinHash order). Items are partitioned by size, and each partition
asks for `hits` of an item's k = floor(n / 4) + hits smallest hashes: a document that holds three quarters of
the n shingles lacks at most floor(n / 4) of them, so none is lost however long the document is. Documents
with hits enough are verified by exact containment of shingle strings. DataFrame functions only.

Words are the runs of characters other than x20 and x09-x0D of the lower-cased text; shingles are five
consecutive words, or all the words of an item that has fewer.

Defined cases: null and empty texts hold nothing and are found nowhere; rows that share a doc_id (or have
none) count as one document, its best row; items that repeat are each found; empty tables give empty results; other columns are ignored by find_items and kept by decontaminate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, scratch, table, unused

WIDTH = 5
SPACE = "[\\x20\\x09-\\x0D]+"
#: Rows of two numbers up to which candidate pairs are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    """The words of the text, none if it is null or blank."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")


def runs(w: Column, width: int) -> Column:
    """First positions (from 1) of each run of so many words."""
    return F.when(F.size(w) >= width, F.sequence(F.lit(1), F.size(w) - (width - 1))).otherwise(F.array().cast("array<int>"))


def hashes(w: Column, width: int) -> Column:
    # Words are got one by one: slice() would copy the whole array for each shingle.
    return F.transform(runs(w, width), lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(width)], F.lit(width)))


def strings(w: Column, width: Column | int) -> Column:
    one = lambda k: F.transform(runs(w, k), lambda i: F.concat_ws(" ", *[F.get(w, i + (j - 1)) for j in range(k)]))
    if isinstance(width, int):
        return F.array_distinct(one(width))
    out = F.array().cast("array<string>")
    for k in range(1, WIDTH + 1):
        out = F.when(width == k, one(k)).otherwise(out)
    return F.array_distinct(out)


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, width, shingles (distinct strings), n, hits of the size partition, k."""
    w = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w"))
    w = w.where(F.size("w") > 0).withColumn("width", F.least(F.size("w"), F.lit(WIDTH)))
    sized = w.select("item_id", "width", strings(F.col("w"), F.col("width")).alias("shingles")).withColumn("n", F.size("shingles"))
    # Partition p holds sizes 2^p to 2^(p+1) - 1 and asks for an eighth of its least size.
    least = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n").cast("double")))).cast("int")
    sized = sized.withColumn("hits", F.greatest(F.lit(1), F.floor(least / 8)).cast("int"))
    return sized.withColumn("k", F.floor(F.col("n") / 4).cast("int") + F.col("hits")).withColumn("_item", F.monotonically_increasing_id())


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shingles, n_common, containment of each pair with containment of 3/4 or more."""
    known = materialize(items(benchmark), "benchmark-items")
    widths = sorted(r[0] for r in known.select("width").distinct().collect())  # at most WIDTH numbers
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    exploded = known.select("_item", "width", "hits", "k", F.explode("shingles").alias("s"))
    hashed = exploded.withColumn("h", F.coalesce(*[F.when(F.col("width") == k, F.xxhash64(*[F.get(F.split("s", " "), F.lit(j)) for j in range(k)], F.lit(k))) for k in range(1, WIDTH + 1)]))
    order = Window.partitionBy("_item").orderBy(F.xxhash64("h", F.lit(11)), "h")
    signature = hashed.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= F.col("k")).select("_item", "h", "hits")
    if not widths:
        widths = [WIDTH]
    each = text.select("doc_id", words(F.col("text")).alias("w"))
    each = each.select("doc_id", F.explode(F.array_distinct(F.concat(*[hashes(F.col("w"), k) for k in widths]))).alias("h"))
    found = each.join(signature, "h").groupBy("doc_id", "_item").agg(F.countDistinct("h").alias("n"), F.first("hits").alias("hits"))
    pairs = materialize(found.where("n >= hits").select("doc_id", "_item"), "benchmark-pairs")
    few = pairs.count() <= BROADCAST_ROWS
    same = pairs.withColumnRenamed("doc_id", "_doc")
    joined = text.join(F.broadcast(same) if few else same, F.col("doc_id").eqNullSafe(F.col("_doc")))
    joined = joined.join(known.select("_item", "item_id", "width", "shingles"), "_item")
    # The words are a column of their own, so that they are made once for each row and not for each shingle.
    joined = joined.select("doc_id", "_item", "item_id", "width", "shingles", words(F.col("text")).alias("w"))
    common = F.size(F.array_intersect("shingles", strings(F.col("w"), F.col("width"))))
    held = joined.select("doc_id", "_item", "item_id", F.size("shingles").cast("long").alias("n_shingles"), common.cast("long").alias("n_common"))
    # A filter right above would be pushed below and make the words once for each shingle again.
    held = materialize(held, "benchmark-verified")
    best = held.where(4 * F.col("n_common") >= 3 * F.col("n_shingles")).groupBy("doc_id", "_item", "item_id", "n_shingles").agg(F.max("n_common").alias("n_common"))
    return best.select("doc_id", "item_id", "n_shingles", "n_common", (F.col("n_common") / F.col("n_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no item."""
    (own,) = unused(docs, "_hit")
    with scratch() as keep:
        hit = keep(materialize(find_items(docs, benchmark).select(F.col("doc_id").alias(own)).distinct(), "benchmark-hits"))
    few = hit.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(hit) if few else hit, F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left_anti")


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT least(len(w), 5) AS k FROM iw WHERE len(w) > 0))),
its AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (
  SELECT item_id, w, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM iw WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n FROM its GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS c FROM ds JOIN its USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS n_shingles, c AS n_common, c / n::DOUBLE AS containment FROM c JOIN n USING (item_id) WHERE 4 * c >= 3 * n
"""
