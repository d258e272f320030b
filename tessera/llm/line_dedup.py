"""Removal of lines that many documents repeat, by a sharded minimal perfect hash.

Line keys (stripped of x20 and x09-x0D at both ends, A-Z lower-cased, of min_chars code points at least)
are hashed to 128 bits. Pairs of hash and doc_id are made distinct, then counts of documents and the largest doc_id
are summed up for each distinct hash; the hashes that min_docs documents hold are split into shards, and each shard becomes a minimal perfect hash with
arrays of 64-bit fingerprints, counts and last documents. Rarer lines can lose nothing and stay out of the
index: a fingerprint turns them away. Documents probe the arrays in one pass, so lines are never joined. An index of up to
WAVE_BYTES is broadcast; a larger one stays in the shared folder, where a task loads its shards in turn, one at a time, for
all lines of each HELD_BYTES of text.

Defined cases: a null or empty text is one empty line; rows that share a doc_id count as one document, and all rows
with the largest doc_id keep the line; rows with a null doc_id are each a document of its own, smaller than any other; lines are looked at
however long they are; an empty table gives an empty result; other columns are kept, those named n_lines or
n_dropped replaced.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import code_points, materialize, mix, scratch, table, unused

SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of index that are broadcast, of text that a task holds while it loads the shards in turn, lines of a shard,
#: bits for each line on a level.
WAVE_BYTES, HELD_BYTES, SHARD_LINES, GAMMA = 32 << 20, 64 << 20, 100_000, 2
_ENTRY = 8 + 4 + 8 + 1
_NONE = -(2**63)
_U = np.uint64


def line_keys(text: bytes, min_chars: int) -> list[tuple[int, bytes]]:
    """(line number, 16-byte hash) of the lines whose keys are long enough."""
    out = []
    for i, line in enumerate(text.split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip(SPACE).lower()
            if len(key) >= min_chars and (len(key) >= 4 * min_chars or code_points(key) >= min_chars):
                out.append((i, xxhash.xxh3_128_digest(key)))
    return out


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: bit levels, each for the keys that collided before."""

    def __init__(self, sizes: list[int], bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
        self.n = int(self.ranks[-1]) + len(rest)

    @staticmethod
    def at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + _U((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % _U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words, left = [], [], keys
        for level in range(64):
            if not len(left):
                break
            size = (GAMMA * len(left) + 63) // 64 * 64
            where = cls.at(left, level, size)
            alone = np.bincount(where, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(_U))
            sizes.append(size)
            left = left[~alone[where]]
        return cls(sizes, np.concatenate(words) if words else np.zeros(0, _U), np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, 0 to n - 1; any slot, or -1, for keys that were not in build()."""
        out, open_, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            where = start + self.at(keys[open_], level, size)
            word, bit = where >> 6, (where & 63).astype(_U)
            hit = (self.bits[word] >> bit) & _U(1) == 1
            w, b = word[hit], bit[hit]
            out[open_[hit]] = self.ranks[w] + np.bitwise_count(self.bits[w] & ((_U(1) << b) - _U(1)))
            open_, start = open_[~hit], start + size
        if len(self.rest) and len(open_):
            i = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            found = self.rest[i] == keys[open_]
            out[open_[found]] = int(self.ranks[-1]) + i[found]
        return out


_SHARD = "shard int, sizes array<long>, bits binary, rest binary, fingerprints binary, counts binary, last binary"


def count_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """h1, h2, n, last: the hashes that at least min_docs documents hold."""

    def count(batches):
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            keys, ids, apart = [], [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = {k for _, k in line_keys(text, min_chars)}
                keys += own
                ids += [_NONE if doc is None else doc] * len(own)
                row += 1
                apart += [row if doc is None else 0] * len(own)  # tells documents without an id from each other
            h = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"h1": h[:, 0], "h2": h[:, 1], "doc": pa.array(ids, pa.int64()), "apart": pa.array(apart, pa.int64())})

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    held = cols.mapInArrow(count, "h1 long, h2 long, doc long, apart long").distinct()
    return held.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("last")).where(F.col("n") >= min_docs)


def build_index(lines: DataFrame, shards: int) -> DataFrame:
    """A row for each shard: the perfect hash and its arrays."""

    def build(key, t):
        h1, h2 = t["h1"].to_numpy().view(_U), t["h2"].to_numpy().view(_U)
        keys = mix(h1 ^ (h2 << _U(1)))
        f = PerfectHash.build(keys)
        slot = f.slots(keys)
        prints, counts, last = np.zeros(f.n, _U), np.zeros(f.n, np.uint32), np.zeros(f.n, np.int64)
        prints[slot], counts[slot], last[slot] = h2, np.minimum(t["n"].to_numpy(), 2**32 - 1), t["last"].to_numpy()
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "sizes": pa.array([f.sizes], pa.list_(pa.int64())), "bits": [f.bits.tobytes()], "rest": [f.rest.tobytes()], "fingerprints": [prints.tobytes()], "counts": [counts.tobytes()], "last": [last.tobytes()]})

    dealt = lines.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(build, _SHARD)


class Shard:
    """The perfect hash and the arrays of one row of the index."""

    def __init__(self, r: dict):
        self.shard = r["shard"]
        self.hash = PerfectHash(list(r["sizes"]), np.frombuffer(r["bits"], _U), np.frombuffer(r["rest"], _U))
        self.prints, self.counts, self.last = np.frombuffer(r["fingerprints"], _U), np.frombuffer(r["counts"], np.uint32), np.frombuffer(r["last"], np.int64)


def read_shards(files: list[str]):
    """The shards that files of the shared folder hold, one at a time."""
    for uri in files:
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        with fs.open_input_file(path) as f:
            for b in pq.ParquetFile(f, buffer_size=1 << 20, pre_buffer=False).iter_batches(batch_size=1):
                yield from map(Shard, b.to_pylist())


def dropped(index, shards: int, h1: np.ndarray, h2: np.ndarray, docs: np.ndarray, min_docs: int) -> np.ndarray:
    """Whether each line goes: its fingerprint is indexed, often enough, and another document is the last."""
    out = np.zeros(len(h1), bool)
    shard = h1.view(np.int64) % shards
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in index:
        at = order[bounds[s.shard] : bounds[s.shard + 1]]
        slot = s.hash.slots(mix(h1[at] ^ (h2[at] << _U(1))))
        at, slot = at[slot >= 0], slot[slot >= 0]
        out[at] = (s.prints[slot] == h2[at]) & (s.counts[slot] >= min_docs) & (s.last[slot] != docs[at])
    return out


def in_groups(batches, most: int):
    """Lists of consecutive batches, each ended by the batch with which it reaches so many bytes."""
    group, size = [], 0
    for b in batches:
        group.append(b)
        size += b.nbytes
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, wave_bytes: int = WAVE_BYTES, shard_lines: int = SHARD_LINES, held_bytes: int = HELD_BYTES) -> DataFrame:
    """docs with the repeated lines taken out of text, and n_lines (before) and n_dropped."""
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    (id_,) = unused(docs, "_id")
    with scratch() as keep:
        lines = materialize(count_lines(docs, min_chars, min_docs), "line-counts")
        n = lines.count()
        shards = max(1, -(-n // shard_lines))
        index = materialize(build_index(lines, shards), "line-index")
        few = n * _ENTRY <= wave_bytes
        held = spark.sparkContext.broadcast([r.asDict() for r in index.collect()]) if few else None  # at most wave_bytes
        files = [] if few else [re.sub("^file:/+", "file:///", f) for f in keep(index).inputFiles()]
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches):
        index = [Shard(r) for r in held.value] if few else None
        for group in in_groups(batches, 0 if few else held_bytes):
            ids, keys, rows, at = [], [], array("q"), array("q")  # a line's row is its document's place in the group
            for b in group:
                for doc, text in zip(b.column(id_).to_pylist(), b.column("text"), strict=True):
                    for line, key in line_keys(text.as_py(), min_chars) if text.is_valid else ():
                        keys.append(key)
                        rows.append(len(ids))
                        at.append(line)
                    ids.append(_NONE if doc is None else doc)
            gone: dict[int, set[int]] = {}
            if keys:
                h = np.frombuffer(b"".join(keys), _U).reshape(-1, 2)
                own = np.array(ids, np.int64)[np.frombuffer(rows, np.int64)]
                for i in np.flatnonzero(dropped(index if few else read_shards(files), shards, h[:, 0].copy(), h[:, 1].copy(), own, min_docs)):
                    gone.setdefault(rows[i], set()).add(at[i])
            row = 0
            for b in group:
                texts, total, lost = b.column("text").to_pylist(), [], []
                for k, text in enumerate(texts):
                    drop = gone.get(row, ())
                    total.append(1 + (text or b"").count(b"\n"))
                    lost.append(len(drop))
                    if drop:
                        texts[k] = b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in drop)
                    row += 1
                cols = {c: b.column(c) for c in names} | {"text": pa.array(texts, pa.binary()).cast(pa.string())}
                yield pa.RecordBatch.from_pydict(cols | {"n_lines": pa.array(total, pa.int64()), "n_dropped": pa.array(lost, pa.int64())})

    return docs.withColumn("text", F.col("text").cast("binary")).withColumn(id_, F.col("doc_id").cast("long")).mapInArrow(run, schema)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT d.doc_id, u.i, u.line, lower_ascii AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
  LATERAL (SELECT unnest(d.ls) AS line, generate_subscripts(d.ls, 1) AS i) u,
  LATERAL (SELECT translate(regexp_replace(regexp_replace(u.line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii)
), h AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, h.k IS NOT NULL AND l.doc_id <> h.last AS gone FROM l LEFT JOIN h ON l.k = h.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
