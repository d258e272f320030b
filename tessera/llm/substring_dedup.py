"""Removal of long word windows that an earlier document has too, behind a count-min prefilter.

First pass: each partition sketches its windows. A window's cells are chosen by its minimiser (the least hash
of its runs of GRAM words), so equal windows share cells and a document counts once for each minimiser; the
merged sketches therefore overestimate in how many documents a window starts. Cells that two or more
documents reach are kept as bit maps, which is all that is broadcast. The sketch's width follows the bytes of the input up to
MOST_CELLS; a fuller sketch lets more windows through and never loses one. Second pass: the windows whose cells are all repeated, and no
others, are grouped exactly by 96-bit hashes (plus the bits that choose the shard): each shard finds the
smallest doc_id of every window and returns the starts in larger documents. Within a block of documents only
the smallest holder of a window is sent, so a window that very many documents share costs one entry for a block.

Defined cases: null and empty texts have no words; rows with a null doc_id are kept whole and take nothing
from others; rows that share a doc_id don't take from each other; texts of fewer words than a window are kept;
an empty table gives an empty result; other columns are kept, those named n_words or n_removed replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import hashed_words, materialize, mix, powers, scratch, shingles, table, unused

WINDOW, GRAM = 50, 8
#: Rows of the sketch, least and most cells in each (bits once merged), bits of a shard of the bit maps, and bytes of text
#: for each cell: about one distinct minimiser comes on 130 bytes, so a sketch within bounds is an eighth full.
DEPTH, LEAST_CELLS, MOST_CELLS, MAP, CELL_BYTES = 2, 1 << 20, 1 << 29, 1 << 23, 16
#: Windows of a block, and documents of one.
BLOCK_WINDOWS, BLOCK_DOCS = 1_000_000, 30_000
_U = np.uint64


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of so many numbers."""
    span, out = 1, x
    while span < width:
        step = min(span, width - span)
        out = np.minimum(out[:-step], out[step:])
        span += step
    return out


def minimisers(h: np.ndarray, window: int) -> np.ndarray:
    """The least hash of the runs of GRAM words in each window of word hashes."""
    gram = min(GRAM, window)
    return _sliding_min(shingles(h, gram), window - gram + 1)


def window_hashes(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each window."""
    out = []
    for salt in (_U(0), _U(0xD1B54A32D192ED03)):
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(h ^ salt) * powers(len(h)))])
        out.append(mix((sums[window:] - sums[:-window]) * powers(len(h), back=True)[: len(h) - window + 1]))
    return out[0], out[1]


def cells(values: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each minimiser in each row of the sketch."""
    return [mix(values + _U(0x9E3779B97F4A7C15 * (d + 1) % 2**64)) % _U(width) for d in range(DEPTH)]


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("print")).where("doc_id IS NOT NULL")


def sketch_width(docs: DataFrame) -> int:
    """Cells for docs: a power of two between the bounds."""
    held = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << math.ceil(math.log2(held / CELL_BYTES + 1))))


def repeated_cells(docs: DataFrame, window: int, width: int) -> list[np.ndarray]:
    """For each row of the sketch, the bit map of cells that two documents or more reach: width / 8 bytes each."""

    def sketch(batches):
        for b in batches:
            found = []
            for _, h, at in hashed_words(b.column("text")):
                for i in range(len(at) - 1):
                    if at[i + 1] - at[i] >= window:
                        m = minimisers(h[at[i] : at[i + 1]], window)
                        found.append(np.unique(m[np.concatenate([[True], m[1:] != m[:-1]])]))
            if found:
                for d, c in enumerate(cells(np.concatenate(found), width)):
                    cell, n = np.unique(c, return_counts=True)
                    yield pa.RecordBatch.from_pydict({"cell": cell.astype(np.int64) + d * width, "n": n})

    merged = _input(docs).select("text").mapInArrow(sketch, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1")
    part = min(MAP, width)

    def pack(key, t):
        bits = np.zeros(part, bool)
        bits[t["cell"].to_numpy() % part] = True
        return pa.table({"map": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    maps = merged.select(F.expr(f"cast(cell div {part} as int)").alias("map"), "cell").groupBy("map").applyInArrow(pack, "map int, bits binary")
    out = np.zeros((DEPTH * width // part, part // 8), np.uint8)
    for i, bits in maps.collect():  # DEPTH * width / 8 bytes at most
        out[i] = np.frombuffer(bits, np.uint8)
    return list(out.reshape(DEPTH, -1))


def estimated_repeated(m: np.ndarray, maps: list[np.ndarray], width: int) -> np.ndarray:
    """Whether all the cells of each minimiser are repeated."""
    out = np.ones(len(m), bool)
    for c, bits in zip(cells(m, width), maps, strict=True):
        out &= (bits[(c >> _U(3)).astype(np.int64)] >> (c & _U(7)).astype(np.uint8)) & 1 == 1
    return out


def _runs(starts: np.ndarray) -> bytes:
    """Sorted distinct starts as pairs of first start and number."""
    if not len(starts):
        return b""
    new = np.flatnonzero(np.concatenate([[True], np.diff(starts) != 1]))
    return np.stack([starts[new], np.diff(np.concatenate([new, [len(starts)]]))], 1).astype(np.uint32).tobytes()


_ROWS = "shard int, block long, hash binary, check binary, doc binary, start binary, ids binary, prints binary"
_COLUMNS = [x.split()[0] for x in _ROWS.split(", ")]


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _COLUMNS)


def repeated_starts(docs: DataFrame, window: int = WINDOW, width: int | None = None) -> DataFrame:
    """doc_id, print (hash of the text), runs: the window starts of each document that a smaller doc_id has too."""
    spark = docs.sparkSession
    width = width or sketch_width(docs)
    maps = spark.sparkContext.broadcast(repeated_cells(docs, window, width))
    source = _input(docs)
    bits = max(4, math.ceil(math.log2(max(1, source.rdd.getNumPartitions()))) + 2)
    shards = 1 << bits

    def windows(batches):
        ids, prints, found, total, block = [], [], [], 0, TaskContext.get().partitionId() << 32

        def flush():
            key, check, doc, start = (np.concatenate(x) for x in zip(*found, strict=True))
            by_id = np.array(ids, np.int64)
            order = np.lexsort((by_id[doc], check, key))
            key, check, doc, start = key[order], check[order], doc[order], start[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])])
            least = by_id[doc][new][np.cumsum(new) - 1]
            later = by_id[doc] > least
            local = np.stack([doc[later], start[later]], 1).astype(np.uint32)
            key, check, doc, start = key[~later], check[~later], doc[~later], start[~later]
            rows = [(-1 - (block ^ (block >> 32)) % shards, block, None, None, local[:, 0].tobytes(), local[:, 1].tobytes(), by_id.tobytes(), np.array(prints, np.int64).tobytes())]
            cut = np.searchsorted(key >> _U(64 - bits), np.arange(shards + 1, dtype=_U))
            for s in np.flatnonzero(np.diff(cut)):
                a, z = cut[s], cut[s + 1]
                used, place = np.unique(doc[a:z], return_inverse=True)
                rows.append((int(s), block, key[a:z].tobytes(), check[a:z].tobytes(), place.astype(np.uint32).tobytes(), start[a:z].astype(np.uint32).tobytes(), by_id[used].tobytes(), used.astype(np.int64).tobytes()))
            return _emit(rows)

        for b in batches:
            own, own_print = b.column("doc_id").to_numpy(), b.column("print").to_numpy()
            for first, h, at in hashed_words(b.column("text")):
                for i in range(len(at) - 1):
                    if at[i + 1] - at[i] < window:
                        continue
                    w = h[at[i] : at[i + 1]]
                    hit = np.flatnonzero(estimated_repeated(minimisers(w, window), maps.value, width))
                    if len(hit):
                        one, two = window_hashes(w, window)
                        found.append((one[hit], (two[hit] & _U(0xFFFFFFFF)).astype(np.uint32), np.full(len(hit), len(ids)), hit))
                        ids.append(int(own[first + i]))
                        prints.append(int(own_print[first + i]))
                        total += len(hit)
                        if total >= BLOCK_WINDOWS or len(ids) >= BLOCK_DOCS:
                            yield flush()
                            ids, prints, found, total, block = [], [], [], 0, block + 1
        if found:
            yield flush()

    def least(key, t):
        if key[0].as_py() < 0:  # what blocks keep for themselves passes
            return t.select(_COLUMNS)
        parts = [[np.frombuffer(x, kind) for x in t[c].to_pylist()] for c, kind in (("hash", _U), ("check", np.uint32), ("doc", np.uint32), ("start", np.uint32), ("ids", np.int64), ("prints", np.int64))]
        sizes = [len(x) for x in parts[0]]
        hashes, check = np.concatenate(parts[0]), np.concatenate(parts[1])
        ids = np.concatenate([own[place] for own, place in zip(parts[4], parts[2], strict=True)])
        order = np.lexsort((ids, check, hashes))
        new = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (check[order][1:] != check[order][:-1])])
        smallest = np.empty(len(ids), np.int64)
        smallest[order] = ids[order][new][np.cumsum(new) - 1]
        later, rows, a = ids > smallest, [], 0
        for block, n, place, start, used in zip(t["block"].to_pylist(), sizes, parts[2], parts[3], parts[5], strict=True):
            gone = later[a : a + n]
            a += n
            if gone.any():
                rows.append((key[0].as_py(), block, None, None, used[place[gone]].astype(np.uint32).tobytes(), start[gone].tobytes(), None, None))
        return pa.Table.from_batches([_emit(rows)]) if rows else t.select(_COLUMNS).slice(0, 0)

    out_kinds = pa.schema([("doc_id", pa.int64()), ("print", pa.int64()), ("runs", pa.binary())])

    def gather(key, t):
        own = next(i for i, x in enumerate(t["ids"].to_pylist()) if x is not None)
        ids, prints = (np.frombuffer(t[c][own].as_py(), np.int64) for c in ("ids", "prints"))
        doc = np.concatenate([np.frombuffer(x, np.uint32) for x in t["doc"].to_pylist()]).astype(np.int64)
        start = np.concatenate([np.frombuffer(x, np.uint32) for x in t["start"].to_pylist()]).astype(np.int64)
        order = np.lexsort((start, doc))
        cut = np.searchsorted(doc[order], np.arange(len(ids) + 1))
        runs = [_runs(start[order[a:z]]) for a, z in zip(cut[:-1], cut[1:], strict=True)]
        keep = [i for i, r in enumerate(runs) if r]
        return pa.table([pa.array(ids[keep]), pa.array(prints[keep]), pa.array([runs[i] for i in keep], pa.binary())], schema=out_kinds)

    sent = source.mapInArrow(windows, _ROWS)
    return sent.groupBy("shard").applyInArrow(least, _ROWS).groupBy("block").applyInArrow(gather, "doc_id long, print long, runs binary")


def dedup_windows(docs: DataFrame, window: int = WINDOW, width: int | None = None) -> DataFrame:
    """docs, all columns, with text cut to its kept words joined by single spaces, and n_words (before) and n_removed."""
    docs = docs.drop("n_words", "n_removed")
    names, (doc, print_, runs_) = docs.columns, unused(docs, "_doc", "_print", "_runs")
    with scratch() as keep:
        gone = keep(materialize(repeated_starts(docs, window, width), "repeated-windows")).toDF(doc, print_, runs_)
    # A repeated row may have brought the same runs twice.
    gone = gone.groupBy(doc, print_).agg(F.max(runs_).alias(runs_))
    same = (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(print_))
    joined = docs.join(gone.hint("shuffle_hash"), same, "left").select(*[F.col("text").cast("binary").alias("text") if c == "text" else f"`{c}`" for c in names], runs_)

    def cut(batches):
        for b in batches:
            texts, words, removed = b.column("text").to_pylist(), [], []
            for i, runs in enumerate(b.column(runs_).to_pylist()):
                w = (texts[i] or b"").split()
                words.append(len(w))
                if runs:
                    edge = np.zeros(len(w) + 1, np.int64)
                    pairs = np.frombuffer(runs, np.uint32).reshape(-1, 2).astype(np.int64)
                    np.add.at(edge, pairs[:, 0], 1)
                    np.add.at(edge, pairs[:, 0] + pairs[:, 1] + window - 1, -1)
                    kept = np.cumsum(edge[:-1]) == 0
                    removed.append(int(len(w) - kept.sum()))
                    w = [x for x, k in zip(w, kept.tolist(), strict=True) if k]
                else:
                    removed.append(0)
                texts[i] = b" ".join(w)
            cols = [pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(words, pa.int64()), pa.array(removed, pa.int64())], [*names, "n_words", "n_removed"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.mapInArrow(cut, schema)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    kept = dedup_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT k, min(doc_id) AS first FROM s GROUP BY k),
g AS (SELECT DISTINCT doc_id, i + o AS p FROM (SELECT s.doc_id, s.i, unnest(range(0, 50)) AS o FROM s JOIN f ON s.k = f.k WHERE f.first < s.doc_id)),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT p.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY p.p) FILTER (g.p IS NULL) AS kept FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.p = g.p GROUP BY p.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
