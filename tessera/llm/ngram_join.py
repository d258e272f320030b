"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact sorted-array intersection.

A document's set is its distinct shingles of five words, kept as sorted 64-bit hashes. Two sets link when
100 * intersection >= 75 * union. Every step below is lossless:

1. Filter. A set that links lacks at most a quarter of its shingles elsewhere. Half of the hash space is
   exchanged as 32-bit cells to shards, which find the cells that two sets share; a set that lacks more of
   its cells than a quarter of its size goes. Within a block of documents a shared shingle is sent once.
2. Equal sets become one class with a representative, the smallest doc_id.
3. Candidates. Shingles of the representatives are counted exactly; ordered from the rarest, two linked sets
   share one of their first floor(n / 4) + 1. Sets that share such a shingle form clusters. A block of sets sends one
   of them for each shingle and ties the others to it, so a very common shingle costs one entry for a block.
4. Tiles. Clusters of up to TILE sets and WORDS shingles are one tile each, BIN or so sets of them to a group. Larger
   ones are split by size band (a factor 4/3, so that only equal and adjacent bands can link) into blocks of that
   many sets and shingles, and every pair of blocks of equal and adjacent bands is a tile.
5. In a tile, hashed bitmaps bound the overlap from above by bit counts; all pairs within the bound are intersected
   exactly. Links are counted (n_links), a class's weighted by the copies of the other one, and those that connect what
   was not connected within the tile are kept.
   Where links need not be counted (keep_one), a cluster of several tiles is first held against its own
   representative: sets that link to it are connected already, and are not held against each other.
6. Components of the links give the smallest doc_id that each document reaches.

Defined cases: a document without words has an empty set and links with nothing; a document of fewer than five
words has its whole sequence as its only shingle; a null doc_id gives a null component and no link; rows
that share a doc_id are one document, which reaches what any of its rows links with, though n_links counts rows (those of the
same doc_id too); an empty table gives an empty result; other columns are kept by keep_one and ignored otherwise.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hashed_words, materialize, mix, scratch, shingles, table, unused
from tessera.llm.components import components

WIDTH = 5
#: Shingles of a block, sets and shingles of a tile's side, and sets of small clusters that one task takes together.
BLOCK, TILE, WORDS, BIN = 1_000_000, 256, 1 << 20, 128
_U = np.uint64
_SALT = _U(0xA0761D6478BD642F)


def linked(common: int, a: int, b: int) -> bool:
    """100 * common >= 75 * (a + b - common)."""
    return 7 * common >= 3 * (a + b)


def set_of(h: np.ndarray) -> np.ndarray:
    """The sorted distinct shingle hashes of a document's word hashes."""
    return np.unique(shingles(h, WIDTH))


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    return int(mix(s).sum(dtype=_U).view(np.int64)), int(mix(s ^ _SALT).sum(dtype=_U).view(np.int64))


def _schema(spec: str) -> tuple[str, list[str], pa.Schema]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    pairs = [x.split() for x in spec.split(", ")]
    return spec, [k for k, _ in pairs], pa.schema([(k, kinds[v]) for k, v in pairs])


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array([r.get(f.name) for r in rows], f.type) for f in schema}, schema=schema)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _lists(t: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", kind) for x in t[name].to_pylist()]


def _join(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _shard_bits(df: DataFrame) -> int:
    """About four shards for each input partition."""
    return max(4, math.ceil(math.log2(max(1, df.rdd.getNumPartitions()))) + 2)


_SENT = _schema("shard int, block long, cells binary, doc binary, again binary, ids binary, sizes binary, shared binary, sent binary, high binary, low binary")
_MEMBERS = _schema("doc_id long, n long, high long, low long, survives boolean")


def members(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), its key, and whether enough of its shingles are shared to link at all."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).where("doc_id IS NOT NULL")
    bits = _shard_bits(source)
    shards = 1 << bits

    def send(batches):
        ids, sizes, keys, tokens, owners, total, block = [], [], [], [], [], 0, TaskContext.get().partitionId() << 32

        def flush():
            n = len(ids)
            tok, doc = _join(tokens, _U), np.repeat(np.arange(n), owners)
            order = np.argsort(tok)
            tok, doc = tok[order], doc[order]
            new = np.concatenate([[True], tok[1:] != tok[:-1]]) if len(tok) else np.zeros(0, bool)
            count = np.diff(np.concatenate([np.flatnonzero(new), [len(tok)]]))
            several = np.repeat(count > 1, count)
            again, single, single_doc = tok[new][count > 1], tok[~several], doc[~several].astype(np.uint32)
            high, low = np.array(keys, np.int64).reshape(-1, 2).T
            rows = [{"shard": -1 - (block ^ (block >> 32)) % shards, "block": block, "ids": np.array(ids, np.int64).tobytes(), "sizes": np.array(sizes, np.int64).tobytes(), "shared": np.bincount(doc[several], minlength=n).tobytes(), "sent": np.array(owners, np.int64).tobytes(), "high": high.tobytes(), "low": low.tobytes()}]
            edges = np.arange(shards + 1, dtype=_U)
            cut, cut_again = np.searchsorted(single >> _U(64 - bits), edges), np.searchsorted(again >> _U(64 - bits), edges)
            cell = lambda x: ((x >> _U(32 - bits)) & _U(0xFFFFFFFF)).astype(np.uint32)
            for s in np.flatnonzero(np.diff(cut) + np.diff(cut_again)):
                a, z = cut[s], cut[s + 1]
                rows.append({"shard": int(s), "block": block, "cells": cell(single[a:z]).tobytes(), "doc": single_doc[a:z].tobytes(), "again": cell(again[cut_again[s] : cut_again[s + 1]]).tobytes()})
            return _batch(rows, _SENT[2])

        for b in batches:
            own = b.column("doc_id").to_numpy()
            for first, h, at in hashed_words(b.column("text"), fold=True):
                for i in range(len(at) - 1):
                    s = set_of(h[at[i] : at[i + 1]])
                    half = s[(s & _U(1)) == 0]
                    ids.append(int(own[first + i]))
                    sizes.append(len(s))
                    keys.append(set_key(s))
                    tokens.append(half)
                    owners.append(len(half))
                    total += len(half) + 8
                    if total >= BLOCK:
                        yield flush()
                        ids, sizes, keys, tokens, owners, total, block = [], [], [], [], [], 0, block + 1
        if ids:
            yield flush()

    def count(key, t):
        if key[0].as_py() < 0:  # what blocks keep for themselves passes
            return t.select(_SENT[1])
        cells, docs_, again = _lists(t, "cells", np.uint32), _lists(t, "doc", np.uint32), _join(_lists(t, "again", np.uint32), np.uint32)
        every = np.sort(np.concatenate([*cells, again, again]))
        several = np.unique(every[1:][every[1:] == every[:-1]])
        rows = []
        if len(several):
            for block, c, d in zip(t["block"].to_pylist(), cells, docs_, strict=True):
                hit = several[np.minimum(np.searchsorted(several, c), len(several) - 1)] == c
                if hit.any():
                    doc, n = np.unique(d[hit], return_counts=True)
                    rows.append({"shard": 0, "block": block, "doc": doc.tobytes(), "cells": n.astype(np.uint32).tobytes()})
        return _table(rows, _SENT[2])

    def decide(key, t):
        own = next(i for i, x in enumerate(t["ids"].to_pylist()) if x is not None)
        ids, sizes, shared, sent, high, low = (np.frombuffer(t[c][own].as_py(), np.int64) for c in ("ids", "sizes", "shared", "sent", "high", "low"))
        shared = shared.copy()
        for doc, n in zip(_lists(t, "doc", np.uint32), _lists(t, "cells", np.uint32), strict=True):
            np.add.at(shared, doc, n)
        return pa.table({"doc_id": ids, "n": sizes, "high": high, "low": low, "survives": (sizes > 0) & (sent - shared <= sizes // 4)}, schema=_MEMBERS[2])

    found = source.mapInArrow(send, _SENT[0]).groupBy("shard").applyInArrow(count, _SENT[0])
    return found.groupBy("block").applyInArrow(decide, _MEMBERS[0])


_BLOCKS = _schema("block long, reps binary, sizes binary, tokens binary, shard int, classes binary")
_COUNTS = _schema("shard int, block long, tokens binary, counts binary")
_POSTS = _schema("shard int, tokens binary, reps binary, u binary, v binary")
_SETS = _schema("rep long, n long, tokens binary")


def set_blocks(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The sets of the representatives, many to a row."""
    wanted = classes.select(F.col("rep").alias("_rep"), "high", "low").hint("shuffle_hash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    joined = texts.join(wanted, F.col("doc_id") == F.col("_rep"))

    def build(batches):
        reps, sizes, sets, total, block = [], [], [], 0, TaskContext.get().partitionId() << 32

        def flush():
            return _batch([{"block": block, "reps": np.array(reps, np.int64).tobytes(), "sizes": np.array(sizes, np.int64).tobytes(), "tokens": _join(sets, _U).tobytes()}], _BLOCKS[2])

        for b in batches:
            own, high, low = (b.column(c).to_numpy() for c in ("doc_id", "high", "low"))
            for first, h, at in hashed_words(b.column("text"), fold=True):
                for i in range(len(at) - 1):
                    s = set_of(h[at[i] : at[i + 1]])
                    if set_key(s) == (high[first + i], low[first + i]):
                        reps.append(int(own[first + i]))
                        sizes.append(len(s))
                        sets.append(s)
                        total += len(s)
                        if total >= BLOCK // 2:
                            yield flush()
                            reps, sizes, sets, total, block = [], [], [], 0, block + 1
        if reps:
            yield flush()

    return joined.mapInArrow(build, _BLOCKS[0])


def _sets(reps: bytes, sizes: bytes, tokens: bytes):
    ids, n, tok = np.frombuffer(reps, np.int64), np.frombuffer(sizes, np.int64), np.frombuffer(tokens, _U)
    ends = np.cumsum(n)
    return ids, n, tok, ends


def candidate_edges(blocks: DataFrame) -> DataFrame:
    """u, v: star edges among the representatives that share one of their rarest floor(n / 4) + 1 shingles."""
    bits = _shard_bits(blocks)
    shards = 1 << bits

    def split(tok: np.ndarray) -> np.ndarray:
        return np.searchsorted(tok >> _U(64 - bits), np.arange(shards + 1, dtype=_U))

    def send(batches):
        for b in batches:
            for row in b.to_pylist():
                tok, n = np.unique(np.frombuffer(row["tokens"], _U), return_counts=True)
                cut = split(tok)
                yield _batch([{"shard": int(s), "block": row["block"], "tokens": tok[cut[s] : cut[s + 1]].tobytes(), "counts": n[cut[s] : cut[s + 1]].astype(np.uint32).tobytes()} for s in np.flatnonzero(np.diff(cut))], _COUNTS[2])

    def count(key, t):
        parts = _lists(t, "tokens", _U)
        tok, n = np.concatenate(parts), _join(_lists(t, "counts", np.uint32), np.uint32).astype(np.int64)
        order = np.argsort(tok)
        new = np.concatenate([[True], tok[order][1:] != tok[order][:-1]])
        total = np.add.reduceat(n[order], np.flatnonzero(new))
        kind = np.empty(len(tok), np.uint8)
        kind[order] = np.floor(np.log2(total)).astype(np.uint8)[np.cumsum(new) - 1]
        ends = np.cumsum([len(x) for x in parts])
        return _table([{"block": block, "shard": key[0].as_py(), "classes": kind[z - len(x) : z].tobytes()} for block, x, z in zip(t["block"].to_pylist(), parts, ends, strict=True)], _BLOCKS[2])

    def prefixes(key, t):
        rows = t.to_pylist()
        own = next(r for r in rows if r["reps"] is not None)
        ids, n, tok, ends = _sets(own["reps"], own["sizes"], own["tokens"])
        known, back = np.unique(tok, return_inverse=True)
        kind, cut = np.zeros(len(known), np.uint8), split(known)
        for r in rows:
            if r["classes"] is not None:
                kind[cut[r["shard"]] : cut[r["shard"] + 1]] = np.frombuffer(r["classes"], np.uint8)
        kind, out_tok, out_rep = kind[back], [], []
        for rep, size, z in zip(ids, n, ends, strict=True):
            own_tok, own_kind = tok[z - size : z], kind[z - size : z]
            first = np.argsort(own_kind, kind="stable")[: size // 4 + 1]
            first = first[own_kind[first] > 0]  # a shingle of one set only makes no candidate
            out_tok.append(own_tok[first])
            out_rep.append(np.full(len(first), rep))
        tok, least, pairs = tied(_join(out_tok, _U), _join(out_rep, np.int64))
        cut = split(tok)
        found = [{"shard": int(s), "tokens": tok[cut[s] : cut[s + 1]].tobytes(), "reps": least[cut[s] : cut[s + 1]].tobytes()} for s in np.flatnonzero(np.diff(cut))]
        block = own["block"]
        own = [{"shard": -1 - (block ^ (block >> 32)) % shards, "u": pairs[:, 0].tobytes(), "v": pairs[:, 1].tobytes()}] if len(pairs) else []
        return _table(found + own, _POSTS[2])

    def tied(tok, rep):
        """Distinct shingles in order, the least set that each stands in, and pairs that tie the others to it."""
        order = np.lexsort((rep, tok))
        tok, rep = tok[order], rep[order]
        new = np.concatenate([[True], tok[1:] != tok[:-1]]) if len(tok) else np.zeros(0, bool)
        least = rep[new][np.cumsum(new) - 1]
        return tok[new], rep[new], np.unique(np.stack([rep, least], 1)[rep != least], axis=0)

    def stars(key, t):
        if key[0].as_py() < 0:  # what blocks tied themselves passes
            pairs = np.stack([_join(_lists(t, "u", np.int64), np.int64), _join(_lists(t, "v", np.int64), np.int64)], 1)
        else:
            pairs = tied(_join(_lists(t, "tokens", _U), _U), _join(_lists(t, "reps", np.int64), np.int64))[2]
        return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})

    counted = blocks.mapInArrow(send, _COUNTS[0]).groupBy("shard").applyInArrow(count, _BLOCKS[0])
    posts = blocks.union(counted).groupBy("block").applyInArrow(prefixes, _POSTS[0])
    return posts.groupBy("shard").applyInArrow(stars, "u long, v long").distinct()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct numbers."""
    if len(a) < len(b):
        a, b = b, a
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())


class Tile:
    """The sets of a tile with their bitmap signatures."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets], np.int64)
        self.ends = np.cumsum(self.n)
        bits = min(8192, max(256, 1 << math.ceil(math.log2(4 * max(self.n)))))
        marks = np.zeros((len(sets), bits), bool)
        marks[np.repeat(np.arange(len(sets)), self.n), (mix(np.concatenate(sets) + _SALT) % _U(bits)).astype(np.int64)] = True
        self.bitmaps = np.packbits(marks, axis=1).view(_U)
        self.spare = self.n - np.bitwise_count(self.bitmaps).sum(1, dtype=np.int64)
        self.root = list(range(len(sets)))
        # The sorted arrays once more, with a shingle's rank among the tile's in its place.
        known, self.ranks = np.unique(np.concatenate(sets), return_inverse=True)
        self.held = np.zeros(len(known), bool)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = i = self.root[self.root[i]]
        return i

    def bound(self, i: int, js: np.ndarray) -> np.ndarray:
        """No less than the overlaps: each bit that one bitmap has alone stands for a shingle that the other set lacks."""
        both = np.bitwise_count(self.bitmaps[i] & self.bitmaps[js]).sum(1, dtype=np.int64)
        return np.minimum(self.spare[i], self.spare[js]) + both

    def overlaps(self, i: int, js: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of the sorted array i with each of the others."""
        own = self.ranks[self.ends[i] - self.n[i] : self.ends[i]]
        self.held[own] = True
        sizes = self.n[js]
        first = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(self.ends[js] - sizes - first, sizes)
        out = np.add.reduceat(self.held[self.ranks[at]], first, dtype=np.int64) if len(js) else sizes
        self.held[own] = False
        return out

    def links(self, left: np.ndarray, right: np.ndarray, others: np.ndarray | None = None, copies: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links between the two sides (or within one, given twice) that connect what was not connected.

        With others every pair within the bound is verified, and the copies of each set's partners are added to it."""
        out, same = [], left is right
        right = right[np.argsort(self.n[right], kind="stable")]
        sizes = self.n[right]
        for i in left.tolist():
            n = int(self.n[i])
            js = right[np.searchsorted(sizes, (3 * n + 3) // 4) : np.searchsorted(sizes, 4 * n // 3, side="right")]
            js = js[js > i] if same else js
            js = js[7 * self.bound(i, js) >= 3 * (n + self.n[js])]
            if others is None:
                js = js[np.array([self.find(i) != self.find(j) for j in js.tolist()], bool)]
            js = js[7 * self.overlaps(i, js) >= 3 * (n + self.n[js])]
            if others is not None:
                others[i] += copies[js].sum()
                others[js] += copies[i]
            for j in js.tolist():
                a, b = self.find(i), self.find(j)
                if a != b:
                    self.root[b] = a
                    out.append((i, j))
        return out


def _edges(t: pa.Table, rows: np.ndarray, left: np.ndarray | None = None, right: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links among the given rows; left and right: positions within rows."""
    reps, tokens = t["rep"].to_numpy(), t["tokens"]
    tile = Tile([np.frombuffer(tokens[int(i)].as_py(), _U) for i in rows])
    left = np.arange(len(rows)) if left is None else left
    return [(int(reps[rows[i]]), int(reps[rows[j]])) for i, j in tile.links(left, left if right is None else right)]


def _pairs(found: list[tuple[int, int]]) -> pa.Table:
    x = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"u": x[:, 0], "v": x[:, 1]})


def _clusters(t: pa.Table) -> list[np.ndarray]:
    """Rows of each cluster of a group of small ones."""
    cluster = t["cluster"].to_numpy()
    order = np.argsort(cluster, kind="stable")
    return [rows for rows in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1) if len(rows) > 1]


def _small(key, t):
    """A bin of small clusters."""
    return _pairs([e for rows in _clusters(t) for e in _edges(t, rows)])


def _tile(key, t):
    """A tile of two blocks, or of one with itself."""
    side = t["side"].to_numpy()
    rows = np.arange(len(side))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(left):
        return _pairs([])
    return _pairs(_edges(t, rows, left, right if len(right) else None))


_KEYED = _schema("rep long, n long, tokens binary, high long, low long")
_LINKS = _schema("high long, low long, n long, others long, u long, v long")


def unpacked(blocks: DataFrame) -> DataFrame:
    """A row for each set, with its key."""

    def unpack(batches):
        for b in batches:
            for row in b.to_pylist():
                ids, n, tok, ends = _sets(row["reps"], row["sizes"], row["tokens"])
                for a in range(0, len(ids), 256):
                    rows = [{"rep": int(r), "n": int(k), "tokens": tok[z - k : z].tobytes()} for r, k, z in zip(ids[a : a + 256], n[a : a + 256], ends[a : a + 256], strict=True)]
                    for x in rows:
                        x["high"], x["low"] = set_key(np.frombuffer(x["tokens"], _U))
                    yield _batch(rows, _KEYED[2])

    return blocks.select("reps", "sizes", "tokens").mapInArrow(unpack, _KEYED[0])


def _linked_rows(t: pa.Table, rows: np.ndarray, sides: np.ndarray | None = None) -> np.ndarray:
    """_LINKS for the given rows; sides: 0 or 1 for each, or all on one."""
    key = np.stack([t[c].to_numpy()[rows] for c in ("high", "low", "n")], 1)
    first = np.sort(np.unique(key, axis=0, return_index=True)[1])  # a set comes again where rows repeat their doc_id and text
    rows, key, copies, reps = rows[first], key[first], t["copies"].to_numpy()[rows[first]], t["rep"].to_numpy()[rows[first]]
    tile = Tile([np.frombuffer(t["tokens"][int(i)].as_py(), _U) for i in rows])
    left = right = np.arange(len(rows))
    if sides is not None and sides.any():
        left, right = np.flatnonzero(sides[first] == 0), np.flatnonzero(sides[first] == 1)
    others = np.zeros(len(rows), np.int64)
    ties = np.array(tile.links(left, right, others, copies), np.int64).reshape(-1, 2)
    linked_ = np.column_stack([key, others, reps, reps])[others > 0]
    zero = np.zeros((len(ties), 4), np.int64)
    return np.concatenate([linked_, np.column_stack([zero, reps[ties[:, 0]], reps[ties[:, 1]]])])


def _rows_of(parts: list[np.ndarray]) -> pa.Table:
    x = np.concatenate([np.zeros((0, 6), np.int64), *parts])
    return pa.table(dict(zip(_LINKS[1], x.T, strict=True)), schema=_LINKS[2])


def _small_counts(key, t):
    """A bin of small clusters."""
    return _rows_of([_linked_rows(t, rows) for rows in _clusters(t)])


def _tile_counts(key, t):
    """A tile of two blocks, or of one with itself."""
    side = t["side"].to_numpy()
    if key[1] != key[2] and len(np.unique(side)) < 2:
        return _rows_of([])  # one of the blocks is empty
    return _rows_of([_linked_rows(t, np.arange(len(side)), side)])


def _bins(sets: DataFrame) -> int:
    """Groups of small clusters, by sets and by shingles."""
    n, words = sets.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    return max(1, math.ceil(n / BIN), math.ceil(16 * words / WORDS))


def _blocks_of(tile: int):
    """Blocks that a group of sets is split into."""
    return F.ceil(F.greatest(F.count("*") / tile, F.sum("n") / WORDS)).cast("int")


def placed_sets(blocks: DataFrame, clusters: DataFrame, named: DataFrame, tile: int) -> DataFrame:
    """A row for each set of a cluster of several: its key, copies, cluster and whether that is a large one."""
    # Aggregates that rows are joined with are written first: joined right away they would share an exchange by
    # cluster, which Spark could not split where one cluster holds most rows.
    own = clusters.join(named.select("rep", "n"), F.col("node") == F.col("rep"))
    sizes = materialize(own.groupBy("component").agg((_blocks_of(tile) > 1).alias("large")), "near-sizes")
    placed = clusters.join(sizes, "component").select(F.col("node").alias("rep"), F.col("component").alias("cluster"), "large")
    sets = unpacked(blocks).join(named.select("high", "low", "n", "copies"), ["high", "low", "n"])
    return materialize(sets.join(placed, "rep"), "near-sets")


def link_counts(blocks: DataFrame, clusters: DataFrame, named: DataFrame, tile: int = TILE) -> DataFrame:
    """high, low, n, others, u, v: for each class with links the rows of other classes that it links to, in each tile (no pair
    is left out), and, where n is 0, links u, v that connect whatever links connect."""
    # Rows of one doc_id with different sets are nodes of one name: these are a cluster even where only they share shingles.
    twins = named.groupBy("rep").count().where("count > 1").select(F.col("rep").alias("node"), F.col("rep").alias("component"))
    sets = placed_sets(blocks, clusters.union(twins.join(clusters, "node", "left_anti")), named, tile)
    small = sets.where("NOT large")
    found = small.withColumn("bin", F.pmod(F.xxhash64("cluster"), F.lit(_bins(small)))).groupBy("bin").applyInArrow(_small_counts, _LINKS[0])

    # Pairs of blocks in one band of sizes or in neighbours, as in links(), but without a hub: every pair of sets is held together.
    large = sets.where("large")
    if large.limit(1).count():
        large = large.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(4 / 3) + 1e-9).cast("int"))
        counts = materialize(large.groupBy("cluster", "band").agg(_blocks_of(tile).alias("own")), "near-bands")
        other = counts.select("cluster", F.col("band").alias("band2"), F.col("own").alias("blocks"))
        meets = counts.join(other, "cluster").where("abs(band - band2) <= 1").groupBy("cluster", "band").agg(F.first("own").alias("own"), F.collect_list(F.struct("band2", "blocks")).alias("meets"))  # at most three bands
        dealt = large.join(materialize(meets, "near-meets"), ["cluster", "band"]).withColumn("i", F.pmod(F.xxhash64("high", "low"), F.col("own")).cast("int"))
        dealt = dealt.withColumn("m", F.explode("meets")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m.blocks") - 1)))
        a, b = F.struct("band", "i"), F.struct(F.col("m.band2").alias("band"), F.col("j").alias("i"))
        dealt = dealt.select("cluster", F.least(a, b).alias("one"), F.greatest(a, b).alias("two"), (a > b).cast("int").alias("side"), "rep", "high", "low", "n", "copies", "tokens")
        found = found.union(dealt.groupBy("cluster", "one", "two").applyInArrow(_tile_counts, _LINKS[0]))
    return found


def links(blocks: DataFrame, clusters: DataFrame, named: DataFrame, tile: int = TILE) -> DataFrame:
    """u, v: links that connect whatever links connect; clusters: node, component."""
    sets = placed_sets(blocks, clusters, named, tile)
    small = sets.where("NOT large")
    found = small.withColumn("bin", F.pmod(F.xxhash64("cluster"), F.lit(_bins(small)))).groupBy("bin").applyInArrow(_small, "u long, v long")
    large = sets.where("large").select("rep", "n", "tokens", "cluster")
    if not large.limit(1).count():
        return found
    hubs = large.where("rep = cluster").select("cluster", F.col("n").alias("hub_n"), F.col("tokens").alias("hub")).dropDuplicates(["cluster"])
    hubs = materialize(hubs, "near-hub-sets")

    def against_hub(batches):
        for b in batches:
            hit = [linked(overlap(np.frombuffer(x, _U), np.frombuffer(y, _U)), n, m) for x, y, n, m in zip(*(b.column(c).to_pylist() for c in ("tokens", "hub", "n", "hub_n")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rep", "n", "tokens", "cluster")), pa.array(hit, pa.bool_())], ["rep", "n", "tokens", "cluster", "near"])

    # The band of size n is floor(log(n) / log(4/3)), so linked sizes lie in one band or in neighbours.
    near = large.join(hubs, "cluster").mapInArrow(against_hub, "rep long, n long, tokens binary, cluster long, near boolean")
    near = near.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(4 / 3) + 1e-9).cast("int"))
    near = materialize(near, "near-hubs")
    counts = near.groupBy("cluster", "band", "near").agg(_blocks_of(tile).alias("blocks"))
    mine = counts.withColumnRenamed("blocks", "own")
    other = counts.select("cluster", F.col("band").alias("band2"), F.col("near").alias("near2"), "blocks")
    # For each kind of block, the kinds that it meets: never two that both link to the hub.
    meets = mine.join(other, "cluster").where("abs(band - band2) <= 1 AND NOT (near AND near2)")
    meets = meets.groupBy("cluster", "band", "near").agg(F.first("own").alias("own"), F.collect_list(F.struct("band2", "near2", "blocks")).alias("meets"))  # at most six kinds
    meets = materialize(meets, "near-meets")
    dealt = near.join(meets, ["cluster", "band", "near"]).withColumn("i", F.pmod(F.xxhash64("rep"), F.col("own")).cast("int"))
    dealt = dealt.withColumn("m", F.explode("meets")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m.blocks") - 1)))
    a, b = F.struct("band", F.col("near").cast("int").alias("near"), "i"), F.struct(F.col("m.band2").alias("band"), F.col("m.near2").cast("int").alias("near"), F.col("j").alias("i"))
    dealt = dealt.select("cluster", F.least(a, b).alias("one"), F.greatest(a, b).alias("two"), (a > b).cast("int").alias("side"), "rep", "tokens")
    tiles = dealt.groupBy("cluster", "one", "two").applyInArrow(_tile, "u long, v long")
    return found.union(tiles).union(near.where("near AND rep <> cluster").select("rep", "cluster"))


def near_duplicates(docs: DataFrame, tile: int = TILE, count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, and n_links if asked for: how many other rows it links with."""
    with scratch() as keep:
        found = keep(materialize(members(docs), "near-members"))
        classes = materialize(found.where("survives").groupBy("high", "low", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "near-classes")
        blocks = materialize(set_blocks(docs, classes), "near-blocks")
        clusters = materialize(components(candidate_edges(blocks)), "near-clusters")
        if count_links:
            tiles = materialize(link_counts(blocks, clusters, classes, tile), "near-links")
            ties, others = tiles.where("n = 0").select("u", "v"), tiles.where("n > 0").groupBy("high", "low", "n").agg(F.sum("others").alias("others"))
        else:
            ties = links(blocks, clusters, classes, tile)
        # A doc_id of several rows is tied to the representatives of all their sets.
        shared = materialize(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "near-shared-ids")
        several = shared.limit(1).count() > 0
        if several:
            own = found.join(shared, "doc_id", "left_semi").select("doc_id", "high", "low", "n").distinct().join(classes, ["high", "low", "n"])
            ties = ties.union(own.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
        joined = components(ties)
        named = classes.join(joined, F.col("rep") == F.col("node"), "left").select("high", "low", "n", "copies", F.coalesce("component", "rep").alias("component"))
        if count_links:
            named = named.join(others, ["high", "low", "n"], "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("others", F.lit(0)))
        # Written first, as above: a class may hold a third of all rows.
        named = keep(materialize(named.drop("copies"), "near-named"))
        if several:
            wide = shared.join(joined, F.col("doc_id") == F.col("node")).select(F.col("doc_id").alias("_id"), F.col("component").alias("whole"))
            wide = keep(materialize(wide, "near-wide"))
    more = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []
    out, reached = found.join(named, ["high", "low", "n"], "left"), ["component"]
    if several:
        out, reached = out.join(wide, F.col("doc_id") == F.col("_id"), "left"), ["whole", "component"]
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(*reached, "doc_id").alias("component_id"), *more)

    def sizes(batches):
        for b in batches:
            n = [len(set_of(h[at[i] : at[i + 1]])) for _, h, at in hashed_words(b.column("text"), fold=True) for i in range(len(at) - 1)]
            yield pa.RecordBatch.from_pydict({"n": pa.array(n, pa.int64())})

    nameless = docs.where("doc_id IS NULL").select(F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(sizes, "n long")
    return out.union(nameless.select(F.lit(None).cast("long"), "n", F.lit(None).cast("long"), *([F.lit(0).cast("long")] if count_links else [])))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, but of each component only those with its smallest doc_id."""
    (gone,) = unused(docs, "_gone")
    other = near_duplicates(docs, count_links=False).where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(other.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col(gone), "left_anti")


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """The contract's columns and n_links, for which every link is verified."""
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i : i + least(len(ws), 5) - 1], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT u, v FROM c JOIN n a ON u = a.doc_id JOIN n b ON v = b.doc_id WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, coalesce(k.n_links, 0) AS n_links FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id
JOIN (SELECT u, min(v) AS component_id FROM r GROUP BY u) m ON d.doc_id = m.u LEFT JOIN (SELECT u, count(*) AS n_links FROM l GROUP BY u) k ON d.doc_id = k.u
"""
