"""What the operators share: input tables, columns beside the caller's, and hashing of words in whole batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import drop_tables, fresh_dir, materialize, remove, scratch, shared_dir  # noqa: F401

#: Bytes of text that are hashed at once; bounds memory for any document length.
PIECE = 1 << 20


#: Rows and bytes of an Arrow batch: Spark's own 10,000 rows and 64 MB are much memory where texts are long.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, and so the memory of Python workers; a lower number of rows stays."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it: an operator's own columns beside the caller's."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def texts(df: DataFrame, *also: str) -> DataFrame:
    """doc_id and the text's UTF-8 bytes (null: empty), ready for Arrow; other columns only as named."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *also)


def binaries(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow binary column, without copying."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = a.chunk(0) if a.num_chunks else pa.array([], a.type)
    wide = np.int64 if pa.types.is_large_binary(a.type) or pa.types.is_large_string(a.type) else np.int32
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(a.buffers()[1], wide)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None and a.buffers()[2].size else np.zeros(0, np.uint8)
    return data, offsets


_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240613))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int, back: bool = False) -> np.ndarray:
    """The base's powers, or those of its inverse modulo 2**64."""
    key = "back" if back else "on"
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, PIECE + 4096), _BACK if back else _BASE, _U)
        steps[0] = 1
        _powers[key] = np.multiply.accumulate(steps)
    return _powers[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _hash_words(data: np.ndarray, bounds: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts laid end to end, and how many words start before each bound."""
    n = len(data)
    if n == 0:
        return np.zeros(0, _U), np.zeros(len(bounds), np.int64)
    word = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    before[bounds[bounds < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    after[bounds[bounds > 0] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after)
    sums = np.cumsum((_FOLDED if fold else _BYTE)[data] * powers(n))
    below = np.where(starts > 0, sums[starts - 1], _U(0))
    h = mix((sums[ends] - below) * powers(n, back=True)[starts] + (ends - starts).astype(_U))
    return h, np.searchsorted(starts, bounds)


def hashed_words(column, fold: bool = False):
    """Yields (first row, word hashes, word offsets by row) for runs of rows of an Arrow binary column.

    Words are the runs of bytes other than x20 and x09-x0D; fold: A-Z count as a-z. Runs hold about
    PIECE bytes; a longer text is hashed in pieces cut at white space, so memory follows its words."""
    data, offsets = binaries(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[end])
        if hi - lo <= PIECE + 4096:
            h, at = _hash_words(data[lo:hi], offsets[row : end + 1] - lo, fold)
        else:
            parts, cut = [], lo
            while cut < hi:
                stop = min(hi, cut + PIECE)
                while stop < hi and not _SPACE[data[stop]]:
                    stop += 1
                parts.append(_hash_words(data[cut:stop], np.array([0, stop - cut]), fold)[0])
                cut = stop
            h = np.concatenate(parts)
            at = np.array([0, len(h)])
        yield row, h, at
        row = end


_WEIGHTS = mix(np.arange(1, 65, dtype=np.uint64)) | _U(1)


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each run of `width` word hashes; of the whole sequence where it is shorter, none if empty."""
    w = min(width, len(h))
    if w == 0:
        return h[:0]
    out = np.full(len(h) - w + 1, w, _U)
    for k in range(w):
        out += h[k : len(h) - w + 1 + k] * _WEIGHTS[k]
    return mix(out)


def code_points(b: bytes) -> int:
    return len(b) if b.isascii() else len(b.decode("utf-8", "replace"))
