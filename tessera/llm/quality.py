"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Statistics of each whole text are standardised and mapped to cosines that approximate a Gaussian kernel. The
normal equations are summed within partitions and then over partitions; their ridge solution scores texts, and
an isotonic curve fitted on rows that the ridge did not see turns scores into probabilities of label 1.
Labels, lang, source and doc_id are inputs of no score.

Defined cases: null and empty texts are scored like any text (all counts 0); rows without a label, or with
a null one, are not learned from; with no labelled row at all every score is 0.5; repeated rows are scored
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import PIECE, binaries, drop_tables, hashed_words, materialize, mix, table

COSINES, RIDGE, WIDTH, SEED, THRESHOLD = 512, 1e-3, 0.6, 7, 0.3
#: Bins of ridge scores that the isotonic curve is fitted on, and blocks that the normal equations are summed in; partitions
#: that sum them up, at least, and labelled rows of one; partial sums that one task adds.
BINS, BLOCKS, SUMMERS, SUMMED, ADDED = 4096, 16, 48, 50_000, 64

_CLASSES = ["upper", "lower", "digit", "space", "newline", "stop", "comma", "bang", "pipe", "hash", "dollar", "percent", "amp", "star", "quote", "other", "high"]
_CLASS = np.full(256, _CLASSES.index("other"), np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, _CLASSES.index("high")
for _name, _chars in {"space": b" \t\x0b\x0c\r", "newline": b"\n", "stop": b".", "comma": b",;:", "bang": b"!?", "pipe": b"|", "hash": b"#", "dollar": b"$", "percent": b"%", "amp": b"&", "star": b"*", "quote": b"\"'"}.items():
    _CLASS[list(_chars)] = _CLASSES.index(_name)
STATISTICS = [*_CLASSES, "log_bytes", "word_length", "distinct_words", "equal_neighbours", "distinct_pairs", "top_word", "line_length", "words_per_stop"]


def statistics(column) -> np.ndarray:
    """A row of STATISTICS for each text of an Arrow binary column."""
    data, offsets = binaries(column)
    n, k = len(offsets) - 1, len(_CLASSES)
    out = np.zeros((n, len(STATISTICS)))
    lengths = np.diff(offsets).astype(float)
    row = 0
    while row < n:  # about PIECE bytes at once; longer texts in pieces
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1)
        for lo in range(int(offsets[row]), int(offsets[end]), 4 * PIECE):
            hi = min(int(offsets[end]), lo + 4 * PIECE)
            owner = np.repeat(np.arange(end - row), np.diff(np.clip(offsets[row : end + 1], lo, hi)))
            out[row:end, :k] += np.bincount(owner * k + _CLASS[data[lo:hi]], minlength=(end - row) * k).reshape(-1, k)
        row = end
    counts = out[:, :k].copy()
    out[:, :k] = np.sqrt(counts / np.maximum(lengths, 1)[:, None])
    out[:, k] = np.log1p(lengths)
    for first, h, at in hashed_words(column):
        for i in range(len(at) - 1):
            w = h[at[i] : at[i + 1]]
            if not len(w):
                continue
            s = np.sort(w)
            new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
            pairs = np.unique(mix(w[:-1]) + w[1:]) if len(w) > 1 else w
            letters = lengths[first + i] - counts[first + i, 3] - counts[first + i, 4]
            stops = counts[first + i, _CLASSES.index("stop")]
            out[first + i, k + 1 :] = (np.log1p(letters / len(w)), (len(new) - 1) / len(w) ** 0.9, np.mean(w[1:] == w[:-1]) if len(w) > 1 else 0, len(pairs) / len(w), np.diff(new).max() / len(w), np.log1p(lengths[first + i] / (1 + counts[first + i, 4])), np.log1p(len(w) / (1 + stops)))
    return out


@dataclasses.dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None  # of the cosines and of a constant
    knots: tuple[np.ndarray, np.ndarray]
    seed: int = SEED

    def cosines(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.Generator(np.random.PCG64(self.seed))
        w = rng.standard_normal((x.shape[1], COSINES)) * WIDTH / np.sqrt(x.shape[1])
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ w + rng.uniform(0, 2 * np.pi, COSINES)
        return np.hstack([np.cos(z) * np.sqrt(2 / COSINES), np.ones((len(x), 1))])

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.cosines(x[i : i + 2048]) @ self.weights for i in range(0, len(x), 2048)]) if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return np.interp(self.ridge(x), *self.knots)


def _rows(b) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("statistics").to_pylist()), np.float32).reshape(-1, len(STATISTICS)).astype(float)


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the packed statistics of each row."""

    def run(batches):
        for b in batches:
            x = statistics(b.column("text")).astype(np.float32)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "statistics": pa.array([r.tobytes() for r in x], pa.binary())})

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return cols.mapInArrow(run, "doc_id long, statistics binary")


def isotonic(sums: np.ndarray, counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators over bins: positions and values of the blocks, a row added to each end's mean."""
    blocks: list[list[float]] = []
    for s, n, x in zip(sums, counts, at, strict=True):
        if n:
            blocks.append([s, n, x * n])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    x = np.array([b[2] / b[1] for b in blocks])
    y = np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks])
    return x, np.maximum.accumulate(y)


def fit(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """stats: with_statistics(); labels: doc_id, quality. Rows whose crc32 of the id is 0 modulo 5 are held out."""
    k = len(STATISTICS)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).cast("double").alias("y"))
    rows = stats.join(known, "doc_id").withColumn("fold", fold).where("fold <> 0")
    summers = max(SUMMERS, math.ceil(known.count() / SUMMED))
    rows = materialize(rows.select("statistics", "y", "fold").repartition(summers), "quality-rows")

    def moments(batches):
        for b in batches:
            x = _rows(b)
            yield pa.RecordBatch.from_pydict({"i": np.arange(2 * k + 1), "v": np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]])})

    sums = np.zeros(2 * k + 1)
    for i, v in rows.mapInArrow(moments, "i long, v double").groupBy("i").agg(F.sum("v")).collect():
        sums[i] = v
    n = sums[-1]
    if n == 0:
        return QualityModel(np.zeros(k), np.ones(k), None, (np.zeros(1), np.zeros(1)))
    mean = sums[:k] / n
    model = QualityModel(mean, np.sqrt(np.maximum(sums[k : 2 * k] / n - mean**2, 1e-8)), None, (np.zeros(1), np.zeros(1)))
    d = COSINES + 1

    def equations(batches):
        total = np.zeros((d, d + 1))
        for b in batches:
            x, y = _rows(b), b.column("y").to_numpy(zero_copy_only=False)
            for i in range(0, len(x), 2048):
                z = model.cosines(x[i : i + 2048])
                total += z.T @ np.hstack([z, y[i : i + 2048, None]])
        at = TaskContext.get().partitionId()
        for block, part in enumerate(np.array_split(total, BLOCKS)):
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "at": pa.array([at], pa.int32()), "part": pa.array([part.tobytes()], pa.binary())})

    def add(key, t):
        total = sum(np.frombuffer(p, float) for p in t["part"].to_pylist())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "at": pa.array([key[1].as_py()], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    def solve(of: DataFrame) -> np.ndarray:
        kind = "block int, at int, part binary"
        sums, left = of.mapInArrow(equations, kind), of.rdd.getNumPartitions()
        while left:  # level by level, so that no task adds more than ADDED partial sums
            left //= ADDED
            sums = sums.withColumn("at", F.expr(f"cast(at div {ADDED} as int)")).groupBy("block", "at").applyInArrow(add, kind)
        parts = sums.select("block", "part").collect()  # BLOCKS rows, the equations
        total = np.concatenate([np.frombuffer(p, float) for _, p in sorted(parts)]).reshape(d, d + 1)
        rows_seen = total[-1, -2]
        penalty = np.eye(d) * RIDGE * max(rows_seen, 1)
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(total[:, :-1] + penalty, total[:, -1])

    learned = rows.where("fold <> 1")
    model.weights = solve(learned if learned.limit(1).count() else rows)

    def binned(batches):
        for b in batches:
            at = np.clip(((model.ridge(_rows(b)) + 0.5) * BINS / 2).astype(int), 0, BINS - 1)
            yield pa.RecordBatch.from_pydict({"bin": np.arange(BINS), "s": np.bincount(at, b.column("y").to_numpy(zero_copy_only=False), BINS), "n": np.bincount(at, minlength=BINS).astype(float)})

    held = rows.where("fold = 1")
    held = held if held.limit(1).count() else rows
    s, m = np.zeros(BINS), np.zeros(BINS)
    for i, a, b in held.mapInArrow(binned, "bin long, s double, n double").where("n > 0").groupBy("bin").agg(F.sum("s"), F.sum("n")).collect():
        s[i], m[i] = a, b
    model.knots = isotonic(s, m, (np.arange(BINS) + 0.5) * 2 / BINS - 0.5)
    drop_tables(rows)
    return model


def score(stats: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score of with_statistics()'s rows."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": shared.value.score(_rows(b))})

    return stats.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score at least the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            text = b.column("text").fill_null(b"")
            kept = b.filter(pa.array(shared.value.score(statistics(text)) >= threshold))
            at = kept.schema.get_field_index("text")
            yield kept.set_column(at, "text", kept.column("text").cast(pa.string()))

    return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, docs.schema)


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    stats = materialize(with_statistics(table(spark, sf_dir, "documents")), "quality-statistics")
    model = fit(stats, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return score(stats, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
