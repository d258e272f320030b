"""SentencePiece encoding and decoding in batches of numpy arrays.

A text is cut before each run of spaces (no piece of a model crosses such a cut; that is checked on loading),
distinct cuts are encoded once for each batch, and cuts of equal length advance together as one matrix:
hashes of substrings probe the sorted hashes of the pieces.

* Unigram models: Viterbi. For each end position the vectorised maximum over piece lengths is kept with its
  backpointer; paths are read back for all words at once.
* BPE models: a Viterbi path over BPE scores isn't what such a model encodes to (README has the measured
  share), so each step merges, in every word of the matrix, the best pair (vectorised maximum over positions,
  the leftmost of equals), until no pair is a piece. Cuts beyond LONG characters take the same merges
  from a heap.

Characters outside the vocabulary become byte pieces where the model has them, else the unknown piece.

Defined cases: a null text counts as empty, an empty text has no pieces; U+2581 in a text is the model's own
sign for a space and decodes to one; repeated rows repeat their result; texts are encoded whole; an empty
table gives an empty result; other columns are kept or ignored as each function says.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import importlib.util
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import mix, table, unused

#: Characters of a cut up to which cuts are encoded as matrices; rows of a matrix; distinct cuts that are remembered.
LONG, ROWS, REMEMBERED = 32, 1 << 16, 200_000
SPACE = "▁"
_U = np.uint64
_B = _U(0x9E3779B97F4A7C15)


def model_path() -> str:
    """Where the installed public tokenizers keep the SentencePiece model."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = spec.submodule_search_locations[0] if spec else "/opt/tokenizers"
    return os.path.join(folder, "piece_bpe_32k.model")


def _powers(n: int) -> np.ndarray:
    steps = np.full(n, _B, _U)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_POWERS = _powers(4096)


def _hash(s: str) -> np.uint64:
    h = 0
    for c in mix(np.array([ord(c) for c in s], _U)).tolist():
        h = (h * int(_B) + c) % 2**64
    return _U(h)


class Pieces:
    """A model's pieces, ready for probing. viterbi: None follows the model's own type."""

    def __init__(self, pieces: list[tuple[str, float, int]], bpe: bool, prefix: bool = True, viterbi: bool | None = None):
        self.pieces, self.prefix, self.viterbi = pieces, prefix, (not bpe) if viterbi is None else viterbi
        normal = [(i, p, s) for i, (p, s, kind) in enumerate(pieces) if kind in (1, 4, 5)]
        if any(SPACE in p.lstrip(SPACE) for _, p, _ in normal) or any("\n" in p for _, p, _ in normal):
            raise ValueError("a piece crosses a cut")
        keys = np.array([_hash(p) for _, p, _ in normal], _U)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([i for i, _, _ in normal])[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        self.scores = np.array([s for _, _, s in normal], np.float32)[order]
        self.by_text = {p: (s, i) for i, p, s in normal}
        self.longest = max(len(p) for _, p, _ in normal)
        self.unknown = next((i for i, x in enumerate(pieces) if x[2] == 2), 0)
        self.bytes = [next((i for i, x in enumerate(pieces) if x[2] == 6 and x[0] == f"<0x{b:02X}>"), self.unknown) for b in range(256)]
        raw = [bytes([int(p[3:5], 16)]) if kind == 6 else b"" if kind == 3 else p.replace(SPACE, " ").encode() for p, _, kind in pieces]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        self.known: dict[bytes, tuple[int, ...]] = {}

    @classmethod
    def load(cls, model: bytes, viterbi: bool | None = None) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(model)
        n = m.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces:
            raise ValueError("only models without normalisation are supported")
        return cls([(p.piece, p.score, p.type) for p in m.pieces], m.trainer_spec.model_type == 2, n.add_dummy_prefix, viterbi)

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Positions in the sorted keys, -1 where no piece has the hash."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def _ids(self, found: int, text: str) -> tuple[int, ...]:
        if found >= 0:
            return (int(self.ids[found]),)
        return tuple(x if (x := self.bytes[b]) != self.unknown else self.unknown for b in text.encode("utf-8", "surrogatepass"))

    def _merge(self, words: list[str]) -> list[tuple[int, ...]]:
        """BPE of words of one length."""
        n, size = len(words), len(words[0])
        h = mix(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).astype(_U))
        lengths, rows = np.ones((n, size), np.int64), np.arange(n)
        out: list[tuple[int, ...]] = [()] * n

        def pair(a, b, la):
            return self.probe(a * _POWERS[la] + b)

        best = pair(h[:, :-1], h[:, 1:], lengths[:, 1:]) if size > 1 else np.zeros((n, 0), np.int64)
        score = np.where(best >= 0, self.scores[best], -np.inf)
        while len(rows):
            at = score.argmax(1) if score.shape[1] else np.zeros(len(rows), np.int64)
            going = score[np.arange(len(rows)), at] > -np.inf if score.shape[1] else np.zeros(len(rows), bool)
            done = np.flatnonzero(~going)
            found = self.probe(h[done])
            plain = (found >= 0).all(1)
            for k, ids in zip(rows[done[plain]].tolist(), self.ids[found[plain]].tolist(), strict=True):
                out[k] = tuple(ids)
            for k, f in zip(done[~plain].tolist(), found[~plain].tolist(), strict=True):
                word, ends = words[rows[k]], np.cumsum(lengths[k]).tolist()
                out[rows[k]] = tuple(x for g, a, z in zip(f, [0, *ends], ends, strict=False) for x in self._ids(g, word[a:z]))
            if not going.any():
                break
            rows, at, h, lengths, score = rows[going], at[going], h[going], lengths[going], score[going]
            i, m = np.arange(len(rows)), h.shape[1]
            h[i, at] = h[i, at] * _POWERS[lengths[i, at + 1]] + h[i, at + 1]
            lengths[i, at] += lengths[i, at + 1]
            keep = np.arange(m - 1) + (np.arange(m - 1) > at[:, None])
            h, lengths = np.take_along_axis(h, keep, 1), np.take_along_axis(lengths, keep, 1)
            keep = np.arange(m - 2) + (np.arange(m - 2) >= at[:, None]) if m > 2 else np.zeros((len(rows), 0), np.int64)
            score = np.take_along_axis(score, keep, 1)
            for left in (at - 1, at):
                k = np.flatnonzero((left >= 0) & (left < m - 2))
                if len(k):
                    p = left[k]
                    f = pair(h[k, p], h[k, p + 1], lengths[k, p + 1])
                    score[k, p] = np.where(f >= 0, self.scores[f], -np.inf)
        return out

    def _merge_long(self, word: str) -> tuple[int, ...]:
        """BPE of one word from a heap of pairs."""
        parts, after, before = list(word), [*range(1, len(word)), -1], [-1, *range(len(word) - 1)]
        heap: list[tuple[float, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (known := self.by_text.get(parts[a] + parts[b])):
                heapq.heappush(heap, (-known[0], a, parts[a] + parts[b]))

        for i in range(len(word) - 1):
            offer(i, i + 1)
        while heap:
            _, a, text = heapq.heappop(heap)
            b = after[a]
            if b < 0 or not parts[a] or parts[a] + parts[b] != text:
                continue
            parts[a], parts[b], after[a] = text, "", after[b]
            if after[b] >= 0:
                before[after[b]] = a
            after[b] = -1
            offer(before[a], a)
            offer(a, after[a])
        ids: list[int] = []
        for p in filter(None, parts):
            ids += (self.by_text[p][1],) if p in self.by_text else self._ids(-1, p)
        return tuple(ids)

    def _viterbi(self, words: list[str]) -> list[tuple[int, ...]]:
        """Best paths of words of one length; a character outside the vocabulary costs 10 more than the worst piece."""
        n, size = len(words), len(words[0])
        codes = mix(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).astype(_U))
        sums = np.zeros((n, size + 1), _U)
        for i in range(size):
            sums[:, i + 1] = sums[:, i] * _B + codes[:, i]
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, size + 1), np.int64), np.full((n, size + 1), -1)
        powers = _POWERS if size < len(_POWERS) else _powers(size + 1)
        for end in range(1, size + 1):
            lengths = np.arange(1, min(end, self.longest) + 1)
            f = self.probe(sums[:, end, None] - sums[:, end - lengths] * powers[lengths])
            gain = np.where(f >= 0, self.scores[f].astype(float), -np.inf)
            gain[:, 0] = np.where(f[:, 0] >= 0, gain[:, 0], float(self.scores.min()) - 10)
            reached = best[:, end - lengths] + gain
            k = reached.argmax(1)
            i = np.arange(n)
            best[:, end], back[:, end], piece[:, end] = reached[i, k], lengths[k], f[i, k]
        at, paths = np.full(n, size), []
        while (at > 0).any():
            i = np.arange(n)
            paths.append((at, piece[i, at], at > 0))
            at = np.where(at > 0, at - back[i, at], 0)
        out = []
        for k, word in enumerate(words):
            ids: list[int] = []
            for end, f, live in reversed(paths):
                if live[k]:
                    ids += self._ids(int(f[k]), word[end[k] - 1 : end[k]] if f[k] < 0 else "")
            out.append(tuple(ids))
        return out

    def encode_cuts(self, cuts: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of distinct cuts; those met before are remembered, up to REMEMBERED."""
        by_size: dict[int, list[tuple[int, str]]] = {}
        out: list[tuple[int, ...]] = [()] * len(cuts)
        for i, cut in enumerate(cuts):
            if (known := self.known.get(cut)) is not None:
                out[i] = known
                continue
            text = cut.decode("utf-8", "surrogateescape").replace(" ", SPACE)
            by_size.setdefault(len(text), []).append((i, text))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for size, found in by_size.items():
            step = max(1, ROWS * 8 // size)
            for a in range(0, len(found), step):
                group = found[a : a + step]
                words = [w for _, w in group]
                done = self._viterbi(words) if self.viterbi else self._merge(words) if size <= LONG else map(self._merge_long, words)
                for (i, _), ids in zip(group, done, strict=True):
                    out[i] = ids
                    if size <= LONG:
                        self.known[cuts[i]] = ids
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Piece ids of each text."""
        seen: dict[bytes, int] = {}
        indices = []
        for text in texts:
            text = text.replace(SPACE.encode(), b" ")
            cuts = _CUT.findall(b" " + text if self.prefix and text else text)
            indices.append(np.fromiter((seen.setdefault(c, len(seen)) for c in cuts), np.int64, len(cuts)))
        coded = self.encode_cuts(list(seen))
        counts = np.array([len(c) for c in coded], np.int64)
        flat = np.fromiter((x for c in coded for x in c), np.int32, int(counts.sum()))
        starts = np.cumsum(counts) - counts
        return [flat[_ranges(starts[i], counts[i])] for i in indices]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes; the space that encoding puts first is taken away."""
        ids = np.asarray(ids, np.int64)
        text = self.raw[_ranges(self.raw_at[ids], self.raw_at[ids + 1] - self.raw_at[ids])].tobytes()
        return text[1:] if self.prefix and text[:1] == b" " else text


_CUT = re.compile(rb" +[^ \n]*|[^ \n]+|\n")


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each pair, one after another."""
    total = int(counts.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


@functools.lru_cache(maxsize=2)
def _loaded(model: bytes, viterbi: bool | None) -> Pieces:
    return Pieces.load(model, viterbi)


def _slices(column, size: int = 4 << 20):
    """(first row, texts) of about `size` bytes each."""
    held, total, first = [], 0, 0
    for i, text in enumerate(column):
        held.append(text.as_py() or b"")
        total += len(held[-1])
        if total >= size:
            yield first, held
            held, total, first = [], 0, i + 1
    if held:
        yield first, held


def _model(spark, path: str | None):
    with open(path or model_path(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # a vocabulary, of one size whatever the input


def encode(docs: DataFrame, path: str | None = None, viterbi: bool | None = None) -> DataFrame:
    """docs, all columns, with pieces: array<int> of its text (a column of that name is replaced)."""
    docs = docs.drop("pieces")
    (raw,), names, held = unused(docs, "_text"), docs.columns, _model(docs.sparkSession, path)

    def run(batches):
        p = _loaded(held.value, viterbi)
        for b in batches:
            for first, texts in _slices(b.column(raw)):
                ids = p.encode(texts)
                at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(first, len(texts)) for c in names), listed], [*names, "pieces"])

    schema = T.StructType([*docs.schema.fields, T.StructField("pieces", T.ArrayType(T.IntegerType()))])
    return docs.withColumn(raw, F.col("text").cast("binary")).mapInArrow(run, schema)


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """coded, all columns, with decoded: the string of its pieces."""
    coded = coded.drop("decoded")
    names, held = coded.columns, _model(coded.sparkSession, path)

    def run(batches):
        p = _loaded(held.value, None)
        for b in batches:
            lists = b.column("pieces").fill_null(pa.scalar([], b.column("pieces").type))
            texts = [p.decode(x.values.to_numpy()) for x in lists]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(texts, pa.binary()).cast(pa.string())], [*names, "decoded"])

    schema = T.StructType([*coded.schema.fields, T.StructField("decoded", T.StringType())])
    return coded.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None, viterbi: bool | None = None) -> DataFrame:
    """doc_id, n_pieces, pieces_sha256 (of little-endian 32-bit ids), decoded_sha256, round_trip: encode and decode in one pass."""
    held = _model(docs.sparkSession, path)

    def run(batches):
        p = _loaded(held.value, viterbi)
        for b in batches:
            for first, texts in _slices(b.column("text")):
                ids = p.encode(texts)
                back = [p.decode(x) for x in ids]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column("doc_id").slice(first, len(texts)),
                    "n_pieces": pa.array([len(x) for x in ids], pa.int64()),
                    "pieces_sha256": [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back],
                    "round_trip": [x == t for x, t in zip(back, texts, strict=True)],
                })

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return cols.mapInArrow(run, "doc_id long, n_pieces long, pieces_sha256 string, decoded_sha256 string, round_trip boolean")


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
