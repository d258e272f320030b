"""BAM as a Python data source: spark.read.format("bam").load(path).

With a .bai beside the file each partition is a stretch of virtual offsets from the linear index. Filters on contig
(one name or a list) and bounds on pos0 prune partitions and end a stretch early; the option region=contig:start-stop
(0-based, half open) reads the alignments that overlap it and no others. Without an index the file is a single
partition. rec_idx is the virtual offset of a record, which grows in file order. Records are decoded a block of
them at once, into arrays. Formats are those of the public SAM specification.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tessera.sources.files import exists, open_file

SCHEMA = "contig string, pos0 long, flag int, mapq int, cigar string, qname string, seq string, qual string, rec_idx long"
#: Fixed values of the format: codes of bases and of CIGAR operations.
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
#: Bytes of records that are decoded at once, bits of a position within a window of the linear index, the most partitions.
CHUNK, WINDOW_BITS, STRETCHES = 1 << 20, 14, 4096
END, FAR = 1 << 62, 1 << 40


class Bgzf:
    """Reads across the blocks of a BGZF file from a virtual offset on."""

    def __init__(self, f, offset: int = 0):
        self.f, self.data, self.at = f, b"", 0
        self.block, self.next = offset >> 16, offset >> 16
        if self._load():
            self.at = offset & 0xFFFF

    def _load(self) -> bool:
        self.f.seek(self.next)
        head = self.f.read(12)
        if len(head) < 12:
            self.data, self.at = b"", 0
            return False
        extra = self.f.read(struct.unpack_from("<H", head, 10)[0])
        i = 0
        while extra[i : i + 2] != b"BC":
            i += 4 + struct.unpack_from("<H", extra, i + 2)[0]
        size = struct.unpack_from("<H", extra, i + 4)[0] + 1
        body = self.f.read(size - 12 - len(extra))
        self.block, self.next = self.next, self.next + size
        self.data, self.at = zlib.decompress(body[:-8], -15), 0
        return True

    def tell(self) -> int:
        while self.at >= len(self.data) and self._load():
            pass
        return self.block << 16 | self.at

    def read(self, n: int) -> bytes:
        parts = []
        while n:
            if self.at >= len(self.data) and not self._load():
                break
            part = self.data[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
        return b"".join(parts)


def header(b: Bgzf) -> list[tuple[str, int]]:
    """(name, length) of the contigs, in file order; leaves b at the first record."""
    if b.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    b.read(struct.unpack("<i", b.read(4))[0])
    out = []
    for _ in range(struct.unpack("<i", b.read(4))[0]):
        name = b.read(struct.unpack("<i", b.read(4))[0])[:-1].decode()
        out.append((name, struct.unpack("<i", b.read(4))[0]))
    return out


def linear_index(data: bytes) -> list[list[int]]:
    """The linear index of each contig: virtual offsets, one for each 16 kb window."""
    if data[:4] != b"BAI\1":
        raise ValueError("not a BAI file")
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        bins, at = struct.unpack_from("<i", data, at)[0], at + 4
        for _ in range(bins):
            at += 8 + 16 * struct.unpack_from("<Ii", data, at)[1]
        n, at = struct.unpack_from("<i", data, at)[0], at + 4
        out.append(list(struct.unpack_from(f"<{n}Q", data, at)))
        at += 8 * n
    return out


@dataclass
class Stretch(InputPartition):
    start: int
    stop: int  # virtual offset, or END for the end of the file
    ref: int | None = None  # the only contig that is read, up to alignments that start at `before`
    before: int = FAR


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each pair, one after another."""
    return np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _strings(data: np.ndarray, counts: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """Strings that are laid end to end; null where missing says so."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    valid = None if missing is None else pa.py_buffer(np.packbits(~missing, bitorder="little"))
    return pa.StringArray.from_buffers(len(counts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)), valid)


_LETTERS = np.frombuffer(BASES.encode(), np.uint8)
_FIXED = np.dtype([("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_ops", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("next_ref", "<i4"), ("next_pos", "<i4"), ("t_len", "<i4")])
#: Operations that take up bases of the reference.
_SPANS = np.isin(np.arange(16), [OPERATIONS.index(o) for o in "MDN=X"])


def decode(data: np.ndarray, at: np.ndarray, offsets: np.ndarray, names: list[str], region: tuple[int, int] | None = None) -> pa.RecordBatch:
    """The records that start at the given positions of data; region: only those that overlap it."""
    head = data[at[:, None] + np.arange(_FIXED.itemsize)].view(_FIXED)[:, 0]
    ops_at = at + _FIXED.itemsize + head["l_name"]
    if region:
        n_ops = head["n_ops"].astype(np.int64)
        ops = data[(4 * _ranges(np.zeros(len(at), np.int64), n_ops) + np.repeat(ops_at, n_ops))[:, None] + np.arange(4)].view("<u4")[:, 0]
        span = np.bincount(np.repeat(np.arange(len(at)), n_ops), np.where(_SPANS[ops & 15], ops >> 4, 0), len(at))
        keep = (head["pos"] < region[1]) & (head["pos"] + span > region[0])
        head, at, ops_at, offsets = head[keep], at[keep], ops_at[keep], offsets[keep]
    n_ops, l_seq = head["n_ops"].astype(np.int64), head["l_seq"].astype(np.int64)
    known: dict[bytes, str] = {}
    cigars = []
    for a, n in zip(ops_at.tolist(), n_ops.tolist(), strict=True):
        raw = data[a : a + 4 * n].tobytes()
        if (text := known.get(raw)) is None:
            text = known[raw] = "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in struct.unpack(f"<{n}I", raw)) or "*"
        cigars.append(text)
    seq_at, packed = ops_at + 4 * n_ops, (l_seq + 1) // 2
    base = _ranges(np.zeros(len(at), np.int64), l_seq)
    byte = data[np.repeat(seq_at, l_seq) + (base >> 1)]
    letters, lengths = _LETTERS[np.where(base & 1, byte & 15, byte >> 4)], l_seq
    if (l_seq == 0).any():
        lengths = np.maximum(l_seq, 1)
        whole = np.full(int(lengths.sum()), ord("*"), np.uint8)
        whole[_ranges(np.cumsum(lengths) - lengths, l_seq)] = letters
        letters = whole
    qual_at = seq_at + packed
    missing = (l_seq == 0) | (data[np.minimum(qual_at, len(data) - 1)] == 0xFF)
    n_qual = np.where(missing, 0, l_seq)
    name_bytes, n_name = data[_ranges(at + _FIXED.itemsize, head["l_name"].astype(np.int64) - 1)], head["l_name"].astype(np.int64) - 1
    contigs = pa.DictionaryArray.from_arrays(pa.array(np.maximum(head["ref"], 0), pa.int32(), mask=head["ref"] < 0), pa.array(names or [""])).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [
            contigs, pa.array(head["pos"].astype(np.int64)), pa.array(head["flag"].astype(np.int32)), pa.array(head["mapq"].astype(np.int32)), pa.array(cigars, pa.string()),
            _strings(name_bytes, n_name), _strings(letters, lengths), _strings(data[_ranges(qual_at, n_qual)] + np.uint8(33), n_qual, missing), pa.array(offsets),
        ],
        [x.split()[0] for x in SCHEMA.split(", ")],
    )


def chunks(b: Bgzf):
    """(data, positions, virtual offsets) of whole records, about CHUNK bytes at once."""
    # Blocks by the place of their first byte in the stream that is read; the first one may be entered in its middle.
    places, blocks = [-b.at], [b.block]
    rest, done, stream, going = b.data[b.at :], 0, len(b.data) - b.at, bool(b.data)
    while going or rest:
        parts, size = [rest], len(rest)
        while size < max(CHUNK, 2 * len(rest)) and (going := b._load()):
            places.append(stream)
            blocks.append(b.block)
            parts.append(b.data)
            size, stream = size + len(b.data), stream + len(b.data)
        data, at, found = b"".join(parts), 0, []
        while at + 4 <= len(data) and (end := at + 4 + struct.unpack_from("<i", data, at)[0]) <= len(data):
            found.append(at + 4)
            at = end
        if found:
            start = np.array(found, np.int64)
            own = np.searchsorted(places, start - 4 + done, side="right") - 1
            yield np.frombuffer(data, np.uint8), start, np.array(blocks, np.int64)[own] << 16 | (start - 4 + done - np.array(places, np.int64)[own])
        elif not going:
            return
        rest, done = data[at:], done + at
        keep = max(0, int(np.searchsorted(places, done, side="right")) - 1)
        places, blocks = places[keep:], blocks[keep:]


class BamReader(DataSourceReader):
    def __init__(self, path: str, region: str | None = None):
        self.path, self.contigs, self.least, self.before, self.region = path, None, 0, FAR, None
        if region:
            name, _, span = region.rpartition(":")
            self.region = tuple(int(x) for x in span.split("-"))
            self.contigs = {name}

    def pushFilters(self, filters):
        for f in filters:
            if f.__class__ in (EqualTo, In) and f.attribute == ("contig",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.contigs = named if self.contigs is None else self.contigs & named
            elif isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) and f.attribute == ("pos0",):
                self.least = max(self.least, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) and f.attribute == ("pos0",):
                self.before = min(self.before, f.value + (not isinstance(f, LessThan)))
            yield f  # pruning only: Spark filters rows as well

    def partitions(self) -> list[InputPartition]:
        with open_file(self.path) as f:
            b = Bgzf(f)
            names = [n for n, _ in header(b)]
            first = b.tell()
        if not exists(self.path + ".bai"):
            return [Stretch(first, END)]
        with open_file(self.path + ".bai") as f:
            index = linear_index(f.read())
        if self.contigs is None and not self.least and self.before == FAR:
            cuts = sorted({first, *(x for of in index for x in of if x)})
            cuts = cuts[:: max(1, len(cuts) // STRETCHES)]
            return [Stretch(a, z) for a, z in zip(cuts, [*cuts[1:], END], strict=True)]
        # An entry is the first alignment that reaches into its window, so the stretch of a region begins at its first
        # window's; alignments are sorted, so it ends with the first one that starts beyond the region.
        least, before = (self.region[0], min(self.before, self.region[1])) if self.region else (self.least, self.before)
        out: list[InputPartition] = []
        for ref, name in enumerate(names):
            if (self.contigs is None or name in self.contigs) and ref < len(index) and least < before:
                windows = index[ref][max(0, least) >> WINDOW_BITS :]
                near = sorted({x for x in windows[: (before - 1 >> WINDOW_BITS) - (max(0, least) >> WINDOW_BITS) + 1] if x})
                near = near[:: max(1, len(near) // STRETCHES)]
                out += [Stretch(a, z, ref, before) for a, z in zip(near, [*near[1:], END], strict=False)]
        return out or [Stretch(first, first)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if partition.start >= partition.stop:
            return
        with open_file(self.path) as f:
            names = [n for n, _ in header(Bgzf(f))]
            only = names.index(next(iter(self.contigs))) if self.region and next(iter(self.contigs), None) in names else -2
            for data, at, offsets in chunks(Bgzf(f, partition.start)):
                last = int(np.searchsorted(offsets, partition.stop))
                if partition.ref is not None or self.region:
                    ref, pos = (data[at[:, None] + np.arange(k, k + 4)].view("<i4")[:, 0] for k in (0, 4))
                    if partition.ref is not None:
                        beyond = np.flatnonzero((ref != partition.ref) | (pos >= partition.before))
                        last = min(last, int(beyond[0])) if len(beyond) else last
                kept = np.arange(last)
                if self.region:
                    kept = kept[ref[:last] == only]
                if len(kept):
                    yield decode(data, at[kept], offsets[kept], names, self.region)
                if last < len(at):
                    return


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BamReader(self.options["path"], self.options.get("region"))


def read_bam(spark: SparkSession, path: str, region: tuple[str, int, int] | None = None) -> DataFrame:
    """The alignments of a file, or those that overlap a region (contig, start, stop; 0-based, half open)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)
    source = spark.read.format("bam")
    return (source.option("region", "{}:{}-{}".format(*region)) if region else source).load(path)


def bam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """contig, contig_ord, length of the header."""
    with open_file(path) as f:
        found = header(Bgzf(f))
    return spark.createDataFrame([(n, i, k) for i, (n, k) in enumerate(found)], "contig string, contig_ord int, length long")


def mapped_counts(reads: DataFrame) -> DataFrame:
    """contig, mapped: reads placed on each contig without the unmapped flag."""
    return reads.where("contig IS NOT NULL").groupBy("contig").agg(F.count_if(F.col("flag").bitwiseAND(4) == 0).alias("mapped"))
