"""SAM text, barcode lists and FASTA."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, In, InputPartition, LessThan

from tessera.sources.files import open_file


#: Bases of a tile of FASTA.
TILE = 10_000


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text (plain or .gz) in the columns of the BAM source."""
    x = F.split("value", "\t")
    lines = spark.read.text(path).where("value <> '' AND NOT startswith(value, '@')").select(x.alias("x"), F.monotonically_increasing_id().alias("rec_idx"))
    of = lambda i: F.get("x", F.lit(i))
    none = lambda c, mark: F.when(c != mark, c)
    return lines.select(none(of(2), "*").alias("contig"), (of(3).cast("long") - 1).alias("pos0"), of(1).cast("int").alias("flag"), of(4).cast("int").alias("mapq"), of(5).alias("cigar"), of(0).alias("qname"), of(9).alias("seq"), none(of(10), "*").alias("qual"), "rec_idx")


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """barcode: the first field of each line (plain or .gz); blank lines and those that start with # are left out."""
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    return spark.read.text(path).select(line.alias("v")).where("v <> '' AND NOT startswith(v, '#')").select(F.split("v", r"\s+")[0].alias("barcode")).distinct()


def fasta_index(path: str) -> list[tuple[str, int, int, int, int]]:
    """Rows of the .fai beside the file: name, length, offset, bases and bytes of a line; shorter rows are left out."""
    with open_file(path + ".fai") as f:
        rows = [line.split("\t") for line in f.read().decode().splitlines()]
    out = [(r[0], *map(int, r[1:5])) for r in rows if len(r) >= 5]
    if any(r[3] <= 0 or r[4] <= 0 for r in out):
        raise ValueError("a line of the index has no width")
    return out


def fetch(f, entry: tuple[str, int, int, int, int], start: int, stop: int) -> str:
    """Upper-case bases of the half-open 0-based stretch, clipped to the contig."""
    _, length, offset, bases, width = entry
    start, stop = max(0, start), min(stop, length)
    if start >= stop:
        return ""
    at = lambda i: offset + i // bases * width + i % bases
    f.seek(at(start))
    return f.read(at(stop - 1) + 1 - at(start)).replace(b"\n", b"").replace(b"\r", b"").decode().upper()


@dataclass
class Tiles(InputPartition):
    entry: tuple
    start: int
    stop: int


class FastaReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.tile, self.part = options["path"], int(options.get("tile", TILE)), int(options.get("part", 5_000_000))
        self.contigs, self.least, self.before = None, 0, 1 << 62

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("contig",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.contigs = named if self.contigs is None else self.contigs & named
            elif isinstance(f, GreaterThanOrEqual) and f.attribute == ("tile_start",):
                self.least = max(self.least, f.value)
            elif isinstance(f, LessThan) and f.attribute == ("tile_start",):
                self.before = min(self.before, f.value)
            yield f  # pruning only: Spark filters rows as well

    def partitions(self) -> list[InputPartition]:
        step, wanted = max(self.tile, self.part // self.tile * self.tile), [e for e in fasta_index(self.path) if self.contigs is None or e[0] in self.contigs]
        first = self.least // self.tile * self.tile  # tiles begin at multiples
        return [Tiles(e, a, min(a + step, e[1])) for e in wanted for a in range(first, min(e[1], self.before), step)] or [Tiles(("", 0, 0, 1, 1), 0, 0)]

    def read(self, partition: Tiles) -> Iterator[tuple]:
        with open_file(self.path) as f:
            for a in range(partition.start, min(partition.stop, self.before), self.tile):
                yield partition.entry[0], a, fetch(f, partition.entry, a, min(a + self.tile, partition.stop))


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "contig string, tile_start long, seq string"

    def reader(self, schema) -> DataSourceReader:
        return FastaReader(self.options)


def read_fasta(spark: SparkSession, path: str, tile: int = TILE) -> DataFrame:
    """contig, tile_start, seq of an indexed FASTA file; filters on contig and bounds on tile_start prune the read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FastaSource)
    return spark.read.format("fasta").option("tile", tile).load(path)
