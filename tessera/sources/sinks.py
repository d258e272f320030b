"""Sinks: sharded Parquet with its index, a site table as TSV, per-cell coverage text, and HDF5 where h5py is installed."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars

#: Names of codecs and Parquet's own.
CODECS = {"none": "uncompressed", "gzip": "gzip", "zstd": "zstd", "lz4": "lz4_raw", "snappy": "snappy"}

#: Options of HDF5 datasets by codec. 32001 is the registered Blosc filter: four reserved values, level, shuffle, compressor.
HDF5_CODECS = {
    "none": {}, "lzf": {"compression": "lzf"}, "gzip": {"compression": "gzip", "compression_opts": 1}, "gzip6": {"compression": "gzip", "compression_opts": 6},
    "gzip-shuffle": {"compression": "gzip", "compression_opts": 1, "shuffle": True},
    "blosc": {"compression": 32001, "compression_opts": (0, 0, 0, 0, 1, 1, 1)}, "blosc-zstd": {"compression": 32001, "compression_opts": (0, 0, 0, 0, 1, 1, 5)},
}


def write_sites(counts: DataFrame, order: DataFrame, path: str, n_shards: int, codec: str = "zstd", mode: str = "overwrite") -> None:
    """Parquet by context and shard, sorted by barcode, contig list order and position within files, and the index beside it."""
    if codec not in CODECS:
        raise ValueError(f"unknown codec {codec!r}; known: {', '.join(CODECS)}")
    placed = counts.join(F.broadcast(order.select(F.col("contig").alias("chr"), "contig_ord")), "chr").withColumn("shard", scalars.shard(F.col("barcode"), n_shards))
    # By range, so that a shard is as many files as its size asks for, in order of their names, and not one task.
    keys = ["context", "shard", "barcode", "contig_ord", "pos"]
    dealt = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt.write.mode(mode).option("compression", CODECS[codec]).partitionBy("context", "shard").parquet(f"{path}/sites")
    index = counts.sparkSession.read.parquet(f"{path}/sites").select("barcode", "context", "shard").distinct()
    index.write.mode("overwrite").parquet(f"{path}/index")


def write_tsv(counts: DataFrame, path: str) -> None:
    """Sorted lines of barcode, ctx, chr, pos, t, c with a header."""
    rows = counts.select("barcode", F.col("context").alias("ctx"), "chr", "pos", "t", "c").orderBy("barcode", "ctx", "chr", "pos")
    rows.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_coverage(counts: DataFrame, path: str) -> None:
    """Lines of chr, pos, pct, t, c without a header in a folder for each context and barcode."""
    rows = counts.select("context", "barcode", "chr", "pos", "pct", "t", "c").repartition("context", "barcode").sortWithinPartitions("context", "barcode", "chr", "pos")
    rows.write.mode("overwrite").option("sep", "\t").partitionBy("context", "barcode").csv(path)


def write_hdf5(counts: DataFrame, order: DataFrame, path: str, version: str, n_shards: int = 1, codec: str = "gzip") -> None:
    """One HDF5 file for each shard with /CG and /CH groups of a dataset for each cell, and master.h5 that links to all cells.

    Needs h5py on the executors, and hdf5plugin for the Blosc codecs; path is a folder that all of them share.
    Shards without a cell are files too. version goes to metadata/version, by which readers of this layout tell it. Rows arrive sorted and are
    appended batch by batch, so a shard may be larger than memory; a file gets its name when it is whole."""
    fields = ["chr", "pos", "pct", "t", "c"]
    if codec not in HDF5_CODECS:
        raise ValueError(f"unknown codec {codec!r}; known: {', '.join(HDF5_CODECS)}")
    packing = HDF5_CODECS[codec]

    def library():
        import h5py

        if packing.get("compression") == 32001:
            import hdf5plugin  # noqa: F401
        return h5py

    def write(batches):
        import os

        import numpy as np

        h5py = library()
        os.makedirs(path, exist_ok=True)
        kinds = np.dtype(list(zip(fields, ["S10", "<i8", "<f8", "<i8", "<i8"], strict=True)))
        shard, f, name, part = None, None, "", ""

        def finish():
            f.close()
            os.replace(part, name)
            return pa.RecordBatch.from_pydict({"file": [name]})

        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("shard", "context", "barcode")), strict=True))
            if any(len(x.encode()) > 10 for x in b.column("chr").unique().to_pylist()):
                raise ValueError("a contig's name has more than 10 bytes")
            columns = [np.array([x.encode() for x in b.column("chr").to_pylist()], "S10"), *(b.column(c).to_numpy() for c in fields[1:])]
            at = 0
            while at < len(keys):
                key, end = keys[at], at + 1
                while end < len(keys) and keys[end] == key:
                    end += 1
                if key[0] != shard:
                    if f:
                        yield finish()
                    shard, name = key[0], f"{path}/shard_{key[0]:03d}.h5"
                    part = f"{name}.{uuid.uuid4().hex}"
                    f = h5py.File(part, "w")
                    f.create_group("metadata")["version"] = version
                rows = np.zeros(end - at, kinds)
                for field, column in zip(fields, columns, strict=True):
                    rows[field] = column[at:end]
                cell = f"{key[1]}/{key[2]}/1"
                if cell in f:
                    held = f[cell]
                    held.resize((len(held) + len(rows),))
                    held[-len(rows) :] = rows
                else:
                    f.create_dataset(cell, data=rows, maxshape=(None,), chunks=(min(max(len(rows), 1024), 65536),), **packing)
                at = end
        if f:
            yield finish()

    placed = counts.join(F.broadcast(order.select(F.col("contig").alias("chr"), "contig_ord")), "chr").withColumn("shard", scalars.shard(F.col("barcode"), n_shards))
    dealt = placed.repartition(n_shards, "shard").sortWithinPartitions("shard", "context", "barcode", "contig_ord", "pos")
    dealt.select("shard", "context", "barcode", *fields).mapInArrow(write, "file string").collect()  # a name for each shard

    def link(batches):
        import os

        h5py = library()
        os.makedirs(path, exist_ok=True)
        name = f"{path}/master.h5"
        part = f"{name}.{uuid.uuid4().hex}"
        f = h5py.File(part, "w")
        f.create_group("metadata")["version"] = version
        for b in batches:
            for context, cell, shard in zip(*(b.column(c).to_pylist() for c in ("context", "barcode", "shard")), strict=True):
                f[f"{context}/{cell}"] = h5py.ExternalLink(f"shard_{shard:03d}.h5", f"{context}/{cell}")
        f.close()
        os.replace(part, name)
        for shard in range(n_shards):
            if not os.path.exists(f"{path}/shard_{shard:03d}.h5"):
                empty = h5py.File(f"{path}/shard_{shard:03d}.h5", "w")
                empty.create_group("metadata")["version"] = version
                empty.close()
        yield pa.RecordBatch.from_pydict({"file": [name]})

    # One file, so one task; it takes a short row for each cell, batch by batch.
    cells = placed.select("context", "barcode", "shard").distinct().repartition(1).sortWithinPartitions("context", "barcode")
    cells.mapInArrow(link, "file string").collect()
