"""python -m tessera ALIGNMENTS FASTA [OUT] [options]"""

import argparse

from pyspark.sql import SparkSession

from tessera.api import extract_batch, extract_methylation, summary_line
from tessera.sources.sinks import CODECS, HDF5_CODECS


def main() -> None:
    p = argparse.ArgumentParser(prog="tessera", description="Per-cell methylation counts from mC-to-T alignments.")
    p.add_argument("alignments", help="a file, or with --batch several, separated by commas")
    p.add_argument("fasta")
    p.add_argument("out", nargs="?", help="folder of the sites; may be left out with --stats")
    p.add_argument("--batch", action="store_true", help="run each of several files, to a folder of its own name in OUT")
    p.add_argument("-c", "--chroms", help="comma-separated contigs, in output order")
    p.add_argument("-w", "--whitelist")
    p.add_argument("--min-base-quality", type=int, default=20)
    p.add_argument("--min-mapq", type=int, default=0)
    p.add_argument("--max-depth", type=int, default=250)
    p.add_argument("--keep-orphans", action="store_true")
    p.add_argument("--overlap", choices=["best", "sum", "none"], default="best")
    p.add_argument("--shards", type=int, default=0, help="0: by the number of cells")
    p.add_argument("--codec", choices=sorted(CODECS), default="zstd")
    p.add_argument("--start", type=int)
    p.add_argument("--stop", type=int)
    p.add_argument("--baq", action="store_true", help="cap qualities by base alignment quality")
    p.add_argument("--stats", action="store_true", help="print the summary; write no sites, and nothing at all without OUT")
    p.add_argument("--append", action="store_true", help="add to the sites that OUT holds")
    p.add_argument("--dump-sites", metavar="FOLDER", help="write the sorted table of sites as TSV too")
    p.add_argument("--hdf5", metavar="FOLDER", help="write HDF5 shards and a master file too; needs h5py on the executors")
    p.add_argument("--hdf5-codec", choices=sorted(HDF5_CODECS), default="gzip")
    p.add_argument("--hdf5-version", default="", help="version of the layout for metadata/version")
    a = p.parse_args()
    if not a.out and not a.stats:
        p.error("OUT may be left out with --stats only")
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    options = {
        "chroms": a.chroms.split(",") if a.chroms else None, "whitelist": a.whitelist, "min_base_quality": a.min_base_quality, "min_mapq": a.min_mapq, "max_depth": a.max_depth or None,
        "ignore_orphans": not a.keep_orphans, "overlap": a.overlap, "n_shards": a.shards, "codec": a.codec, "start": a.start, "stop": a.stop, "baq": a.baq, "write": not a.stats,
        "dump_sites": a.dump_sites, "hdf5": a.hdf5, "hdf5_codec": a.hdf5_codec, "hdf5_version": a.hdf5_version, "mode": "append" if a.append else "overwrite",
    }
    if a.batch:
        if a.dump_sites or a.hdf5:
            p.error("--dump-sites and --hdf5 name one folder, so they don't go with --batch")
        for name, done in extract_batch(spark, a.alignments.split(","), a.fasta, a.out, **options).items():
            print(name, summary_line(done))
    else:
        print(summary_line(extract_methylation(spark, a.alignments, a.fasta, a.out, **options)))


if __name__ == "__main__":
    main()
