import gzip
import random
import struct
import zlib

import pytest

from tessera import api
from tessera.functions import scalars
from tessera.operators import calling, pileup, reference
from tessera.sources import bam, sinks, text
from tessera.streaming import sites as streaming
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThanOrEqual, In, LessThan

REF = "ACGTACGTACGGGGAAAAAT"
# qname flag contig pos mapq cigar seq qual
SAM = [
    ("c1:1", 99, "chrT", 1, 30, "10M", "ATGTATGTAC", "IIIIIIIIII"),
    ("c1:1", 147, "chrT", 5, 30, "8M", "ACGTACGG", "55555555"),
    ("c2/7", 83, "chrT", 2, 30, "2S6M", "TTCATACA", "IIIIIIII"),
    ("c3", 99, "chrT", 1, 5, "3M2D3M1I1M", "ACGTACTG", "IIIIIIII"),
    ("c4:x", 99, "chrT", 1, 60, "4M5N3M", "ACGTCGG", "I4IIIII"),
    ("c5:x", 1123, "chrT", 1, 60, "4M", "ACGT", "IIII"),
    ("c6:x", 99, "chrU", 1, 60, "4M", "ACGT", "*"),
]


def bgzf(data, step=64):
    out = b""
    for i in [*range(0, len(data), step), None]:
        c = zlib.compressobj(wbits=-15)
        part = b"" if i is None else data[i : i + step]
        body = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04" + b"\0" * 6 + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def bam_bytes():
    names = [("chrT", 20), ("chrU", 12)]
    out = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(names))
    for n, k in names:
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k)
    for q, flag, contig, pos, mapq, cigar, seq, qual in SAM:
        import re

        ops = [int(n) << 4 | bam.OPERATIONS.index(o) for n, o in re.findall(r"(\d+)(.)", cigar)]
        codes = [bam.BASES.index(b) for b in seq] + [0]
        packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
        quals = b"\xff" * len(seq) if qual == "*" else bytes(ord(x) - 33 for x in qual)
        body = struct.pack("<iiBBHHHiiii", [n for n, _ in names].index(contig), pos - 1, len(q) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + q.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + quals
        out += struct.pack("<i", len(body)) + body
    return bgzf(out)


@pytest.fixture()
def files(tmp_path):
    (tmp_path / "x.bam").write_bytes(bam_bytes())
    lines = ["@HD\tVN:1.6"] + ["\t".join([q, str(f), c, str(p), str(m), g, "*", "0", "0", s, u]) for q, f, c, p, m, g, s, u in SAM]
    (tmp_path / "x.sam").write_text("\n".join(lines) + "\n")
    (tmp_path / "x.fa").write_text(">chrT\nACGTACGTAC\nGGGGAAAAAT\n>chrU\nacgtnCGNac\ngt\n")
    (tmp_path / "x.fa.fai").write_text("chrT\t20\t6\t10\t11\nchrU\t12\t34\t10\t11\nshort\t1\n")
    with gzip.open(tmp_path / "wl.txt.gz", "wt") as f:
        f.write("# cells\n\nc1 extra\n  c2\tx y\nc4\n")
    return tmp_path


def test_bam_equals_sam(spark, files):
    a = bam.read_bam(spark, str(files / "x.bam"))
    b = text.read_sam(spark, str(files / "x.sam"))
    names = [c for c in a.columns if c != "rec_idx"]
    assert sorted(map(repr, a.select(names).collect())) == sorted(map(repr, b.select(names).collect()))
    assert [r.qname for r in a.orderBy("rec_idx").collect()] == [r[0] for r in SAM]
    assert {r.contig: r.mapped for r in bam.mapped_counts(a).collect()} == {"chrT": 6, "chrU": 1}
    assert [tuple(r) for r in bam.bam_contigs(spark, str(files / "x.bam")).collect()] == [("chrT", 0, 20), ("chrU", 1, 12)]


def test_fasta_and_whitelist(spark, files):
    entry = text.fasta_index(str(files / "x.fa"))[0]
    with open(files / "x.fa", "rb") as f:
        assert [text.fetch(f, entry, *x) for x in ((0, 4), (8, 12), (-3, 2), (18, 99), (20, 30))] == ["ACGT", "ACGG", "AC", "AT", ""]
    tiles = text.read_fasta(spark, str(files / "x.fa"), tile=7).orderBy("contig", "tile_start").collect()
    assert "".join(r.seq for r in tiles if r.contig == "chrT") == REF
    assert {r.barcode for r in text.read_whitelist(spark, str(files / "wl.txt.gz")).collect()} == {"c1", "c2", "c4"}


@pytest.mark.parametrize("tile", [3, 7, 100])
def test_sites_do_not_depend_on_tiles(spark, files, tile):
    found = {(r.contig, r.pos0): r.tri for r in reference.sites(text.read_fasta(spark, str(files / "x.fa"), tile=tile)).collect()}
    assert found["chrT", 1] == found["chrT", 2] == "CpG"
    assert found["chrT", 10] == "CpG" and found["chrT", 11] == "CHG" and found["chrT", 12] == "CHH"
    assert found["chrU", 5] == "CpG" and found["chrU", 9] == "CpG"


def test_context_vectors(spark):
    want = {("CGA", 0): "CpG", ("CAG", 0): "CHG", ("CTA", 0): "CHH", ("CCC", 0): "CHH", ("TCG", 2): "CpG", ("CTG", 2): "CHG", ("TAG", 2): "CHH", ("C", 0): "CHH", ("G", 0): "CHH", ("A", 0): None, ("CGA", 5): None, ("CGA", -1): None}
    rows = spark.createDataFrame([(s, p) for s, p in want], "s string, p int").select("s", "p", scalars.trinucleotide_at(F.col("s"), F.col("p")).alias("x")).collect()
    assert {(r.s, r.p): r.x for r in rows} == want


def test_flags_calls_barcodes_shards(spark):
    flags = spark.createDataFrame([(f,) for f in (99, 147, 83, 163, 0, 16, 4, 355, 2048, 77, 141, 65, 129, 113, 177)], "f int")
    assert [r[0] for r in flags.select(scalars.strand(F.col("f"))).collect()] == ["OT", "OT", "OB", "OB"] + [None] * 11
    calls = {("OT", "C", "T"): 1, ("OT", "C", "C"): 0, ("OT", "C", "A"): None, ("OT", "G", "A"): None, ("OB", "G", "A"): 1, ("OB", "G", "G"): 0, ("OB", "G", "T"): None, ("OB", "C", "T"): None, ("OT", "c", "t"): 1}
    got = spark.createDataFrame(list(calls), "s string, r string, b string").select(scalars.call(F.col("s"), F.col("r"), F.col("b"))).collect()
    assert [r[0] for r in got] == list(calls.values())
    names = {"ACGT:123#0": "ACGT", "BC123/1": "BC123", "BC123": "BC123", ":x": "", "a/b:c": "a/b"}
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "q string").select(scalars.barcode(F.col("q"))).collect()] == list(names.values())
    b = spark.createDataFrame([("cellA", "x", "anything")], "a string, b string, c string")
    assert tuple(b.select(scalars.shard(F.col("a"), 16), scalars.shard(F.col("b"), 8), scalars.shard(F.col("c"), 1)).head()) == (7, 6, 0)
    scalars.register_sql(spark)
    rows = spark.createDataFrame([("ACGNCAGCATTCG", p, b, n) for p in range(-1, 14) for b, n in (("cellA", 16), ("x", 8), ("b", 1))], "s string, p int, b string, n int")
    got = rows.select(F.expr("trinucleotide_of(s, p)"), scalars.trinucleotide_at(F.col("s"), F.col("p")), F.expr("shard_of(b, n)"), "b", "p").collect()
    assert all(r[0] == r[1] and r[2] == {"cellA": 7, "x": 6, "b": 0}[r.b] for r in got) and {r[0] for r in got} == {"CpG", "CHG", "CHH", None}
    assert tuple(spark.sql("SELECT strand_of(99), call_of('OT', 'C', 'T'), context_of('CHG'), barcode_of('a/b'), percent_of(1, 3), percent_of(0, 0)").head()) == ("OT", 1, "CH", "a", 25.0, 0.0)


def test_expansion_overlap_and_depth(spark, files):
    reads = text.read_sam(spark, str(files / "x.sam"))
    bases = pileup.expand(reads, "qname", "flag", "rec_idx")
    at = {(r.qname, r.flag, r.pos0): (r.read_base, r.bq) for r in bases.collect()}
    assert [p for q, f, p in sorted(at) if q == "c3"] == [0, 1, 2, 5, 6, 7, 8]
    assert at["c3", 99, 5] == ("T", 40) and at["c3", 99, 8] == ("G", 40)
    assert [p for q, f, p in sorted(at) if q == "c2/7"] == [1, 2, 3, 4, 5, 6] and at["c2/7", 83, 1] == ("C", 40)
    assert [p for q, f, p in sorted(at) if q == "c4:x"] == [0, 1, 2, 3, 9, 10, 11] and at["c6:x", 99, 0][1] == 0
    best = {(r.qname, r.pos0): (r.read_base, r.bq) for r in pileup.clip_overlap(bases, "best", "rec_idx").collect()}
    assert best["c1:1", 5] == ("T", 40) and best["c1:1", 4] == ("A", 40)
    total = {(r.qname, r.pos0): (r.read_base, r.bq) for r in pileup.clip_overlap(bases, "sum", "rec_idx").collect()}
    assert total["c1:1", 4] == ("A", 60) and total["c1:1", 5] == ("T", 32)
    for depth in (1, 2):
        most = pileup.cap_depth(bases, depth, "rec_idx").groupBy("contig", "pos0").count().agg(F.max("count")).head()[0]
        assert most == depth


@pytest.mark.parametrize("source", ["x.bam", "x.sam"])
def test_extraction(spark, files, source):
    out = str(files / "out")
    done = api.extract_methylation(spark, str(files / source), str(files / "x.fa"), out, ["chrU", "chrT", "chrT", "none"], str(files / "wl.txt.gz"), n_shards=3)
    assert done["contigs"] == ["chrU", "chrT"] and done["cells"] == 3 and done["shards"] == 3
    sites = spark.read.parquet(out + "/sites")
    assert sites.groupBy("barcode", "context", "chr", "pos").count().where("count > 1").count() == 0
    got = {(r.barcode, r.pos): (r.t, r.c) for r in sites.collect()}
    # c4's second base has quality 19 and doesn't count; c1's mates count once where they overlap.
    assert got["c1", 2] == (0, 1) and got["c1", 6] == (0, 1) and ("c4", 2) not in got and got["c4", 10] == (1, 0)
    assert done["contexts"]["Pooled"]["c"] == sum(c for _, c in got.values())
    assert spark.read.parquet(out + "/index").count() == sites.select("barcode", "context", "shard").distinct().count()
    assert "cells=3" in api.summary_line(done)
    sinks.write_tsv(sites, out + "/tsv")
    assert spark.read.option("header", True).option("sep", "\t").csv(out + "/tsv").count() == sites.count()
    with pytest.raises(ValueError):
        sinks.write_sites(sites, sites, out, 1, "nothing")


def test_statistics_only_with_capped_qualities(spark, files):
    out = str(files / "stats")
    plain = api.extract_methylation(spark, str(files / "x.bam"), str(files / "x.fa"), out, ["chrT", "chrU"], max_depth=None, write=False, dump_sites=out + "/tsv")
    assert plain["reads"] == 6 and plain["reads_per_second"] > 0 and not (files / "stats" / "sites").exists()
    assert spark.read.option("header", True).option("sep", "\t").csv(out + "/tsv").count() == spark.read.parquet(out + "/counts").count() > 0
    capped = api.extract_methylation(spark, str(files / "x.bam"), str(files / "x.fa"), out, ["chrT", "chrU"], max_depth=None, write=False, baq=True)
    total = lambda d: d["contexts"]["Pooled"]["c"] + d["contexts"]["Pooled"]["t"]
    assert capped["reads"] == 6 and 0 <= total(capped) <= total(plain)


def large_bam(path, seed=4):
    """Three contigs of reads of many lengths and skips, with the linear index of a .bai beside them, and unplaced reads at the end."""
    rng, names = random.Random(seed), [("chr1", 200_000), ("chr2", 150_000), ("chr3", 90_000), ("chr4", 10)]
    records, spans = [], []
    for ref in range(3):
        for pos in sorted(rng.randrange(names[ref][1] - 40_000) for _ in range(700)):
            size, skip = rng.choice([0, 1, 7, 50, 75]), rng.choice([0, 0, 0, 300, 30_000])
            ops = [size << 4] if size < 50 or not skip else [20 << 4, skip << 4 | 3, (size - 20) << 4]
            spans.append((ref, pos, pos + size + (skip if len(ops) == 3 else 0)))
            records.append((ref, pos, ops if size else [], size))
    records += [(-1, -1, [], 9)] * 5
    head = b"BAM\1" + struct.pack("<ii", 0, len(names)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in names)
    raw = []
    for i, (ref, pos, ops, size) in enumerate(records):
        q, quals = f"BC{i % 9}:{i}", b"\xff" * size if i % 5 == 0 else bytes(rng.randrange(41) for _ in range(size))
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(q) + 1, i % 61, 0, len(ops), 99, size, -1, -1, 0) + q.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops)
        body += bytes(rng.choice((1, 2, 4, 8, 15)) << 4 | rng.choice((1, 2, 4, 8)) for _ in range((size + 1) // 2)) + quals + b"XXZtag\0"
        raw.append(struct.pack("<i", len(body)) + body)
    data, step = head + b"".join(raw), 700
    packed, at = [bgzf(data[i : i + step], step)[:-28] for i in range(0, len(data), step)], 0
    starts = [0]
    for p in packed:
        starts.append(starts[-1] + len(p))
    path.write_bytes(b"".join(packed) + bgzf(b""))
    at, index = len(head), [dict() for _ in names]
    for (ref, pos, stop), r in zip(spans, raw, strict=False):
        for w in range(pos >> 14, (max(stop, pos + 1) - 1 >> 14) + 1):
            index[ref].setdefault(w, starts[at // step] << 16 | at % step)
        at += len(r)
    bai = b"BAI\1" + struct.pack("<i", len(names))
    for of in index:
        n = max(of, default=-1) + 1
        bai += struct.pack("<ii", 0, n) + struct.pack(f"<{n}Q", *(of.get(w, 0) for w in range(n)))
    (path.parent / (path.name + ".bai")).write_bytes(bai)
    return spans


def test_reads_are_pruned_and_whole(spark, tmp_path):
    spans = large_bam(tmp_path / "l.bam")
    at = str(tmp_path / "l.bam")
    whole = bam.read_bam(spark, at)
    rows = whole.orderBy("rec_idx").collect()
    assert len(rows) == len(spans) + 5 and [(r.contig, r.pos0) for r in rows[:-5]] == [(f"chr{ref + 1}", pos) for ref, pos, _ in spans] and rows[-1].contig is None
    assert [r.qname for r in rows] == [f"BC{i % 9}:{i}" for i in range(len(rows))] and [r.mapq for r in rows] == [i % 61 for i in range(len(rows))]
    assert all((len(r.seq) == len(r.qual)) if r.qual else r.seq == "*" or i % 5 == 0 for i, r in enumerate(rows))
    every = len(bam.BamReader(at).partitions())
    shown = lambda df: sorted(map(repr, df.collect()))
    for condition, most in (("contig = 'chr2'", 0.4), ("contig IN ('chr1', 'chr3')", 0.75), ("contig IN ('chr3', 'none') AND pos0 >= 20000", 0.2), ("contig = 'chr1' AND pos0 < 20000", 0.2), ("contig = 'chr1' AND pos0 > 20000 AND pos0 <= 40000", 0.25), ("contig = 'chr4'", 0.1), ("contig = 'chr1' AND pos0 = 1", 0.2)):
        pruned = whole.where(condition)
        assert shown(pruned) == sorted(repr(r) for r in spark.createDataFrame(rows, whole.schema).where(condition).collect())
        assert pruned.rdd.getNumPartitions() <= max(1, most * every), condition
    for region in (("chr1", 0, 16_000), ("chr2", 50_000, 50_001), ("chr3", 30_000, 90_000), ("chr1", 199_000, 200_000), ("chr4", 0, 5), ("none", 0, 5)):
        got = bam.read_bam(spark, at, region)
        assert shown(got) == shown(pileup.overlapping(spark.createDataFrame(rows, whole.schema), *region)), region
        assert got.rdd.getNumPartitions() <= max(1, 0.5 * every)
    want = {(ref, pos) for ref, pos, stop in spans if ref == 1 and pos < 60_000 and stop > 55_000}
    assert {(1, r.pos0) for r in bam.read_bam(spark, at, ("chr2", 55_000, 60_000)).collect()} == want
    (tmp_path / "l.bam.bai").unlink()
    assert shown(bam.read_bam(spark, at, ("chr2", 55_000, 60_000))) == shown(whole.where("contig = 'chr2'").where("pos0 < 60000").transform(lambda d: pileup.overlapping(d, "chr2", 55_000, 60_000)))


def test_sequence_is_read_where_it_is_asked_for(spark, files):
    tiles = text.read_fasta(spark, str(files / "x.fa"), tile=3)
    assert tiles.where("contig = 'chrT' AND tile_start >= 7 AND tile_start < 15").orderBy("tile_start").selectExpr("concat(tile_start, seq)").collect() == [("9CGG",), ("12GGA",)]
    options = {"path": str(files / "x.fa"), "tile": "3", "part": "6"}
    reader = text.FastaReader(options)
    every = len(reader.partitions())
    list(reader.pushFilters([In(("contig",), ("chrU",)), GreaterThanOrEqual(("tile_start",), 6), LessThan(("tile_start",), 9)]))
    assert every == 6 and [(x.entry[0], x.start) for x in reader.partitions()] == [("chrU", 6)]


def test_region_reads_a_part_and_gives_the_same_sites(spark, files):
    run = lambda source, **more: api.extract_methylation(spark, str(files / source), str(files / "x.fa"), str(files / "r"), ["chrT"], max_depth=None, **more)
    run("x.bam")
    every = {(r.barcode, r.pos, r.t, r.c) for r in spark.read.parquet(str(files / "r/sites")).collect()}
    for source in ("x.bam", "x.sam"):
        for a, b in ((0, 4), (4, 10), (9, 12)):
            run(source, start=a, stop=b)
            assert {(r.barcode, r.pos, r.t, r.c) for r in spark.read.parquet(str(files / "r/counts")).collect()} == {x for x in every if a < x[1] <= b}


def test_summary_without_output(spark, files):
    before = sorted(p.name for p in files.iterdir())
    full = api.extract_methylation(spark, str(files / "x.bam"), str(files / "x.fa"), str(files / "full"), ["chrT", "chrU"])
    only = api.extract_methylation(spark, str(files / "x.bam"), str(files / "x.fa"), None, ["chrT", "chrU"])
    assert only["contexts"] == full["contexts"] and only["cells"] == full["cells"] and only["peak_memory_mb"] > 0
    assert sorted(p.name for p in files.iterdir()) == sorted([*before, "full"])
    part = api.extract_methylation(spark, str(files / "x.bam"), str(files / "x.fa"), None, ["chrT"], start=0, stop=6, dump_sites=str(files / "dump"))
    rows = spark.read.option("header", True).option("sep", "\t").csv(str(files / "dump"))
    assert rows.count() == rows.where("pos BETWEEN 1 AND 6").count() > 0 and part["contexts"]["Pooled"]["t"] == rows.selectExpr("cast(sum(t) as int)").head()[0]


def test_appending_and_batches(spark, files):
    out = str(files / "app")
    run = lambda contig, mode: api.extract_methylation(spark, str(files / "x.bam"), str(files / "x.fa"), out, [contig], mode=mode, min_base_quality=0)
    run("chrT", "overwrite")
    first = spark.read.parquet(out + "/sites").count()
    run("chrU", "append")
    sites = spark.read.parquet(out + "/sites")
    assert first and sites.count() == first + sites.where("chr = 'chrU'").count() > first
    assert {tuple(r) for r in spark.read.parquet(out + "/index").select("barcode", "context").collect()} == {tuple(r) for r in sites.select("barcode", "context").collect()}
    both = api.extract_batch(spark, [str(files / "x.bam"), str(files / "x.sam").replace("x.sam", "y.sam")] if (files / "y.sam").write_text((files / "x.sam").read_text()) else [], str(files / "x.fa"), str(files / "batch"), chroms=["chrT"])
    assert set(both) == {"x", "y"} and both["x"]["contexts"] == both["y"]["contexts"]
    a, b = (spark.read.parquet(str(files / "batch" / n / "counts")) for n in "xy")
    assert calling.site_differences(a, b).count() == 0 and calling.site_differences(a, b.where("pos <> 2")).count() == a.where("pos = 2").count() > 0
    with pytest.raises(ValueError):
        api.extract_batch(spark, [str(files / "x.bam"), str(files / "x.sam")], str(files / "x.fa"), out)


def test_coverage_text(spark, tmp_path):
    rows = [("b1", "CG", "chr1", 5, 50.0, 1, 1), ("b1", "CG", "chr1", 2, 0.0, 3, 0), ("b1", "CH", "chr1", 9, 100.0, 0, 2), ("b2", "CG", "chr2", 1, 0.0, 1, 0)]
    sinks.write_coverage(spark.createDataFrame(rows, "barcode string, context string, chr string, pos long, pct double, t long, c long"), str(tmp_path / "cov"))
    text_of = lambda context, cell: "".join(p.read_text() for p in sorted((tmp_path / "cov" / f"context={context}" / f"barcode={cell}").glob("*.csv")))
    assert text_of("CG", "b1") == "chr1\t2\t0.0\t3\t0\nchr1\t5\t50.0\t1\t1\n" and text_of("CH", "b1") == "chr1\t9\t100.0\t0\t2\n" and text_of("CG", "b2") == "chr2\t1\t0.0\t1\t0\n"


FAKE = """
import os, pickle
class Data:
    def __init__(self, rows): self.rows = rows
    def __len__(self): return len(self.rows)
    def resize(self, shape):
        import numpy as np
        self.rows = np.concatenate([self.rows, np.zeros(shape[0] - len(self.rows), self.rows.dtype)])
    def __setitem__(self, k, v): self.rows[k] = v
def ExternalLink(file, at): return (file, at)
class File(dict):
    def __init__(self, path, mode): self.path = path
    def create_group(self, name): return self.setdefault(name, {})
    def create_dataset(self, name, data, **more):
        assert more["maxshape"] == (None,)
        self[name] = Data(data)
    def close(self):
        with open(self.path, "wb") as f: pickle.dump({k: v.rows if isinstance(v, Data) else v for k, v in self.items()}, f)
"""


def test_hdf5_layout_in_small_batches(spark, tmp_path):
    """h5py is not installed here: a stand-in records what would be written."""
    import pickle

    (tmp_path / "h5py.py").write_text(FAKE)
    rows = [(f"b{i % 5}", "CG" if i % 3 else "CH", "chr2" if i % 2 else "chr10", 1000 - i, 50.0, 1, 1) for i in range(200)]
    counts = spark.createDataFrame(rows, "barcode string, context string, chr string, pos long, pct double, t long, c long")
    order = spark.createDataFrame([("chr2", 0), ("chr10", 1)], "contig string, contig_ord int")
    spark.sparkContext.addPyFile(str(tmp_path / "h5py.py"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        sinks.write_hdf5(counts, order, str(tmp_path / "new"), "v1", 16, "gzip-shuffle")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    files = [pickle.loads(p.read_bytes()) for p in sorted((tmp_path / "new").glob("shard_*.h5"))]
    assert len(files) == 16 and all(f.pop("metadata") == {"version": "v1"} for f in files) and {} in files
    master = pickle.loads((tmp_path / "new" / "master.h5").read_bytes())
    assert master.pop("metadata") == {"version": "v1"} and len(master) == len({(r[0], r[1]) for r in rows})
    for at, (name, inside) in master.items():
        assert at == inside and f"{at}/1" in pickle.loads((tmp_path / "new" / name).read_bytes())
    with pytest.raises(ValueError):
        sinks.write_hdf5(counts, order, str(tmp_path), "v1", codec="nothing")
    got = {k: v for f in files for k, v in f.items()}
    assert sum(map(len, got.values())) == 200 and set(got) == {f"{c}/{b}/1" for b, c in {(r[0], r[1]) for r in rows}}
    for v in got.values():
        assert v.dtype.names == ("chr", "pos", "pct", "t", "c")
        assert [tuple(x)[:2] for x in v] == sorted((tuple(x)[:2] for x in v), key=lambda x: (x[0] != b"chr2", x[1]))


def test_windows_orders_and_shard_numbers(spark):
    c = spark.createDataFrame([("chr1", 50), ("chrM", 5), ("chr2", 0)], "contig string, length long")
    order = reference.order_contigs(c)
    assert [tuple(r) for r in reference.plan_windows(order, 20).orderBy("chunk_id").collect()] == [(0, "chr1", 0, 20), (1, "chr1", 20, 40), (2, "chr1", 40, 50)]
    assert len(reference.CANONICAL) == 21 and "chrM" not in reference.CANONICAL
    assert [calling.resolve_shards(n) for n in (5000, 25_000, 75_000, 150_000)] == [1, 8, 16, 32] and calling.resolve_shards(5, 4) == 4


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", "chr1", 5, "CpG", 1), ("a", "chr1", 5, "CpG", 0), ("b", "chr1", 9, "CHH", 0)]
    spark.createDataFrame(rows, "barcode string, contig string, pos0 long, tri string, call int").repartition(3).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = streaming.running_counts(spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(repr, spark.table("live").collect())) == sorted(map(repr, calling.site_counts(batch).collect()))
