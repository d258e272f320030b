import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import calling, pileup, reference
from tessera.plans import bridge, registry

SF = "/root/testdata/sf0.001"
WITHIN_BINS = [
    "cell_summary",
    "flagship",
    "context_stats",
    "percentages",
    "window_counts",
    "cells_per_shard",
    "contig_breakdown",
    "distinct_cells",
    "whitelist_semi",
    "sorted_cell_dataset",
    "barcode_union",
    "site_dump",
    "depth_cap",
    "overlap_best",
    "overlap_sum",
    "site_differences",
]


#: Queries whose reads are made where their bin is.
READS_IN_PLACE = [
    "context_stats",
    "sorted_cell_dataset",
    "whitelist_semi",
    "cells_per_shard",
    "contig_breakdown",
    "distinct_cells",
    "flagship",
    "percentages",
    "window_counts",
]


@pytest.mark.parametrize("name", READS_IN_PLACE)
def test_no_read_is_shuffled(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    dealt = [re.findall(r"(\w+)#", columns) for columns in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)]
    assert any({"_bin", "l_orderkey"} <= set(columns) for columns in dealt), dealt
    assert not any({"_seq", "_qual", "ref_base"} & set(columns) or "l_orderkey" in columns and "_bin" not in columns for columns in dealt), dealt


@pytest.mark.parametrize("name", WITHIN_BINS)
def test_no_base_is_shuffled(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert any("_bin#" in by for by in dealt) and not any("pos0#" in by for by in dealt), dealt


def test_runs_beyond_their_bin(spark, monkeypatch):
    """Reads over many borders of bins, with skips, gaps and mates, against a walk base by base; any size of bin."""
    rng, genome = random.Random(3), {c: "".join(random.Random(c).choice("ACGT") for _ in range(400)) for c in ("a", "b")}
    rows = []
    for i in range(120):
        cigar = rng.choice([((40, "M"),), ((3, "S"), (30, "M")), ((9, "M"), (200, "N"), (9, "M")), ((10, "M"), (3, "D"), (2, "I"), (20, "M"))])
        size = sum(n for n, o in cigar if o in "MIS")
        seq, qual = "".join(rng.choice("ACGT") for _ in range(size)), "".join(chr(33 + rng.randrange(10, 41)) for _ in range(size))
        rows.append((rng.choice("ab"), rng.randrange(170), rng.choice((99, 147, 83, 163)), 30, "".join(f"{n}{o}" for n, o in cigar), f"c{i % 3}:{i // 2}", seq, qual, i))
    at = {}
    for contig, pos, flag, _, cigar, name, seq, qual, i in sorted(rows, key=lambda r: r[-1]):
        q, r = 0, pos
        for n, o in re.findall(r"(\d+)(.)", cigar):
            for _k in range(int(n)):
                if o == "M" and ord(qual[q]) - 33 >= 20:
                    at.setdefault((contig, r), []).append((name, ord(qual[q]) - 33, i, seq[q], flag))
                q, r = q + (o in "MIS"), r + (o in "MDN")
    kept = {}
    for key, bases in at.items():
        best = {}
        for b in bases[:3]:
            if b[0] not in best or b[1] > best[b[0]][1]:
                best[b[0]] = b
        kept[key] = best.values()
    count = lambda found: {(k, b[0].split(":")[0]) for k, bs in found.items() for b in bs if (genome[k[0]][k[1]], b[4] in (99, 147), b[3]) in {("C", True, "C"), ("C", True, "T"), ("G", False, "G"), ("G", False, "A")}}
    reads = spark.createDataFrame(rows, "contig string, pos0 long, flag int, mapq int, cigar string, qname string, seq string, qual string, rec_idx long")
    sites = reference.sites(spark.createDataFrame([(c, k, s[k : k + 50]) for c, s in genome.items() for k in range(0, 400, 50)], "contig string, tile_start long, seq string"))
    shown = lambda df: sorted(map(repr, df.collect()))
    seen = []
    for size in (7, 64, 512):
        monkeypatch.setattr(pileup, "BIN", size)
        run = lambda **rules: calling.site_counts(calling.calls(reads, sites, **rules))
        capped, free = run(max_depth=3), run(max_depth=None, overlap="none")
        assert {((r.chr, r.pos - 1), r.barcode) for r in capped.collect()} == count(kept)
        assert sum(r.t + r.c for r in free.collect()) >= len(count(at)) and {((r.chr, r.pos - 1), r.barcode) for r in free.collect()} == count(at)
        totals = pileup.explode_runs(pileup.numbered(reads, ("rec_idx",)), "_bin", "_rank", "_mate").where(F.col("bq") >= 20).groupBy("contig", "pos0").count()
        assert {(r.contig, r.pos0): r[2] for r in totals.collect()} == {k: len(v) for k, v in at.items()}
        seen.append((shown(capped), shown(free), shown(run(overlap="sum"))))
    assert seen[0] == seen[1] == seen[2] and len(seen[0][0]) > 50


@pytest.mark.parametrize("size", [7, 64, 512])
def test_reads_dealt_as_line_items(spark, monkeypatch, size):
    """The same runs in the same bins, each once, as from reads that are dealt themselves."""
    monkeypatch.setattr(pileup, "BIN", size)
    columns = ("flag", "mapq", "qname")
    used = lambda reads: pileup.in_bins(reads.where(scalars.strand(F.col("flag")).isNotNull()), *columns)
    found, want = used(bridge.reads_in_bins(spark, SF)), used(bridge.reads(spark, SF))
    assert found.columns == want.columns and want.count() > 10_000
    assert found.exceptAll(want).count() == 0 and want.exceptAll(found).count() == 0


def test_coded_tiles_hold_the_sites(spark):
    """Tiles of any size, with gaps, small letters, others than ACGT, a tile of one base and one twice."""
    rng = random.Random(5)
    text = {c: "".join(rng.choice("ACGTCGCGacgtN") if k % 97 else "R" for k in range(900)) for c in ("a", "b")}
    cuts = [0, 1, 3, 40, 41, 200, 260, 700, 900]
    rows = [(c, a, s[a:b]) for c, s in text.items() for a, b in zip(cuts, cuts[1:], strict=False) if a != 200]
    for tiles in (rows, rows + [rows[3]]):
        tiles = spark.createDataFrame(tiles, "contig string, tile_start long, seq string")
        for size in (7, 64, 512):
            strings = lambda sites: {(r.contig, r._bin): r._sites.rstrip(".") for r in reference.site_strings(sites, size, 4).collect() if r._sites.strip(".")}  # noqa: E731, B023
            found = strings(reference.coded(tiles))
            assert found == strings(reference.sites(tiles)) and len(found) > 2


#: Queries whose tasks get a bounded number of line items.
DEALT_BY_ITEMS = ["sorted_cell_dataset", "whitelist_semi", "flagship", "cells_per_shard", "distinct_cells", "percentages", "window_counts"]


@pytest.mark.parametrize("name", DEALT_BY_ITEMS)
def test_tasks_by_line_items(spark, monkeypatch, name):
    """6,000 line items over tasks of 100, with few shuffle partitions: reference and items are dealt alike, and the rows stay."""
    shown = lambda df: sorted(map(repr, df.collect()))
    want = shown(registry.QUERIES[name](spark, SF))
    monkeypatch.setattr(bridge, "ITEMS", 100)
    found = registry.QUERIES[name](spark, SF)
    dealt = re.findall(r"Exchange hashpartitioning\(contig#\w+, _bin#\w+, (\d+)\)", found._jdf.queryExecution().executedPlan().toString())
    assert dealt == ["60", "60"] and shown(found) == want


def test_cells_are_sorted_in_many_tasks(spark):
    plan = registry.QUERIES["sorted_cell_dataset"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\(barcode#\w+, context#\w+, (\d+)\)", plan) == [str(pileup.FAN * 4)]


def test_calls_are_not_dealt_for_the_whitelist(spark):
    plan = registry.QUERIES["whitelist_semi"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin \[barcode#\w+\], \[barcode#\w+\], LeftSemi", plan) and "SortMergeJoin" not in plan
