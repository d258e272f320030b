import numpy as np
import pytest

from tessera.operators import baq

D, E = baq.OPEN, baq.EXTEND


def by_paths(ref, query, error):
    """Chances of each state of each base, from the sum over all paths one by one."""
    size, wide = len(query), len(ref) - len(query) + 1
    stop = 1 / (2 * size + 2)
    m, ins, total = np.zeros((size, wide)), np.zeros((size, wide)), 0.0

    def emit(i, k):
        if ref[k] == baq._OUTSIDE:
            return 0.0
        if ref[k] > 3 or query[i] > 3:
            return 1.0
        return 1 - error[i] if ref[k] == query[i] else error[i] / 3

    def walk(i, k, state, p, path):
        nonlocal total
        if not i <= k < i + wide or ref[k] == baq._OUTSIDE:
            return
        if state != "D":
            p *= emit(i, k) if state == "M" else 0.25
            path = [*path, (i, k - i, state)]
            if i == size - 1:
                total += p * stop
                for a, b, s in path:
                    (m if s == "M" else ins)[a, b] += p * stop
        nexts = {"M": (("M", (1 - 2 * D) * (1 - stop)), ("I", D * (1 - stop)), ("D", D * (1 - stop))), "I": (("M", (1 - E) * (1 - stop)), ("I", E * (1 - stop))), "D": (("M", 1 - E), ("D", E))}
        for s, t in nexts[state]:
            if s == "D":
                walk(i, k + 1, s, p * t, path)
            elif i < size - 1:
                walk(i + 1, k + (s == "M"), s, p * t, path)

    for b in range(wide):
        walk(0, b, "M", 1 - D, [])
        walk(0, b, "I", D, [])
    return m / total, ins / total


@pytest.mark.parametrize("seed", range(6))
def test_posterior_is_the_sum_over_paths(seed):
    rng = np.random.default_rng(seed)
    size, band = 4, 2
    ref, query = rng.integers(0, 5, (3, size + 2 * band)), rng.integers(0, 5, (3, size))
    ref[1, :2], ref[2, -3:] = baq._OUTSIDE, baq._OUTSIDE
    error = 10 ** (-rng.integers(2, 40, (3, size)) / 10)
    m, ins = baq.posterior(ref, query, error)
    for k in range(3):
        want = by_paths(ref[k], query[k], error[k])
        np.testing.assert_allclose(m[k], want[0], atol=1e-9)
        np.testing.assert_allclose(ins[k], want[1], atol=1e-9)


def test_qualities_fall_near_a_misplaced_gap_only(spark):
    rng = np.random.default_rng(5)
    ref = "".join(rng.choice(list("ACGT"), 300))
    tiles = spark.createDataFrame([("c", a, ref[a : a + 70]) for a in range(0, 300, 70)], "contig string, tile_start long, seq string")
    good, gapped = ref[60:110], ref[60:100] + ref[103:113]
    rows = [
        ("c", 60, "50M", "good", good, "I" * 50),
        ("c", 60, "50M", "wrong", gapped, "I" * 50),  # three deleted bases that the CIGAR does not know
        ("c", 60, "40M3D10M", "right", gapped, "I" * 50),
        ("c", 62, "2S48M", "clipped", "NN" + good[2:], "I" * 50),
        ("c", 0, "50M", "start", ref[:50], "I" * 50), ("c", 250, "50M", "end", ref[250:], "I" * 50),
        ("c", 60, "20M9N30M", "skip", good, "I" * 50), ("c", 60, "50M", "none", good, None), ("d", 60, "50M", "elsewhere", good, "I" * 50),
        (None, -1, "*", "unmapped", good, "I" * 50), ("c", 60, "49M", "unfit", good, "I" * 50), ("c", 60, None, "nothing", None, "I"),
    ]
    reads = spark.createDataFrame(rows, "contig string, pos0 long, cigar string, qname string, seq string, qual string")
    found = {r.qname: r.qual for sizes in ((64, 512), baq.SIZES) for r in baq.realign(reads, tiles, sizes).collect()}
    small = {r.qname: r.qual for r in baq.realign(reads, tiles, (128,)).collect()}
    assert found == small and len(found) == len(rows)
    for name in ("skip", "elsewhere", "unmapped", "unfit"):
        assert found[name] == "I" * 50
    assert found["none"] is None and found["nothing"] == "I"
    quality = {k: [ord(c) - 33 for c in v] for k, v in found.items() if v}
    for name in ("good", "start", "end"):
        assert min(quality[name][10:40]) == 40
    assert min(quality["right"][10:35]) == 40 and max(quality["right"]) == 40
    assert max(quality["wrong"][42:]) < 20 <= min(quality["wrong"][10:35])
    assert min(quality["clipped"][12:40]) == 40


def test_no_reads_and_no_reference(spark):
    reads = spark.createDataFrame([("c", 5, "4M", "ACGT", "IIII")], "contig string, pos0 long, cigar string, seq string, qual string")
    tiles = spark.createDataFrame([], "contig string, tile_start long, seq string")
    assert baq.realign(reads, tiles).collect() == reads.collect()
    assert baq.realign(reads.limit(0), tiles).count() == 0


def test_stretches_of_many_tiles(spark):
    """Gaps are N, of tiles that overlap the later one counts, and the work grows with the bases: in their square, this took minutes."""
    import time

    rng = np.random.default_rng(1)
    starts = np.cumsum(rng.choice([20, 32, 32, 32, 40], 40_000))
    genome = np.full(1 << 21, "N")
    tiles = [("c", int(a), "".join(rng.choice(list("ACGT"), 32))) for a in starts]
    for _, a, seq in tiles:
        genome[a : a + 32] = list(seq)
    # A later tile takes over from where it begins.
    df = spark.createDataFrame(tiles, "contig string, tile_start long, seq string").cache()
    df.count()
    began = time.time()
    found = baq.stretches(df, (1 << 20,)).collect()
    assert time.time() - began < 20
    assert len(found) == int(starts[-1] + 31 >> 20) + 1
    for r in found:
        bases = bytes(r["_bases"]).decode()
        assert bases == "".join(genome[r["_first"] : r["_first"] + len(bases)])
        assert r["_first"] + len(bases) == min(int(starts[-1]) + 32, (r["_bin"] + 2) << 20)
