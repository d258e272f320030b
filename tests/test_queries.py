import pytest

from tessera.plans import registry
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)


def test_capped_qualities_of_every_read(spark):
    found, reads = registry.QUERIES["baq_qualities"](spark, SF), registry._used(spark, SF)
    key = ["contig", "pos0", "flag", "qname"]
    assert found.count() == reads.count()
    both = found.withColumnRenamed("qual", "capped").join(reads.select(*key, "seq", "qual"), key)
    # No base rises, and random bases leave most with less; skips stay as they are.
    assert both.where("length(capped) <> length(qual)").count() == 0
    rows = both.limit(500).collect()
    assert any(r.capped != r.qual for r in rows) and all(a <= b for r in rows for a, b in zip(r.capped, r.qual, strict=True))
