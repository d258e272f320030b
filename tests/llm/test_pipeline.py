import corpus_pipeline
from tests.llm.test_operators import SPACE, brute_components, shingle_set

SF = "/root/testdata/sf0.001"


def test_stages_do_what_their_operators_decide(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    bench = [shingle_set(r.text) for r in spark.read.parquet(SF + "/benchmark.parquet").collect()]
    seen = {"documents": {r.doc_id: r.text for r in docs.collect()}}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(SF + "/labels.parquet").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, SF).cache()
        if name == "quality":
            kept = {r.doc_id for r in out.collect()}
            assert kept < set(seen["documents"]) and sum((d in kept) == bool(y) for d, y in labels.items()) / len(labels) > 0.9
        elif name == "line_dedup":
            assert out.count() == before.count() and all(r.n_chars == len(r.text) for r in out.collect())
        elif name == "ngram_join":
            up = brute_components([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in out.collect()} == {d for d, c in up.items() if d == c}
        elif name == "decontamination":
            hit = {r.doc_id for r in before.collect() if any(4 * len(b & shingle_set(r.text)) >= 3 * len(b) for b in bench)}
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in before.collect()} - hit and hit
        else:
            assert out.count() == before.count()
            assert all(r.n_pieces == len(r.pieces) > 0 for r in out.collect() if SPACE.search({x.doc_id: x.text for x in before.collect()}[r.doc_id]))
            continue
        assert out.columns == docs.columns
        before = out
    assert corpus_pipeline.run(spark, SF).count() == before.count()
