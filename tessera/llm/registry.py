"""The operators' queries by name, and DuckDB SQL for those that SQL can express."""

from tessera.llm import decontaminate, fingerprints, line_dedup, ngram_join, pieces, pii, quality, sharding, substring_dedup, warc

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_hypergeometric_sharding": sharding.op4_hypergeometric_sharding,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_warc_dictionary": warc.op6_warc_dictionary,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_pii_bootstrap": pii.op9_pii_bootstrap,
    "op10_merkle_fingerprints": fingerprints.op10_merkle_fingerprints,
}
ORACLES = {
    "op1_ngram_jaccard_join": ngram_join.ORACLE_SQL,
    "op5_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op6_warc_dictionary": warc.ORACLE_SQL,
    "op7_line_dedup": line_dedup.ORACLE_SQL,
    "op8_substring_dedup": substring_dedup.ORACLE_SQL,
}
