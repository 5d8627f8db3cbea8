"""The queries of this subpackage and their SQL, by name."""

from . import bpe, dedup_exact, mixing, ngram_join, pii, quality_cnn, quality_mcd, suffix_dedup, token_counts, warc_zip

QUERIES = {
    "op1_warc_zip": warc_zip.op1_warc_zip,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_exact_dedup": dedup_exact.op3_exact_dedup,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_quality": quality_cnn.op6_quality,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_bpe_codec": bpe.op8_bpe_codec,
    "op9_quality_rules": quality_mcd.op9_quality_rules,
    "op10_pii": pii.op10_pii,
    # Parts of op4 and op9 that SQL can follow, where the method's own part is a search.
    "mix_targets": mixing.mix_targets,
    "quality_base": quality_mcd.quality_base,
}
ORACLE = {
    "op1_warc_zip": warc_zip.SQL,
    "op2_ngram_join": ngram_join.SQL,
    "op3_exact_dedup": dedup_exact.SQL,
    "op5_suffix_dedup": suffix_dedup.SQL,
    "op10_pii": pii.SQL,
    "mix_targets": mixing.TARGETS_SQL,
    "quality_base": quality_mcd.BASE_SQL,
}
