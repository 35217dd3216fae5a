"""The queries of the training-data operators, and SQL for those that SQL can express."""

import corpus_pipeline

from . import decontaminate, license_scan, media_ogg, mixing, ngram_join, oracle, quality_crf, suffix_dedup, token_counts, toxicity_chain, warc

QUERIES = {
    "op1_ngram_jaccard": ngram_join.op1_ngram_jaccard,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_warc": warc.op3_warc,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_quality_crf": quality_crf.op6_quality_crf,
    "op7_toxicity_chain": toxicity_chain.op7_toxicity_chain,
    "op8_mixing": mixing.op8_mixing,
    "op9_media_ogg": media_ogg.op9_media_ogg,
    "op10_token_counts": token_counts.op10_token_counts,
}
SQL = {
    "op1_ngram_jaccard": oracle.OP1_SQL,
    "op2_license_scan": license_scan.OP2_SQL,
    "op3_warc": warc.OP3_SQL,
    "op4_decontamination": oracle.OP4_SQL,
    "op5_suffix_dedup": oracle.OP5_SQL,
    "op8_mixing": mixing.OP8_SQL,
}

if corpus_pipeline.STAGES:
    QUERIES["pipeline"] = corpus_pipeline.run
