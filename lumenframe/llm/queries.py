"""The queries that apply this subpackage's operators to whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from lumenframe.llm import chunking, decontam, langid, neardup, packing, scoring, substrings, tokens, toxicity, warc

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_masked_pll": scoring.op2_masked_pll,
    "op3_retrieval_packing": packing.op3_retrieval_packing,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_warc": warc.op5_warc,
    "op6_lsi_decontam": decontam.op6_lsi_decontam,
    "op7_chunk_fingerprints": chunking.op7_chunk_fingerprints,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_icws_neardup": neardup.op9_icws_neardup,
    "op10_token_parquet": tokens.op10_token_parquet,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op4_substring_dedup": substrings.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
}
