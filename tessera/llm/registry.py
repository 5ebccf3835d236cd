"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tessera.llm import exact_dedup, fingerprints, line_dedup, lm_score, packing, quality, sentencepieces, simhash, url_filter, warc

QUERIES = {
    "op1_simhash": simhash.query,
    "op2_packing": packing.query,
    "op3_line_dedup": line_dedup.query,
    "op4_fingerprints": fingerprints.query,
    "op5_warc": warc.query,
    "op6_lm_score": lm_score.query,
    "op7_url_filter": url_filter.query,
    "op8_quality": quality.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_sentencepiece": sentencepieces.query,
}
ORACLES = {"op5_warc": warc.ORACLE, "op7_url_filter": url_filter.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE}
