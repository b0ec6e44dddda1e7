"""Queries of the training-data operators, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from quillmark.llm import ann, bpe, exact_dedup, language_id, minhash, packing, sharding, token_counts, url_filter, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_ann": ann.op2_ann,
    "op3_language_id": language_id.op3_language_id,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_packing": packing.op5_packing,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_warc": warc.op7_warc,
    "op8_near_dedup": minhash.op8_near_dedup,
    "op9_bpe": bpe.op9_bpe,
    "op10_sharding": sharding.op10_sharding,
}
ORACLE_SQL = {"op1_exact_dedup": exact_dedup.SQL, "op7_warc": warc.SQL, "op8_near_dedup": minhash.SQL}
