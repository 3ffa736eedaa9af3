"""Queries of this subpackage and their SQL, where SQL can express them."""

from . import conversation_trie, fingerprints, language_id, mixing, ngram_join, packing, suffix_dedup, tiff, token_counts, toxicity, url_filter, vector_codes, warc

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_warc": warc.op2_warc,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_packing": packing.op5_packing,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_media_columns": tiff.op7_media_columns,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_mixing": mixing.op10_mixing,
    "op11_language_id": language_id.op11_language_id,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_conversation_trie": conversation_trie.op13_conversation_trie,
}
ORACLES = {
    "op2_warc": warc.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_conversation_trie": conversation_trie.ORACLE,
}
