"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from halyard.llm import bands, bpe, jaccard, language, negatives, neighbours, packing, pii, quotes, secrets, telephony, urls, warc

QUERIES = {
    "op1_url_markov_ratio": urls.op1_url_markov_ratio,
    "op2_set_relation_join": jaccard.op2_set_relation_join,
    "op3_collision_counting": neighbours.op3_collision_counting,
    "op4_vector_packing": packing.op4_vector_packing,
    "op5_quotation_linking": quotes.op5_quotation_linking,
    "op6_distinct_word_bpe": bpe.op6_distinct_word_bpe,
    "op7_warc_chunks": warc.op7_warc_chunks,
    "op8_telephony": telephony.op8_telephony,
    "op9_language_id": language.op9_language_id,
    "op10_information_theoretic_pii": pii.op10_information_theoretic_pii,
    "op11_anchored_secret_scan": secrets.op11_anchored_secret_scan,
    "op12_segment_tree_band_join": bands.op12_segment_tree_band_join,
    "op13_vantage_point_negatives": negatives.op13_vantage_point_negatives,
}

ORACLE_SQL = {"op1_url_markov_ratio": urls.SQL, "op5_quotation_linking": quotes.SQL, "op7_warc_chunks": warc.SQL, "op11_anchored_secret_scan": secrets.SQL, "op12_segment_tree_band_join": bands.SQL, "op13_vantage_point_negatives": negatives.SQL}
