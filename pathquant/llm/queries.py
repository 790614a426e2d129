"""The queries of this subpackage and, where SQL can express them, their SQL."""

from pathquant.llm import decontamination, hamming, html_text, jaccard, langid, mixing, packing, periodic, sharding, token_counts, token_output, warc, whitening

QUERIES = {
    "op1_orc_token_ids": token_output.op1_orc_token_ids,
    "op2_tag_path_ratios": html_text.op2_tag_path_ratios,
    "op3_offset_attribution": token_counts.op3_offset_attribution,
    "op4_weighted_fair_queueing": mixing.op4_weighted_fair_queueing,
    "op5_histogram_sort": sharding.op5_histogram_sort,
    "op6_bitmap_tile_join": jaccard.op6_bitmap_tile_join,
    "op7_minhash_containment": decontamination.op7_minhash_containment,
    "op8_multi_index_hashing": hamming.op8_multi_index_hashing,
    "op9_segmentation_marginalised_unigrams": langid.op9_segmentation_marginalised_unigrams,
    "op10_gzip_normaliser": warc.op10_gzip_normaliser,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_best_fit_packing": packing.op13_best_fit_packing,
}
ORACLE = {
    "op4_weighted_fair_queueing": mixing.ORACLE,
    "op5_histogram_sort": sharding.ORACLE,
    "op6_bitmap_tile_join": jaccard.ORACLE,
    "op7_minhash_containment": decontamination.ORACLE,
    "op8_multi_index_hashing": hamming.ORACLE,
    "op10_gzip_normaliser": warc.ORACLE,
}
