"""The registered queries of this subpackage: name -> function, and their SQL."""

from __future__ import annotations

from . import bagminhash, bpe, centroids, chat, decontam, fim, fingerprint, packing, pii, prefix_counts, toxicity, warc, wavelet

QUERIES = {
    "op1_nnpu_toxicity": toxicity.op1_nnpu_toxicity,
    "op2_bpe_round_trip": bpe.op2_bpe_round_trip,
    "op3_oph_fingerprint": fingerprint.op3_oph_fingerprint,
    "op4_perspective_rotation": chat.op4_perspective_rotation,
    "op5_wavelet_token_files": wavelet.op5_wavelet_token_files,
    "op6_template_decontamination": decontam.op6_template_decontamination,
    "op7_minhash_near_dedup": bagminhash.op7_minhash_near_dedup,
    "op8_warc_capture_index": warc.op8_warc_capture_index,
    "op9_pii_spans": pii.op9_pii_spans,
    "op10_token_counts": prefix_counts.op10_token_counts,
    "op11_best_fit_packing": packing.op11_best_fit_packing,
    "op12_heap_bound_clusters": centroids.op12_heap_bound_clusters,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}

ORACLES = {
    "op4_perspective_rotation": chat.ORACLE_SQL,
    "op8_warc_capture_index": warc.ORACLE_SQL,
    "op12_heap_bound_clusters": centroids.ORACLE_SQL,
    "op13_fill_in_middle": fim.ORACLE_SQL,
}
