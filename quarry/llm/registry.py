"""The queries of this subpackage, by name, and the SQL of those that SQL can express on whole tables.

The others are tested against brute force in tests/llm.
"""

from __future__ import annotations

from quarry.llm import decontamination, filter_audit, fingerprints, harmonic, jaccard, language_id, packing, quality, secret_scans, token_counts, url_filters, warc, whitening

QUERIES = {
    f.__name__: f
    for f in (
        language_id.op1_language_id,
        quality.op2_quality_classifier,
        packing.op3_best_fit_packing,
        decontamination.op4_decontamination,
        token_counts.op5_token_counts,
        fingerprints.op6_fingerprints,
        jaccard.op7_ngram_jaccard,
        warc.op8_warc_revisits,
        url_filters.op9_url_filters,
        secret_scans.op10_secret_scans,
        filter_audit.op11_filter_interactions,
        harmonic.op12_harmonic_packing,
        whitening.op13_embedding_whitening,
    )
}

ORACLES = {
    "op4_decontamination": decontamination.ORACLE,
    "op7_ngram_jaccard": jaccard.ORACLE,
    "op8_warc_revisits": warc.ORACLE,
    "op9_url_filters": url_filters.ORACLE,
    "op11_filter_interactions": filter_audit.ORACLE,
}
