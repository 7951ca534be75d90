"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from kinmap.llm import divergence, fingerprints, jaccard, language, licenses, mixing, negatives, oracles, packing, pages, scoring, suffixes, token_counts, vectors

QUERIES = {
    f.__name__: f
    for f in (
        fingerprints.op1_document_fingerprints,
        packing.op2_best_fit_packing,
        suffixes.op3_suffix_array_dedup,
        language.op4_language_id,
        jaccard.op5_ngram_jaccard_join,
        mixing.op6_mixing_sources,
        vectors.op7_embedding_near_dedup,
        scoring.op8_lm_scoring,
        licenses.op9_license_scans,
        token_counts.op10_token_counts,
        negatives.op11_hard_negatives,
        divergence.op12_source_divergence,
        pages.op13_html_extraction,
    )
}

ORACLES = {
    "op1_document_fingerprints": oracles.fingerprint_sql(),
    "op3_suffix_array_dedup": oracles.DEDUP,
    "op5_ngram_jaccard_join": oracles.JACCARD,
    "op6_mixing_sources": mixing.ORACLE,
    "op7_embedding_near_dedup": vectors.ORACLE,
    "op9_license_scans": licenses.oracle(),
    "op11_hard_negatives": negatives.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
}
