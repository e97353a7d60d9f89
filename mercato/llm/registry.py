"""Queries of the training-data operators and the SQL of those that SQL can express."""

from mercato.llm import ann, bpe, decontaminate, divergence, html_extract, license_scan, mix_sources, periodic_runs, quality, simhash, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_bpe": bpe.op13_bpe,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_mix_sources": mix_sources.op3_mix_sources,
    "op4_html_extract": html_extract.op4_html_extract,
    "op5_simhash_dedup": simhash.op5_simhash_dedup,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_quality": quality.op8_quality,
    "op9_ann": ann.op9_ann,
}
ORACLES = {
    "op12_source_divergence": divergence.SQL,
    "op2_license_scan": license_scan.SQL,
    "op6_url_filter": url_filter.SQL,
}
