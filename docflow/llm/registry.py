"""All queries of this subpackage."""

from __future__ import annotations

from docflow.llm import q_collocations, q_decontamination, q_html_text, q_kdtree_clustering, q_license_scan, q_packing, q_quality_classifier, q_quality_rules, q_secret_scan, q_simhash, q_substring_dedup, q_topk_search, q_url_rules


def queries():
    return {
        "op1_quality_rules": q_quality_rules.op1_quality_rules,
        "op2_license_scan": q_license_scan.op2_license_scan,
        "op3_best_fit_packing": q_packing.op3_best_fit_packing,
        "op4_quality_classifier": q_quality_classifier.op4_quality_classifier,
        "op5_secret_scan": q_secret_scan.op5_secret_scan,
        "op6_url_filter": q_url_rules.op6_url_filter,
        "op7_substring_dedup": q_substring_dedup.op7_substring_dedup,
        "op8_html_extraction": q_html_text.op8_html_extraction,
        "op9_simhash_near_dedup": q_simhash.op9_simhash_near_dedup,
        "op10_benchmark_decontamination": q_decontamination.op10_benchmark_decontamination,
        "op11_phrase_collocations": q_collocations.op11_phrase_collocations,
        "op12_centroid_clustering": q_kdtree_clustering.op12_centroid_clustering,
        "op13_exact_topk": q_topk_search.op13_exact_topk,
    }


def oracle_sql():
    return {"op1_quality_rules": q_quality_rules.ORACLE, "op6_url_filter": q_url_rules.ORACLE, "op11_phrase_collocations": q_collocations.ORACLE, "op12_centroid_clustering": q_kdtree_clustering.ORACLE, "op13_exact_topk": q_topk_search.ORACLE}
