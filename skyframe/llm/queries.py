"""The queries of the operators here, and SQL for those that SQL can express."""

from . import chunks, decontam, hmm, langid, licenses, mixing, neardup, quality, suffixes, urls

QUERIES = {
    f.__name__: f
    for f in (
        mixing.op1_pareto_mix, licenses.op2_license_scan, neardup.op3_near_duplicates, hmm.op4_hmm_scores, suffixes.op5_suffix_dedup,
        decontam.op6_decontaminate, quality.op7_quality_rules, langid.op8_language_id, urls.op9_url_filter, chunks.op10_substring_dedup,
        urls.url_redirect_chains,
    )
}
ORACLE_SQL = {"op1_pareto_mix": mixing.OP1_SQL, "op2_license_scan": licenses.OP2_SQL, "op9_url_filter": urls.OP9_SQL, "url_redirect_chains": urls.CHAINS_SQL}
