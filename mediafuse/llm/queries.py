"""The registered queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from mediafuse.llm import decontaminate, html_extract, language_id, lexical_search, license_scan, line_dedup, near_dups, nearest, packing, resample, secret_scan, simhash_dups, token_counts

QUERIES = {
    "op1_html_extract": html_extract.query,
    "op2_near_dups": near_dups.query,
    "op3_language_id": language_id.query,
    "op4_secret_scan": secret_scan.query,
    "op5_packing": packing.query,
    "op6_line_dedup": line_dedup.query,
    "op7_decontaminate": decontaminate.query,
    "op8_license_scan": license_scan.query,
    "op9_token_counts": token_counts.query,
    "op10_nearest": nearest.query,
    "op11_resample": resample.query,
    "op12_lexical_search": lexical_search.query,
    "op13_simhash_dups": simhash_dups.query,
}
ORACLE_SQL: dict[str, str] = {
    "op6_line_dedup": line_dedup.SQL,
    "op11_resample": resample.SQL,
    "op12_lexical_search": lexical_search.SQL,
}
