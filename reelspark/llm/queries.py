"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from reelspark.llm import importance, jaccard_join, source_audit, substring_dedup, url_filters, warc
from reelspark.llm.best_fit import op12_best_fit
from reelspark.llm.fingerprints import op7_fingerprints
from reelspark.llm.language_id import op1_language_id
from reelspark.llm.mixing import op2_mixing
from reelspark.llm.packing import op8_packing
from reelspark.llm.quality_rules import op6_quality_rules
from reelspark.llm.secret_scans import op3_secret_scans

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_mixing": op2_mixing,
    "op3_secret_scans": op3_secret_scans,
    "op4_url_filters": url_filters.op4_url_filters,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_fingerprints": op7_fingerprints,
    "op8_packing": op8_packing,
    "op9_ngram_jaccard": jaccard_join.op9_ngram_jaccard,
    "op10_warc": warc.op10_warc,
    "op11_importance": importance.op11_importance,
    "op12_best_fit": op12_best_fit,
    "op13_source_audit": source_audit.op13_source_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op4_url_filters": url_filters.ORACLE,
    "op5_substring_dedup": substring_dedup.ORACLE,
    "op9_ngram_jaccard": jaccard_join.ORACLE,
    "op10_warc": warc.ORACLE,
    "op11_importance": importance.ORACLE,
    "op13_source_audit": source_audit.ORACLE,
}
