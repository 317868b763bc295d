"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from . import bpe, chat, classifier, decontaminate, html_text, near_dedup, pii, quality_rules, sharding, url_filter

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_bpe": bpe.op2_bpe,
    "op3_html_text": html_text.op3_html_text,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_pii": pii.op6_pii,
    "op7_sharding": sharding.op7_sharding,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_quality_classifier": classifier.op9_quality_classifier,
    "op10_chat": chat.op10_chat,
}

ORACLE_SQL = {
    "op1_quality_rules": quality_rules.oracle(),
    "op4_url_filter": url_filter.oracle(),
    "op5_decontamination": decontaminate.oracle(),
    "op7_sharding": sharding.oracle(),
    "op8_near_dedup": near_dedup.oracle(),
    "op10_chat": chat.oracle(),
}
