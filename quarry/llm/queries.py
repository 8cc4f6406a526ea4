"""The registered queries of this package and their DuckDB twins.

Each operator module has ``query(spark, sf_dir)`` and, where SQL can express the
result, ``ORACLE``.
"""

from __future__ import annotations

from quarry.llm import (
    decontaminate,
    filter_audit,
    line_dedup,
    mixing,
    pii,
    quality_classifier,
    quality_rules,
    secrets,
    sentence_dedup,
    simhash,
    source_divergence,
    toxicity,
    url_filter,
)

_OPERATORS = {
    "op1_quality_classifier": quality_classifier,
    "op2_mixing": mixing,
    "op3_secrets": secrets,
    "op4_line_dedup": line_dedup,
    "op5_url_filter": url_filter,
    "op6_quality_rules": quality_rules,
    "op7_sentence_dedup": sentence_dedup,
    "op8_pii": pii,
    "op9_simhash": simhash,
    "op10_decontaminate": decontaminate,
    "op11_filter_audit": filter_audit,
    "op12_source_divergence": source_divergence,
    "op13_toxicity": toxicity,
}

QUERIES = {name: module.query for name, module in _OPERATORS.items()}
ORACLES = {name: module.ORACLE for name, module in _OPERATORS.items()
           if getattr(module, "ORACLE", None)}
