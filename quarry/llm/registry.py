"""Queries of this subpackage and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from . import decontaminate, licenses, packing, passages, pii, quality_classifier, quality_rules, simhash, token_files, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_pii": pii.op2_pii,
    "op3_warc": warc.op3_warc,
    "op4_passages": passages.op4_passages,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_licenses": licenses.op7_licenses,
    "op8_token_files": token_files.op8_token_files,
    "op9_packing": packing.op9_packing,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}

ORACLE = {
    "op3_warc": warc.SQL,
    "op5_quality_rules": quality_rules.SQL,
    "op7_licenses": licenses.SQL,
    "op10_decontaminate": decontaminate.SQL,
}
