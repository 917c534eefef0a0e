"""The registered queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.llm import (op1_pii, op2_winnow, op3_language, op4_licenses, op5_secrets, op6_packing, op7_divergence, op8_chat, op9_near,
                        op10_url_rules, op11_resample, op12_sketch, op13_manifest)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii.query,
    "op2_winnow": op2_winnow.query,
    "op3_language": op3_language.query,
    "op4_licenses": op4_licenses.query,
    "op5_secrets": op5_secrets.query,
    "op6_packing": op6_packing.query,
    "op7_divergence": op7_divergence.query,
    "op8_chat": op8_chat.query,
    "op9_near": op9_near.query,
    "op10_url_rules": op10_url_rules.query,
    "op11_resample": op11_resample.query,
    "op12_sketch": op12_sketch.query,
    "op13_manifest": op13_manifest.query,
}
SQL: dict[str, str] = {"op2_winnow": op2_winnow.SQL, "op5_secrets": op5_secrets.SQL, "op8_chat": op8_chat.SQL, "op10_url_rules": op10_url_rules.SQL,
                       "op11_resample": op11_resample.SQL, "op12_sketch": op12_sketch.SQL, "op13_manifest": op13_manifest.SQL}
