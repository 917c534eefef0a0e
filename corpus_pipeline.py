"""A corpus pipeline over ``documents``: language ID, near copies, benchmark
decontamination, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.llm import op2_winnow, op3_language, op5_secrets, op6_packing, op9_near
from strata.llm.scratch import written

STAGES = [
    ("language", op3_language.keep_identified),
    ("near copies", op9_near.keep_one),
    ("decontamination", op2_winnow.drop_contaminated),
    ("secrets", op5_secrets.mask_secrets),
    ("packing", op6_packing.pack_stage),
]

#: Language models, exact near copies and bucket bounds are beyond SQL; the
#: stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
