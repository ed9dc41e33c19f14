"""The corpus operators' queries and their SQL, as __spark_entry__ registers them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from pageloom.llm.decontam import op8_benchmark_decontamination
from pageloom.llm.linechunks import OP3_SQL, op3_line_dedup
from pageloom.llm.linehash import OP5_SQL, op5_substring_dedup
from pageloom.llm.lm import op9_lm_scoring
from pageloom.llm.order import op4_training_order
from pageloom.llm.packing import op6_best_fit_packing
from pageloom.llm.partenum import OP10_SQL, op10_ngram_jaccard_join
from pageloom.llm.simhash import op1_simhash
from pageloom.llm.suffix import OP2_SQL, op2_suffix_array_dedup
from pageloom.llm.toxicity import op7_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_simhash": op1_simhash,
        "op2_suffix_array_dedup": op2_suffix_array_dedup,
        "op3_line_dedup": op3_line_dedup,
        "op4_training_order": op4_training_order,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_toxicity": op7_toxicity,
        "op8_benchmark_decontamination": op8_benchmark_decontamination,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_suffix_array_dedup": OP2_SQL,
        "op3_line_dedup": OP3_SQL,
        "op5_substring_dedup": OP5_SQL,
        "op10_ngram_jaccard_join": OP10_SQL,
    }
