"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldwright.llm.language_model import ORACLE_SQL as LANGUAGE_MODEL_SQL
from foldwright.llm.language_model import op4_language_model
from foldwright.llm.mixing import op5_mixing
from foldwright.llm.ngram_join import op10_ngram_join
from foldwright.llm.one_bit_ann import op2_one_bit_ann
from foldwright.llm.packing import op7_packing
from foldwright.llm.quality import ORACLE_SQL as QUALITY_SQL
from foldwright.llm.quality import op3_quality
from foldwright.llm.sharding import op6_sharding
from foldwright.llm.suffix_dedup import op1_suffix_dedup
from foldwright.llm.token_counts import op9_token_counts
from foldwright.llm.toxicity import op8_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_one_bit_ann": op2_one_bit_ann,
    "op3_quality": op3_quality,
    "op4_language_model": op4_language_model,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_ngram_join": op10_ngram_join,
}

ORACLE_SQL: dict[str, str] = {"op3_quality": QUALITY_SQL, "op4_language_model": LANGUAGE_MODEL_SQL}
