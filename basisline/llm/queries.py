"""Queries of the training-data operators, with oracle SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from basisline.llm.circulant import op13_circulant_minhash
from basisline.llm.conversations import op12_dial_conversation_repair
from basisline.llm.decontamination import op4_benchmark_windows
from basisline.llm.html_extraction import op5_composite_text_density
from basisline.llm.language_model import op9_deleted_interpolation
from basisline.llm.line_dedup import op8_site_spread_lines
from basisline.llm.near_duplicates import op7_bayesian_jaccard_join
from basisline.llm.oracles import SQL
from basisline.llm.packing import op1_minimum_bin_slack
from basisline.llm.quality_classifier import op2_nonnegative_pu
from basisline.llm.quality_rules import op6_risk_controlled_rules
from basisline.llm.sharding import op3_virtual_slot_sharding
from basisline.llm.warc import op10_warc_derivatives
from basisline.llm.whitening import op11_svd_merge_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minimum_bin_slack": op1_minimum_bin_slack,
    "op2_nonnegative_pu": op2_nonnegative_pu,
    "op3_virtual_slot_sharding": op3_virtual_slot_sharding,
    "op4_benchmark_windows": op4_benchmark_windows,
    "op5_composite_text_density": op5_composite_text_density,
    "op6_risk_controlled_rules": op6_risk_controlled_rules,
    "op7_bayesian_jaccard_join": op7_bayesian_jaccard_join,
    "op8_site_spread_lines": op8_site_spread_lines,
    "op9_deleted_interpolation": op9_deleted_interpolation,
    "op10_warc_derivatives": op10_warc_derivatives,
    "op11_svd_merge_whitening": op11_svd_merge_whitening,
    "op12_dial_conversation_repair": op12_dial_conversation_repair,
    "op13_circulant_minhash": op13_circulant_minhash,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = dict(SQL)
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
