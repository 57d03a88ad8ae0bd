"""The numbered queries of this subpackage and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_tools import OP4_SQL, op4_chat_formatting
from .filter_interaction import OP12_SQL, op12_filter_interaction
from .jaccard_join import op5_jaccard_join
from .language_id import op6_language_id
from .media_columns import op8_media_columns
from .packing import op7_best_fit_packing
from .quality_classifier import op9_quality_classifier
from .quality_rules import OP10_SQL, op10_quality_rules
from .secret_scan import op13_secret_scans
from .source_divergence import OP11_SQL, op11_source_divergence
from .source_mixing import op3_source_mixing
from .substring_dedup import op2_substring_dedup
from .suffix_dedup import op1_suffix_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_source_mixing": op3_source_mixing,
        "op4_chat_formatting": op4_chat_formatting,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_language_id": op6_language_id,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_media_columns": op8_media_columns,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_quality_rules": op10_quality_rules,
        "op11_source_divergence": op11_source_divergence,
        "op12_filter_interaction": op12_filter_interaction,
        "op13_secret_scans": op13_secret_scans,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat_formatting": OP4_SQL,
        "op10_quality_rules": OP10_SQL,
        "op11_source_divergence": OP11_SQL,
        "op12_filter_interaction": OP12_SQL,
    }
