"""Registered queries of the training-text operators; ORACLE_SQL holds DuckDB statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import op2_chat_format
from .chunks import op8_substring_dedup
from .decontaminate import op1_decontamination
from .filter_audit import op13_filter_audit
from .html_tree import op3_html_text
from .jaccard import op5_ngram_jaccard
from .line_frequency import op12_quality_rules
from .merkle import op11_merkle_manifest
from .oracle_sql import ORACLE_SQL
from .sentencepiece_fst import op7_sentencepiece
from .syncmers import op4_syncmers
from .toxicity import op9_toxicity
from .urls import op6_url_filters
from .warc import op10_warc

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_chat_format": op2_chat_format,
    "op3_html_text": op3_html_text,
    "op4_syncmers": op4_syncmers,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_url_filters": op6_url_filters,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_warc": op10_warc,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_quality_rules": op12_quality_rules,
    "op13_filter_audit": op13_filter_audit,
}
