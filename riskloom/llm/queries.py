"""The queries of this package by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.byte_bpe import op10_byte_bpe
from riskloom.llm.chat_format import op7_chat_format
from riskloom.llm.knn_join import OP1_SQL, op1_knn_join
from riskloom.llm.license_scan import op6_license_scan
from riskloom.llm.ngram_join import op2_ngram_join
from riskloom.llm.packing import op5_packing
from riskloom.llm.pii import op9_pii
from riskloom.llm.quality_classifier import op8_quality_classifier
from riskloom.llm.quality_rules import op4_quality_rules
from riskloom.llm.toxicity import op3_toxicity
from riskloom.llm.turn_repair import op13_turn_repair
from riskloom.llm.url_filter import OP12_SQL, op12_url_filter
from riskloom.llm.whitening import op11_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_knn_join": op1_knn_join,
    "op2_ngram_join": op2_ngram_join,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_packing": op5_packing,
    "op6_license_scan": op6_license_scan,
    "op7_chat_format": op7_chat_format,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_pii": op9_pii,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_whitening": op11_whitening,
    "op12_url_filter": op12_url_filter,
    "op13_turn_repair": op13_turn_repair,
}
ORACLES: dict[str, str] = {"op1_knn_join": OP1_SQL, "op12_url_filter": OP12_SQL}
