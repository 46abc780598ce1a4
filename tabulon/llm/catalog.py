"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm import chat, licences, urls
from tabulon.llm.alignment import op13_token_alignment
from tabulon.llm.neighbours import op2_hilbert_neighbours
from tabulon.llm.packing import op1_pattern_packing
from tabulon.llm.pieces import op4_gumbel_segmentations
from tabulon.llm.quality import op5_compression_bands
from tabulon.llm.repair import op11_turn_repair
from tabulon.llm.secretscan import op7_multipart_secrets
from tabulon.llm.simhash import op9_covering_simhash
from tabulon.llm.tokenfile import op8_packed_token_files
from tabulon.llm.vectordedup import op12_sorted_passes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pattern_packing": op1_pattern_packing,
        "op2_hilbert_neighbours": op2_hilbert_neighbours,
        "op3_preference_pairs": chat.op3_preference_pairs,
        "op4_gumbel_segmentations": op4_gumbel_segmentations,
        "op5_compression_bands": op5_compression_bands,
        "op6_url_rules": urls.op6_url_rules,
        "op7_multipart_secrets": op7_multipart_secrets,
        "op8_packed_token_files": op8_packed_token_files,
        "op9_covering_simhash": op9_covering_simhash,
        "op10_license_dice": licences.op10_license_dice,
        "op11_turn_repair": op11_turn_repair,
        "op12_sorted_passes": op12_sorted_passes,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_preference_pairs": chat.ORACLE, "op6_url_rules": urls.ORACLE, "op10_license_dice": licences.oracle()}
