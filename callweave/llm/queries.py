"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callweave.llm import (
    byte_bpe,
    compression_quality,
    exact_dedup,
    langid,
    licences,
    line_dedup,
    mixing,
    page_diff,
    simhash,
    snapshot_chat,
    spelling,
    voronoi_knn,
    word_runs,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_page_diff": page_diff.op1_page_diff,
    "op2_snapshot_chat": snapshot_chat.op2_snapshot_chat,
    "op3_compression_quality": compression_quality.op3_compression_quality,
    "op4_language_id": langid.op4_language_id,
    "op5_simhash_golay": simhash.op5_simhash_golay,
    "op6_voronoi_knn": voronoi_knn.op6_voronoi_knn,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op10_licence_scan": licences.op10_licence_scan,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_spelling": spelling.op12_spelling,
    "op13_word_runs": word_runs.op13_word_runs,
}

ORACLE: dict[str, str] = {
    "op2_snapshot_chat": snapshot_chat.ORACLE,
    "op6_voronoi_knn": voronoi_knn.ORACLE,
    "op7_mix_sources": mixing.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op10_licence_scan": licences.ORACLE,
    "op11_line_dedup": line_dedup.ORACLE,
}
