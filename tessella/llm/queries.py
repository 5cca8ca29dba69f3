"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tessella.llm import byte_bpe, language, lines, media, neardup, packing, quality, substrings, token_store, warc

QUERIES = {
    "op1_quality_cascade": quality.op1_quality_cascade,
    "op2_segmented_warc": warc.op2_segmented_warc,
    "op3_sum_of_squares": packing.op3_sum_of_squares,
    "op4_flac": media.op4_flac,
    "op5_subword_language": language.op5_subword_language,
    "op6_prefix_doubling": substrings.op6_prefix_doubling,
    "op7_multi_index": neardup.op7_multi_index,
    "op8_merge_replay": byte_bpe.op8_merge_replay,
    "op9_plane_files": token_store.op9_plane_files,
    "op10_fuzzy_lines": lines.op10_fuzzy_lines,
}
ORACLE_SQL: dict[str, str] = {"op1_quality_cascade": quality.OP1_SQL}
