"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and the
SQL that says the same where SQL can."""

from __future__ import annotations

from . import decontaminate, html_extract, language_id, line_dedup, media, mixing, ngram_join, sharding, suffix_dedup, url_filter

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_sharding": sharding.op2_sharding,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_media_columns": media.op5_media_columns,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_source_mix": mixing.op9_source_mix,
    "op10_url_filter": url_filter.op10_url_filter,
}

ORACLES = {
    "op4_ngram_join": ngram_join.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op8_suffix_dedup": suffix_dedup.ORACLE,
    "op9_source_mix": mixing.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
}
