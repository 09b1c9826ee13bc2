"""The queries of this subpackage, by name; SQL where it can express one."""

from __future__ import annotations

from . import decontaminate, language, media, mixture, near, quality, scoring, sql, substrings, tokens, urls

QUERIES = {
    "op1_media_columns": media.op1,
    "op2_lm_scoring": scoring.op2,
    "op3_url_filter": urls.op3,
    "op4_language_id": language.op4,
    "op5_decontamination": decontaminate.op5,
    "op6_substring_dedup": substrings.op6,
    "op7_mixture": mixture.op7,
    "op8_token_counts": tokens.op8,
    "op9_jaccard_join": near.op9,
    "op10_quality_classifier": quality.op10,
}

SQL: dict[str, str] = sql.SQL
