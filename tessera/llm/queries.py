"""The registered queries of this subpackage and, where SQL can say it, their DuckDB SQL."""

from __future__ import annotations

from . import chat, decontaminate, media, packing, pii, quality, simhash, substring, suffix, urls

QUERIES = {
    "op1_suffix_array_dedup": suffix.op1,
    "op2_benchmark_decontamination": decontaminate.op2,
    "op3_substring_dedup": substring.op3,
    "op4_pii": pii.op4,
    "op5_chat_formatting": chat.op5,
    "op6_media_columns": media.op6,
    "op7_quality_classifier": quality.op7,
    "op8_simhash_near_dedup": simhash.op8,
    "op9_packing": packing.op9,
    "op10_url_filters": urls.op10,
    "url_aliases": urls.aliases,
}

SQL: dict[str, str] = {
    "op2_benchmark_decontamination": decontaminate.SQL2,
    "op3_substring_dedup": substring.SQL3,
    "op5_chat_formatting": chat.SQL5,
    "op10_url_filters": urls.SQL10,
    "url_aliases": urls.SQL_ALIASES,
}
