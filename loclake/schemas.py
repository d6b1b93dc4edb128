"""Schemas of the product's tables, as DDL."""

from __future__ import annotations

ENTRIES = (
    "text string, raw_text string, line_number int, context_line string, character string, text_type string, context string, context_path array<string>, "
    "processed_text string, placeholder_map map<string,string>, file_path string, node_type string, is_deep_scan boolean, is_ast_scan boolean, is_rpyc boolean, "
    "is_engine_common boolean, pass_no int, seq bigint"
)
TOKENS = "token_type string, text string, raw_text string, prefix string, line_number int, context_path array<string>, context_line string, text_type string, file_path string"
TL_ENTRIES = (
    "original_text string, translated_text string, file_path string, line_number int, entry_type string, character string, source_comment string, block_id string, "
    "context_path array<string>, translation_id string"
)
REQUESTS = "req_idx bigint, text string, source_lang string, target_lang string, engine string, translation_id string, file_path string, line_number int"
RESULTS = REQUESTS + ", translated_text string, success boolean, error string, confidence double"
TM = "lang string, entry_id string, original string, translation string"
GLOSSARY = "src string, dst string, lang string"
ISSUES = "file_path string, line_number int, severity string, issue_type string, message string, suggestion string, code_snippet string"
MATCHES = "new_id string, new_original string, old_id string, old_original string, old_translation string, similarity double"
