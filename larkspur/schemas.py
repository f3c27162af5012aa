"""Schemas of the engine's entities as DDL, and the domains of their enumerations."""

from __future__ import annotations

SOURCE = "struct<uri: string, repo: string, commit: string, path: string, tool_name: string, tool_call_id: string>"

CHUNK = f"chunk_id string, tenant_id string, project_id string, agent_id string, timestamp_created bigint, timestamp_observed bigint, chunk_type string, status string, source {SOURCE}, text string, tags array<string>, hash string"
PIECE = "struct<text: string, start_char: int, end_char: int, chunk_index: int>"
SENTENCE = "struct<text: string, offset: int, is_code: boolean>"
TYPED_TOKEN = "struct<text: string, token_type: string, offset_from: int, offset_to: int>"
VECTOR = "chunk_id string, tenant_id string, embedding array<float>"
POSTING = "tenant_id string, chunk_id string, sentence_idx bigint, term string, tf bigint, dl bigint"
CHUNK_METADATA = "chunk_id string, tenant_id string, project_id string, chunk_type string, status string, timestamp_created bigint, hash string, source_uri string"
SYMBOL = "tenant_id string, symbol_id string, project_id string, file string, name string, kind string, line_start int, col_start int, line_end int, col_end int, parent_symbol_id string, signature string, docstring string, visibility string, language string"
CALL_EDGE = "tenant_id string, edge_id string, caller_symbol_id string, callee_name string, callee_symbol_id string, call_file string, call_line int, call_col int, call_type string"
IMPORT = "tenant_id string, import_id string, source_file string, imported_module string, imported_name string, alias string, import_line int, is_relative boolean"
TOOL_TRACE = "tenant_id string, trace_id string, project_id string, session_id string, tool_name string, timestamp_ms bigint, input_json string, output_json string, error_json string, context_tags array<string>, duration_ms bigint"
STACK_TRACE = "tenant_id string, trace_id string, project_id string, session_id string, timestamp_ms bigint, error_signature string, error_message string, full_trace string"
STACK_FRAME = "trace_id string, frame_idx int, file string, function string, line int, col int, context string"
CACHE_ENTRY = "entry_id string, tenant_id string, project_id string, query_embedding array<float>, result_ids array<string>, memory_version bigint, created_at bigint, last_hit bigint, hit_count bigint, confidence double"
ACCESS_EVENT = "chunk_id string, tenant_id string, timestamp_ms bigint, project_id string, query_id string"
ACCESS_STATS = "chunk_id string, access_count bigint, first_access bigint, last_access bigint, project_hits map<string, bigint>"
HOT_CHUNK = "chunk_id string, tenant_id string, embedding array<float>, promoted_at bigint, promotion_score double"
QUERY_METRICS = "query_id string, embed_ms double, dense_ms double, fetch_ms double, total_ms double"
STORE_STATS = "tenant_id string, total_chunks bigint, deleted_chunks bigint, chunk_types map<string, bigint>"
WAL_RECORD = "seq bigint, op string, tenant_id string, chunk_id string, timestamp_ms bigint, payload string"
CITATION = "struct<citation_id: string, chunk_id: string, project_id: string, source_path: string, char_start: int, char_end: int>"
EVAL_DOCUMENT = "id string, text string, type string, tags array<string>"
EVAL_QUERY = "id string, query string, type string, relevant array<string>, irrelevant array<string>"
QREL = "query_id string, doc_id string"

#: Domains of the enumerations and aliases that callers may use.
CHUNK_TYPES = ("code", "doc", "trace", "decision", "plan", "research", "message", "summary", "other")
CHUNK_TYPE_ALIASES = {"scientific": "doc", "general": "other"}
EVAL_TYPE_ALIASES = {"documentation": "doc", "log": "trace", "research_paper": "scientific", "nfcorpus": "scientific", "biomedical": "scientific"}
STATUSES = ("draft", "final", "error", "deleted")
SYMBOL_KINDS = ("function", "method", "class", "interface", "type", "enum", "variable", "constant", "module")
CALL_TYPES = ("direct", "method", "qualified")
