"""Schemas of the data model, as DDL that readers and schema arguments take. Lists carry a seq column wherever their order matters."""

from __future__ import annotations

PAGE = "doc_id string, page_idx int, page_label string, text string"
CHUNK = (
    "doc_id string, chunk_seq int, text string, chunk_type string, page_idx int, page_label string, page_span array<int>, parser_used string,"
    " is_table boolean, table_id int, caption_hint string, flat_capture boolean"
)
ORGANIZATION = "struct<type: string, name: string, address: string, same_as: array<string>>"
AUTHOR = f"struct<type: string, name: string, identifier: string, affiliations: array<{ORGANIZATION}>>"
ENTITY = "struct<type: string, name: string, role: string>"
SECTION = "struct<section_name: string, summary: string, key_points: array<string>, page_start: int, page_end: int>"
METRIC = "struct<name: string, value_str: string, value_num: double, unit_text: string, context: string, page_number: int, bbox: array<double>>"
TABLE = "struct<caption: string, page_number: int, headers: array<string>, rows: array<array<string>>, table_type: string, bbox: array<double>>"
KG_NODE = "doc_id string, node_id string, type string, label string, description string, properties map<string, string>, confidence double, source_page int, same_as array<string>"
KG_EDGE = "doc_id string, src string, dst string, type string, weight double, evidence string, source_page int"
STEP = "struct<step_number: int, name: string, description: string, inputs: array<string>, outputs: array<string>, page_number: int>"
TERM = "struct<name: string, description: string, term_code: string, page_number: int>"
FORMULA = "struct<name: string, expression: string, description: string, variables: map<string, string>, page_number: int>"
IDENTIFIER = "struct<property_id: string, value: string>"
DOCUMENT = (
    f"doc_id string, id string, type array<string>, name string, description string, in_language string, date_published string, publisher string, keywords array<string>,"
    f" authors array<{AUTHOR}>, identifiers array<{IDENTIFIER}>, sections array<{SECTION}>, metrics array<{METRIC}>, tables array<{TABLE}>, citations array<string>,"
    f" terms array<{TERM}>, formulas array<{FORMULA}>, procedures array<{STEP}>"
)
#: What the store keeps: files, chunks, documents.
STORE = {
    "workspace_files": "file_name string, path string, size_bytes long, upload_time timestamp",
    "extracted_chunks": CHUNK,
    "extracted_documents": "file_name string, payload string, updated_at timestamp",
}
