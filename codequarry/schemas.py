"""Declared schemas of the tables that operators exchange."""

from __future__ import annotations

FILES = "path string, size long, language string, lines long, preview string, content string, is_config boolean, is_entrypoint boolean"
CHUNKS = "path string, chunk_id string, content string, start_line int, end_line int, chunk_type string, chunk_name string"
IMPORT_ROWS = "module string, name string, kind string, line int, is_external boolean, raw string"
IMPORTS = "source_file string, target_module string, target_file string, import_kind string, line_number int, is_external boolean, raw_statement string"
SYMBOL_ROWS = "id string, name string, kind string, line int, end_line int, signature string, doc string"
SYMBOL_EDGES = "source string, target string, edge_type string, line int, raw string"
DOC_ITEMS = "id string, title string, category_id string, purpose string, related_file_patterns array<string>, depends_on array<string>, ord int"
DOC_CATEGORIES = "id string, title string, description string, parent_id string, ord int"
PAGES = "id string, title string, content string, parent_id string, ord int"

# Kinds that columns may hold.
IMPORT_KINDS = ("import", "from", "require", "dynamic", "static", "wildcard", "table", "view", "procedure", "function", "sql_file")
SYMBOL_KINDS = ("function", "class", "module", "method", "interface", "variable", "constant", "property")
EDGE_TYPES = ("calls", "imports", "inherits", "implements", "uses", "contains", "decorates")
