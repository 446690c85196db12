"""Declared schemas of the code index."""

FILES = "id long, path string, lang string, mtime double, hash string"
LINES = "file_id long, line_no int, text string"
SYMBOLS = "id long, file_id long, name string, kind string, line_start int, line_end int, qualified_name string"
CALLS = "file_id long, line int, pos int, callee_name string"
CALL_EDGES = "caller_id long, callee_name string, line int, pos int, callee_id long, resolved_name string, callee_file string"
REFERENCES = "symbol_id long, file_id long, line int"
DOCSTRINGS = "symbol_id long, content string, line_start int, line_end int"
IMPORTS = "id long, file_id long, module string, level int, is_star boolean"
TYPE_HINTS = "symbol_id long, param_name string, annotation string, is_return boolean"
EMBEDDINGS = "symbol_id long, embedding array<float>, model string"
CLOSURE = "symbol_id long, caller_id long, depth int"
GIT_HISTORY = "id long, symbol_id long, file_path string, commit_hash string, commit_date string, commit_msg string, change_type string, lines_added int, lines_removed int"
EDITS = "id string, file_path string, old_code string, new_code string, diff string, applied boolean, created_at double, applied_at double"
#: Facts about names, for the unused-code audit.
NAME_USES = "file_id long, name string"
IMPORTED_NAMES = "file_id long, module string, name string, level int, is_star boolean"
KINDS = ("function", "class", "method", "interface")
#: Of a symbol id: ids are file id times this plus the place in the file, so they need no global order.
PER_FILE = 10_000_000
