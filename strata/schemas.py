"""Schemas of stored tables. Readers use these; nothing is inferred."""

SCHEMA_VERSION = 2

ENTRIES = "rev_id string, path string, kind string, mode int, bytes binary"
ENTRY_META = "rev_id string, path string, kind string, mode int, content_hash string, line_hashes array<bigint>"
FUNCTIONS = (
    "rev_id string, pos bigint, language string, path string, qualified_name string, kind string, name string, "
    "start_line int, end_line int, normalized_hash string, ast_hash string, ast_node_count int, token_count int, "
    "sloc int, cc int, mass double, role string, shingles array<bigint>, ast_shingles array<bigint>, "
    "shingle_seq array<bigint>, ast_shingle_seq array<bigint>, shingle_lines array<int>, ast_shingle_lines array<int>"
)
CHANGES = "path string, status string, old_path string"
ADDED_LINES = "path string, line int"
LINTS = "rev_id string, path string, kind string, lint_paths array<string>, target_fp string, target_kind string, line int"
UNSAFE = "rev_id string, path string, pattern_id string, fingerprint string, line int"
DEPENDENCIES = (
    "rev_id string, path string, table_path string, dependency_key string, package string, source_kind string, "
    "source string, default_features boolean, features array<string>, version string, line int"
)
COVERAGE = "path string, status string, detail string"
RULE_COVERAGE = "path string, rule_id string, applicable boolean, completed boolean, status string, detail string"
FINDINGS = (
    "emit_seq bigint, rule_id string, severity string, message string, path string, line int, base_path string, base_line int, "
    "base_mass double, head_mass double, delta double, threshold double, similarity double, properties map<string,string>"
)
SUPPRESSIONS = "rule string, path string, line int, reason string"
META = "schema_version int, tool_version string, rev_id string, policy_fingerprint string, analyzer_fingerprint string, snapshot_id string"
