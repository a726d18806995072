"""Schemas of the stored tables, as DDL strings Spark understands."""

CALL_SITE = "caller string, callee string, line int, call_type string"
BASE_CLASS = "child_name string, child_qualified string, parent_name string, relation_type string, line_number int"
ROUTE = "method string, path string, framework string, line int, is_mount boolean"
METADATA = (
    f"route struct<{ROUTE.replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean')}>, "
    "dependencies array<struct<name:string,type:string,injection_type:string>>, "
    "outgoing_api_calls array<struct<method:string,url:string>>, "
    "is_react_component boolean, props_interface string"
)


def as_struct(ddl: str) -> str:
    """``a string, b int`` -> ``struct<a string, b int>`` (Spark accepts the space form)."""
    return f"struct<{ddl}>"


CHUNK = (
    "id string, repo_name string, file_path string, start_line int, end_line int, chunk_type string, name string, "
    "content string, signature string, docstring string, parent_name string, parent_type string, language string, "
    f"imports array<string>, metadata {as_struct(METADATA)}, summary string"
)
#: What a parser can be asked for; numbers of chunks and errors are always told. Columns not asked for are null.
PARTS = ("chunks", "calls", "bases", "dependencies")
CALL = "caller string, callee string, caller_file string, caller_line int, repo_name string, call_type string"
INHERITANCE = (
    "child_name string, child_qualified string, parent_name string, relation_type string, file_path string, "
    "repo_name string, line_number int"
)
CLASS_DEPENDENCY = "class_name string, field_name string, field_type string, injection_type string, repo_name string"
EMBEDDING = "id string, repo_name string, model string, embedding array<float>"
MANIFEST = "repo_name string, file_path string, mtime double, size bigint, chunk_ids array<string>"
ROUTE_PARAMETER = "name string, position int, source string, type_hint string, required boolean"

NORMALIZED_ROUTE = (
    "method string, path_pattern string, path_segments array<string>, "
    f"parameters array<{as_struct(ROUTE_PARAMETER)}>, base_path string, query_params array<string>, framework string, original_path string"
)
ENDPOINT = f"id string, route {as_struct(NORMALIZED_ROUTE)}, chunk_id string, qualified_name string, file_path string, repo_name string, language string"
API_CALL = (
    f"id string, route {as_struct(NORMALIZED_ROUTE)}, url string, chunk_id string, caller_qualified_name string, file_path string, "
    "repo_name string, line_number int"
)
ROUTE_LINK = "call_id string, endpoint_id string, confidence double, is_ambiguous boolean, alternatives int, rank int, repo_name string"

# key columns, and which input wins when two rows share a key
KEYS = {
    "chunks": (["id"], "last"),
    "calls": (["repo_name", "caller", "callee", "caller_file", "caller_line"], "first"),
    "inheritance": (["child_qualified", "parent_name", "repo_name"], "last"),
    "class_dependencies": (["class_name", "field_name", "repo_name"], "last"),
    "embeddings": (["model", "id"], "last"),
    "endpoints": (["id"], "last"),
    "api_calls": (["id"], "last"),
    "route_links": (["call_id", "endpoint_id"], "last"),
    "manifest": (["repo_name", "file_path"], "last"),
}
