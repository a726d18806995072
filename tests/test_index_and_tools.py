import os
import subprocess

import pytest

from codequarry import cli
from codequarry.plans import indexing, tools
from codequarry.plans.store import Store
from codequarry.sources import codeowners, files as sf, git, openapi
from codequarry.streaming import ingest
from tests.samples import JAVA, PY, TS


def write(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as handle:
        handle.write(text)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("repos"))
    write(root, "shop/src/UserController.java", JAVA)
    write(root, "shop/src/x.ts", TS)
    write(root, "shop/src/c.py", PY)
    write(root, "shop/node_modules/skip.js", "function no() { return 1; }")
    write(root, "shop/docs/readme.md", "text")
    write(root, "other/a.py", "def main():\n    work()\n\ndef work():\n    main()\n")
    write(root, "legacy-one/a.py", "x = 1\n")
    write(root, "empty/readme.md", "no code")
    return root


@pytest.fixture(scope="module")
def store(spark, tree, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")), buckets=4)
    result = indexing.index_all(store, tree, exclude=["legacy-*"])
    assert result["summary"] == {"success": 2, "failed": 0, "skipped": 0}
    assert [r["repo_name"] for r in result["repositories"]] == ["other", "shop"]
    return store


@pytest.fixture(scope="module")
def index(store):
    return tools.Index.of(store)


def test_tables_after_full_index(store):
    assert store.read("chunks").where("repo_name = 'shop'").count() == 19
    assert store.read("chunks").where("file_path like '%skip%'").isEmpty()
    assert store.read("embeddings").count() == store.read("chunks").count()
    paths = {r["file_path"] for r in store.read("manifest").where("repo_name = 'shop'").collect()}
    assert paths == {"src/UserController.java", "src/x.ts", "src/c.py"}


def test_search_returns_best_first(index):
    result = tools.semantic_grep(index, "find user", n_results=5, repo_filter="shop", detail_level="summary", similarity_threshold=0.0)
    scores = [r["similarity"] for r in result["results"]]
    assert len(scores) == 5 and scores == sorted(scores, reverse=True)
    assert tools.semantic_grep(index, "  ")["error"]
    assert "Invalid type_filter" in tools.semantic_grep(index, "x", type_filter="nope")["error"]
    fitted = tools.semantic_grep(index, "find user", n_results=10, detail_level="full", token_budget=400, similarity_threshold=0.0)
    assert fitted["stats"]["detail_level"] == "summary" and fitted["total_results"] == 8


def test_navigation(index):
    assert tools.lookup_symbol(index, "UserController.find")["total"] == 1
    assert tools.find_callers(index, "work")["callers"][0]["caller"] == "main"
    assert tools.find_call_path(index, "main", "main")["path"] == ["main", "work", "main"]
    assert tools.find_call_path(index, "main", "nowhere")["found"] is False
    assert tools.file_summary(index, "c.py", "shop")["classes"][0]["members"][0]["name"] == "m"
    assert tools.get_context(index, "findOne")["related"][0]["relation"] == "parent"
    assert tools.find_hierarchy(index, "UserController")["implements"] == ["Auditable", "Closeable"]
    assert tools.find_implementations(index, "Base")["total"] == 2
    assert tools.get_index_stats(index)["repositories"] == ["other", "shop"]
    assert tools.find_tests(index, "Read")["test_methods_count"] == 0


def test_compound_tools(index):
    explored = tools.explore(index, "work", depth="deep")
    assert (explored["total_callers"], explored["impact_radius"]) == (1, 2)
    assert tools.explore(index, "work", depth="far")["error"]
    understood = tools.understand(index, "UserController.find")
    assert understood["dependencies"]["direct"] == ["User.<init>", "log.info", "userService.find"]
    assert understood["data_flow"]["inputs"][0] == "@PathVariable String id"
    change = tools.prepare_change(index, "work", change_type="delete")
    assert change["impact_summary"]["risk_level"] == "high" if change["transitive_dependents"] > 2 else "medium"
    assert tools.prepare_change(index, "work", change_type="paint")["error"]


def test_architecture(index):
    dead = tools.find_dead_code(index, "other")
    assert dead["statistics"]["dead_count"] == 0 and dead["entry_points"] == [{"symbol": "main", "file": "a.py"}]
    cycles = tools.detect_circular_dependencies(index, "other", file_level=False)
    assert cycles["cycles"] == [{"repo": "other", "members": ["main", "work"], "size": 2}]
    links = tools.analyze_api_links(index, "shop")
    assert links["statistics"]["endpoints_found"] == 5 and links["statistics"]["api_calls_found"] == 2
    assert [(l["caller_qualified_name"], l["qualified_name"]) for l in links["linked"]] == [("load", "UserController.find")]


def test_quality_tools(index):
    metrics = tools.get_metrics(index, "shop")
    assert metrics["total_files"] == 3 and metrics["hotspots"][0]["cyclomatic"] >= 1
    assert tools.get_metrics(index, symbol_name="find")["qualified_name"] == "UserController.find"
    assert tools.scan_secrets(index)["total_findings"] == 0
    patterns = tools.analyze_patterns(index, "dependency_injection", include_testing=True)["patterns"]
    assert [p["pattern_name"] for p in patterns if p["recommended"]] == ["constructor_injection"] or patterns[0]["percentage"] == 50.0
    assert tools.call_tool("nope", index, {})["error"]
    assert tools.call_tool("find_tests", index, {"wrong": 1})["tool"] == "find_tests"


@pytest.mark.parametrize("kind", list(tools.DIAGRAMS))
def test_diagrams(index, kind):
    for output in ("mermaid", "plantuml", "dot", "ascii"):
        result = tools.generate_diagram(index, "find user", kind, output_format=output)
        ids = {n["id"] for n in result["nodes"]}
        assert result["nodes"] and all(e["source"] in ids and e["target"] in ids for e in result["edges"])
    assert tools.generate_diagram(index, "x", "pie")["error"] and tools.generate_diagram(index, "x", output_format="svg")["error"]


def test_incremental_update_touches_only_changes(spark, tmp_path):
    root = str(tmp_path / "proj")
    write(root, "a.py", "def one():\n    two()\n")
    write(root, "b.py", "class B(A):\n    def two(self): pass\n")
    write(root, "gone.py", "def old(): pass\n")
    store = Store(spark, str(tmp_path / "store"), buckets=4)
    assert indexing.index_repo(store, root)["chunks"] == 4
    assert indexing.index_repo(store, root, incremental=True)["status"] == "up_to_date"
    write(root, "a.py", "def one():\n    three()\n    three()\n\ndef extra(): pass\n")
    write(root, "new.py", "def fresh(): pass\n")
    os.remove(os.path.join(root, "gone.py"))
    result = indexing.index_repo(store, root, incremental=True)
    assert (result["new"], result["modified"], result["deleted"]) == (1, 1, 1)
    names = sorted(r["name"] for r in store.read("chunks").collect())
    assert names == ["B", "extra", "fresh", "one", "two"]
    assert {r["callee"] for r in store.read("calls").collect()} == {"three"}
    assert {r["id"] for r in store.read("embeddings").collect()} == {r["id"] for r in store.read("chunks").collect()}
    assert store.read("inheritance").count() == 1
    store.clear_repo("proj")
    assert store.read("chunks").isEmpty() and store.read("manifest").isEmpty()
    assert indexing.index_repo(store, str(tmp_path / "missing"))["error"]


def test_stored_registry(store):
    figures = {r["statistic"]: r["value"] for r in indexing.link_routes(store, ["shop"]).collect()}
    assert (figures["endpoints_found"], figures["api_calls_found"], figures["links_confident"]) == (5, 2, 1)
    assert store.read("route_links").first()["confidence"] > 0.9


def test_deletes(spark, tmp_path):
    root = str(tmp_path / "p")
    write(root, "a.py", "def one(): two()\n\ndef other(): pass\n")
    write(root, "b.py", "class C(D): pass\n")
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    indexing.index_repo(store, root)
    gone = store.read("chunks").where("name = 'other'").select("repo_name", "id")
    store.delete_chunks(gone)
    assert sorted(r["name"] for r in store.read("chunks").collect()) == ["C", "one"] and store.read("embeddings").count() == 2
    store.delete_files(spark.createDataFrame([("p", "b.py")], "repo_name string, file_path string"))
    assert [r["name"] for r in store.read("chunks").collect()] == ["one"] and store.read("inheritance").isEmpty()
    assert [r["file_path"] for r in store.read("manifest").collect()] == ["a.py"] and store.read("calls").count() == 1


def test_models(spark):
    from codequarry.functions import embedding
    from codequarry.operators import search

    assert embedding.dimension("all-MiniLM-L6-v2") == 384 and embedding.is_local("mock") and not embedding.is_local("voyage-code-2")
    with pytest.raises(ValueError):
        embedding.vector_of("x", "voyage-code-2")
    rows = spark.createDataFrame([("a", "r", "mock", [0.5])], "id string, repo_name string, model string, embedding array<float>")
    with pytest.raises(ValueError):
        search.checked(rows, "mock")


def test_upsert_last_wins(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=2)
    row = "child_name string, child_qualified string, parent_name string, relation_type string, file_path string, repo_name string, line_number int"
    store.upsert("inheritance", spark.createDataFrame([("A", "A", "P", "extends", "f", "r", 1)], row))
    report = store.upsert("inheritance", spark.createDataFrame([("A", "A", "P", "implements", "f", "r", 2), ("B", "B", "P", "extends", "f", "r", 3)], row))
    assert report == {"received": 2, "distinct": 2}
    assert {(r["child_name"], r["relation_type"]) for r in store.read("inheritance").collect()} == {("A", "implements"), ("B", "extends")}


def test_streaming_ingest_replaces_files(spark, tmp_path):
    root, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "store"), buckets=2)
    write(root, "r1/a.py", "def one(): pass\n")
    ingest.start(store, root, str(tmp_path / "cp")).awaitTermination()
    assert [r["name"] for r in store.read("chunks").collect()] == ["one"]
    write(root, "r2/b.py", "def two(): pass\n")
    ingest.start(store, root, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["name"] for r in store.read("chunks").collect()) == ["one", "two"]


def test_git_sources(spark, tmp_path):
    root = str(tmp_path / "g")
    write(root, "a.py", "x = 1\n")
    write(root, "old.py", "def longer_function_name():\n    return 12345\n")

    def g(*arguments):
        subprocess.run(["git", "-c", "user.name=Ann", "-c", "user.email=ann@example.com", *arguments], cwd=root, check=True, capture_output=True)

    g("init", "-q"), g("add", "."), g("commit", "-qm", "one")
    first = git.head(root)
    write(root, "a.py", "x = 2\ny = 3\n")
    g("mv", "old.py", "moved.py"), g("add", "."), g("commit", "-qm", "two")
    write(root, "b.py", "z = 1\n")
    g("add", "b.py")
    changes = {(r["file_path"], r["change"]) for r in git.changes(spark, root, "g", first).collect()}
    assert changes == {("a.py", "modified"), ("old.py", "deleted"), ("moved.py", "new"), ("b.py", "new")}
    assert [r["file_path"] for r in git.changed_source_files(spark, root, "g").collect()] == ["a.py", "b.py", "moved.py"]
    assert {r["author"] for r in git.blame(spark, root, "g", ["a.py"]).collect()} == {"Ann"}
    assert git.log(spark, root, "g").count() == 2


def test_ignore_rules(spark):
    paths = ["src/a.py", "src/node_modules/b.js", "x.min.js", "logs/today.py", "keep/logs/ok.py", "gen/auto.py", "gen/keep.py", "notes.txt"]
    df = spark.createDataFrame([("r", p) for p in paths], "repo_name string, file_path string")
    rules = sf.gitignore_rules("# c\nlogs/\n/gen/*.py\n!keep.py\n")
    kept = {r["file_path"] for r in sf.source_files(df, rules).collect()}
    assert kept == {"src/a.py", "gen/keep.py"}


def test_openapi(spark):
    yaml_text = """
openapi: 3.0.0
servers: [{url: 'https://x.example/api/v2'}]
paths:
  /users/{id}:
    parameters: [{name: id, in: path, required: true, schema: {type: string}}]
    get: {operationId: getUser, responses: {'200': {description: ok, content: {application/json: {}}}}}
    post: {requestBody: {content: {application/json: {}}}, parameters: [{name: q, in: query}]}
"""
    json_text = '{"swagger": "2.0", "basePath": "/v1", "paths": {"/pets": {"get": {"summary": "all"}, "x-note": "no"}}}'
    files = spark.createDataFrame([("r", "docs/openapi.yaml", yaml_text), ("r", "swagger.json", json_text), ("r", "a.json", "{}")], "repo_name string, file_path string, content string")
    rows = {r["qualified_name"]: r for r in openapi.spec_endpoints(openapi.as_json(openapi.spec_files(files))).collect()}
    assert set(rows) == {"getUser", "POST_/api/v2/users/{id}", "GET_/v1/pets"}
    user = rows["getUser"]
    assert user["route"]["base_path"] == "/api/v2" and user["route"]["path_pattern"] == "/users/{id}"
    assert [(p["name"], p["source"], p["required"]) for p in user["route"]["parameters"]] == [("id", "path", True)]
    assert user["metadata"]["responses"]["200"]["content_types"] == ["application/json"]
    assert [p["name"] for p in rows["POST_/api/v2/users/{id}"]["route"]["parameters"]] == ["id", "q"]


def test_codeowners_first_place_counts(spark):
    files = spark.createDataFrame([("r", "docs/CODEOWNERS", "* @late"), ("r", ".github/CODEOWNERS", "# x\n*.py @py @ops\n")], "repo_name string, file_path string, content string")
    assert [(r["pattern"], r["owners"], r["line_number"]) for r in codeowners.rules_of(files).collect()] == [("*.py", ["@py", "@ops"], 2)]


def test_command_line(spark, tree, store):
    assert [r["repo_name"] for r in cli.run(["--store", store.root, "discover", tree, "--include", "sh*"], spark)["repositories"]] == ["shop"]
    assert cli.run(["--store", store.root, "stats"], spark)["total_chunks"] == 20
    assert cli.run(["--store", store.root, "usages", "work"], spark)["total_usages"] == 2  # the call, and the text ":\n    work" read as a type hint
    assert "error" in cli.run(["--store", store.root, "clear-all"], spark)
