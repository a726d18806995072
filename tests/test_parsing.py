import pytest
from pyspark.sql import functions as F

from codequarry.registered import sources
from codequarry.sources import brace_code, brace_lexer, parsing, python_code
from tests.samples import JAVA, PY, TS


@pytest.fixture(scope="module")
def tables(spark):
    files = spark.createDataFrame(
        [("r", "a/UserController.java", JAVA, "java"), ("r", "b/x.ts", TS, "typescript"), ("r", "c.py", PY, "python"), ("r", "bad.py", "def broken(", "python"),
         ("r", "empty.py", "", "python"), ("r", "comment.py", "# only\n", "python"), ("r", "empty.js", "", "javascript"), ("r", "odd.js", "}}}{ function", "javascript"),
         ("r", "nöt.py", "def größe():\n\treturn 'é'\n", "python"), ("r", "binary.py", None, "python")],
        "repo_name string, file_path string, content string, language string",
    )
    return parsing.tables_of(parsing.parse_files(files).cache())


@pytest.fixture(scope="module")
def chunks(tables):
    return {(r["file_path"], r["name"], r["chunk_type"]): r for r in tables.chunks.collect()}


def calls_of(tables, caller):
    return {(r["callee"], r["caller_line"], r["call_type"]) for r in tables.calls.where(f"caller = '{caller}'").collect()}


def test_python_units(chunks):
    read = chunks["c.py", "read", "function"]
    assert (read["start_line"], read["end_line"], read["docstring"]) == (5, 9, "Read one.")
    assert read["signature"] == "def read(id: int, q=None) -> str:"
    assert (read["metadata"]["route"]["method"], read["metadata"]["route"]["path"]) == ("GET", "/items/{id}")
    method = chunks["c.py", "m", "method"]
    assert (method["parent_name"], method["parent_type"]) == ("Foo", "class")
    assert method["content"] == "    async def m(self):\n        self.go()"
    assert read["imports"] == ["import os", "from a import b"]
    assert ("nöt.py", "größe", "function") in chunks


def test_python_calls_include_nested_functions(tables):
    assert calls_of(tables, "read") == {("helper", 8, "direct"), ("run", 9, "method"), ("svc.load", 9, "method")}
    assert calls_of(tables, "Foo.m") == {("self.go", 15, "method")}


def test_bases(tables):
    rows = {(r["child_name"], r["parent_name"], r["relation_type"]) for r in tables.inheritance.collect()}
    assert rows == {
        ("Foo", "Base", "extends"), ("Foo", "abc.ABC", "extends"), ("Foo", "Generic", "extends"),
        ("UserController", "BaseController", "extends"), ("UserController", "Auditable", "implements"), ("UserController", "Closeable", "implements"),
        ("Store", "A", "extends"), ("Store", "B", "extends"), ("CatsController", "Base", "extends"), ("CatsController", "OnInit", "implements"), ("Shape", "Other", "extends"),
    }


def test_java_units(chunks):
    find = chunks["a/UserController.java", "find", "method"]
    assert (find["start_line"], find["end_line"], find["parent_name"]) == (20, 29, "UserController")
    assert find["docstring"] == "Finds { one."
    assert (find["metadata"]["route"]["method"], find["metadata"]["route"]["path"]) == ("GET", "/api/users/{id}")
    assert chunks["a/UserController.java", "UserController", "constructor"]["end_line"] == 16
    assert chunks["a/UserController.java", "UserController", "class"]["docstring"] == "Serves users."
    assert chunks["a/UserController.java", "nothing", "method"]["signature"] == "abstract void nothing(int a)"
    assert chunks["a/UserController.java", "save", "method"]["parent_type"] == "interface"


def test_java_calls_and_injection(tables):
    assert calls_of(tables, "UserController.find") == {("userService.find", 24, "method"), ("log.info", 26, "method"), ("User.<init>", 28, "constructor")}
    assert calls_of(tables, "UserController.UserController") == {("init", 15, "direct")}
    rows = {(r["field_name"], r["field_type"], r["injection_type"]) for r in tables.class_dependencies.collect()}
    assert rows == {("userService", "UserService", "field"), ("repo", "UserRepo", "constructor"), ("users", "List<User>", "constructor")}


def test_typescript_units(chunks):
    load = chunks["b/x.ts", "load", "function"]
    assert load["docstring"] == "Loads all."
    assert [(c["method"], c["url"]) for c in load["metadata"]["outgoing_api_calls"]] == [("GET", "/api/users/{id}"), ("POST", "/users/list")]
    card = chunks["b/x.ts", "Card", "function"]
    assert card["metadata"]["is_react_component"] and card["metadata"]["props_interface"] == "CardProps"
    assert card["end_line"] == 16
    handler = chunks["b/x.ts", "handler", "function"]["metadata"]["route"]
    assert (handler["method"], handler["path"], handler["framework"]) == ("GET", "/things/:id", "express")
    one = chunks["b/x.ts", "findOne", "method"]["metadata"]["route"]
    assert (one["method"], one["path"], one["framework"]) == ("GET", "/cats/:id", "nestjs")
    assert ("b/x.ts", "Alias", "class") in chunks


def test_typescript_calls(tables):
    assert calls_of(tables, "CatsController.findOne") == {("this.svc.findOne", 29, "method"), ("then", 29, "direct"), ("Cat.constructor", 30, "constructor")}


def test_errors_are_rows(tables):
    files = {r["file_path"]: (r["error"], r["n_chunks"]) for r in tables.files.collect()}
    assert files["bad.py"][0].startswith("SyntaxError") and files["bad.py"][1] == 0
    assert files["binary.py"][0] == "not valid UTF-8"
    assert files["empty.py"] == (None, 0) and files["comment.py"] == (None, 0) and files["empty.js"] == (None, 0)
    row = parsing.counters(tables.files).first()
    assert (row["processed"], row["skipped"]) == (8, 2)


@pytest.mark.parametrize("files", [sources._python, sources._braces, sources._form_files])
def test_texts_of_one_row_group_are_parsed_by_all_tasks(spark, files):
    shares = [r["count"] for r in files(spark, "/root/testdata/sf0.01").groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) >= spark.sparkContext.defaultParallelism
    assert max(shares) <= 2 * sum(shares) / spark.sparkContext.defaultParallelism


def test_blocks_of_prose_are_not_read_as_code(monkeypatch):
    read = []
    real = python_code.ast.parse
    monkeypatch.setattr(python_code.ast, "parse", lambda text: read.append(text) or real(text))
    found = python_code.parse("1 + = first line\nsecond line\nclassy defect\nx = 1; import os\ndef f():\n    return g()\n")
    assert found["error"] and found["imports"] == ["import os"] and [u["name"] for u in found["units"]] == ["f"]
    assert len(read) == 3  # the whole text and the two blocks that declare something


def test_units_are_built_once(spark):
    """The planner would put a filter on the size of an array before it opens it, and build the whole array again for that."""
    files = spark.createDataFrame([("r", "A.java", "class A extends B { void a() { b(); } }", "java"), ("r", "a.py", "class A(B):\n    def a(self): b()", "python"), ("r", "e.py", "", "python")], "repo_name string, file_path string, content string, language string")
    tables = parsing.tables_of(parsing.parse_files(files))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(tables.chunks.select("id")).count("sha2(") == 2  # one for each parser
    assert plan(tables.inheritance).count("flatten(") == 1
    assert "sha2(" not in plan(parsing.counters(tables.files))
    assert sorted(r["name"] for r in tables.chunks.collect()) == ["A", "A", "a", "a"] and tables.inheritance.count() == 2
    assert parsing.counters(tables.files).collect()[0].asDict() == {"repo_name": "r", "processed": 3, "skipped": 0, "chunks": 4}


def test_parsers_build_what_is_asked_for(spark, monkeypatch):
    files = sources._form_files(spark, "/root/testdata/sf0.001").unionByName(sources._braces(spark, "/root/testdata/sf0.001")).unionByName(sources._python(spark, "/root/testdata/sf0.001"))
    whole = parsing.tables_of(parsing.parse_files(files))
    part = lambda *wanted: parsing.tables_of(parsing.parse_files(files, wanted))
    assert sorted(whole.inheritance.collect()) == sorted(part("bases").inheritance.collect())
    assert sorted(whole.calls.collect()) == sorted(part("calls").calls.collect())
    assert sorted(whole.files.collect(), key=str) == sorted(part().files.collect(), key=str)
    braces = files.where("language <> 'python'")
    found = parsing.tables_of(brace_code.parse_braces(braces, ["dependencies"])).class_dependencies.collect()
    assert found and sorted(found) == sorted(parsing.tables_of(brace_code.parse_braces(braces)).class_dependencies.collect())
    for name in ("unit", "call_sites"):
        monkeypatch.setattr(python_code, name, None)
    read = python_code.parse("class A(B):\n    def a(self): b()", ["bases"])
    assert [b["parent_name"] for b in read["bases"]] == ["B"] and read["n_chunks"] == 2
    assert brace_lexer.file_units("class A extends B { void a() { b(); } }", "java", ["bases"])[1] == []
